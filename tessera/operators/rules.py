"""Boolean expressions over numbered checks, such as ``[1] or ([2] and not [3])``, compiled to Catalyst columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(\[\d+\]|and\b|or\b|not\b|[()])", re.IGNORECASE)


def tokenised(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at:]!r}")
        out.append(m[1].lower())
        at = m.end()
    return out


def compiled(text: str, checks: list[Column]) -> Column:
    """The expression over checks numbered from 1; null checks are false, and without checks and text it is true."""
    if not text.strip():
        out = F.lit(True)
        for c in checks:
            out = out & F.coalesce(c, F.lit(False))
        return out
    todo = tokenised(text)

    def either() -> Column:
        out = both()
        while todo and todo[0] == "or":
            todo.pop(0)
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while todo and todo[0] == "and":
            todo.pop(0)
            out = out & one()
        return out

    def one() -> Column:
        if not todo:
            raise ValueError("expression ends too early")
        token = todo.pop(0)
        if token == "not":
            return ~one()
        if token == "(":
            out = either()
            if not todo or todo.pop(0) != ")":
                raise ValueError("missing )")
            return out
        if token[0] != "[" or not 1 <= int(token[1:-1]) <= len(checks):
            raise ValueError(f"unexpected {token}")
        return F.coalesce(checks[int(token[1:-1]) - 1], F.lit(False))

    out = either()
    if todo:
        raise ValueError(f"unexpected {todo[0]}")
    return out


def targets(asked: DataFrame, held: DataFrame, by: str, strict: bool = False) -> DataFrame:
    """(by, name): the collections that a search goes to, of those asked for (by, name) and those there are (name, points).

    strict: all that are asked for, or none where one of them is missing or empty. Otherwise those with points, and where
    there are none all collections with points.
    """
    full = held.where("points > 0").select("name").distinct()
    known = asked.select(by, "name").distinct().join(full.withColumn("there", F.lit(1)), "name", "left")
    count = known.groupBy(by).agg(F.count("*").alias("n"), F.count("there").alias("found"))
    some = known.where("there = 1").select(by, "name")
    if strict:
        return some.join(count.where("n = found").select(by), by, "left_semi").select(by, "name")
    return some.unionByName(count.where("found = 0").select(by).crossJoin(F.broadcast(full)).select(by, "name"))  # names of collections
