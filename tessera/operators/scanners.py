"""Scanners that need a stack, as Arrow-batched UDFs: nesting-aware splitting and symbol extraction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "([{", ")]}"


def split_nested(text: str | None, separator: str = ",") -> list[str]:
    """Parts between separators outside of brackets and strings, without white space around; empty parts go."""
    out, depth, quoted, cur = [], 0, False, []
    for c in text or "":
        if c == '"':
            quoted = not quoted
        elif not quoted and c in OPEN:
            depth += 1
        elif not quoted and c in CLOSE:
            depth = max(0, depth - 1)
        if c == separator and not depth and not quoted:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(c)
    out.append("".join(cur))
    return [p.strip() for p in out if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_split(text: pd.Series) -> pd.Series:
    return text.map(split_nested)


HEADER = re.compile(r"^\s*(?:(?:partial|encapsulated|final)\s+)*(package|model|block|function|class|record|connector|type)\s+(\w+)", re.M)
END = re.compile(r"^\s*end\s+(\w+)\s*;", re.M)
WITHIN = re.compile(r"^\s*within\s+([\w.]*)\s*;", re.M)


def symbols_of(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(kind, name, qualified name, first line, last line) of every definition, by headers and their ends."""
    text = text or ""
    root = [WITHIN.search(text)[1]] if WITHIN.search(text) else []
    marks = sorted([(m.start(2), "open", m) for m in HEADER.finditer(text)] + [(m.start(1), "end", m) for m in END.finditer(text)], key=lambda x: x[0])
    stack, out = [], []
    for at, kind, m in marks:
        line = text.count("\n", 0, at) + 1
        if kind == "open":
            stack.append((m[1], m[2], line))
        elif any(s[1] == m[1] for s in stack):
            while stack:
                what, name, first = stack.pop()
                out.append((what, name, ".".join([*filter(None, root), *(s[1] for s in stack), name]), first, line))
                if name == m[1]:
                    break
    return sorted(out, key=lambda s: (s[3], s[2]))


SYMBOL = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "fqn")] + [T.StructField(n, T.IntegerType()) for n in ("first_line", "last_line")])


@F.pandas_udf(T.ArrayType(SYMBOL))
def symbols(text: pd.Series) -> pd.Series:
    return text.map(lambda s: [dict(zip(("kind", "name", "fqn", "first_line", "last_line"), x, strict=True)) for x in symbols_of(s)])
