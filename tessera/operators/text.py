"""Text operators: tokens, truncation, feature flags, sections and paragraph packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased words in the Unicode sense, without empties."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}_]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """What white space separates, without empties."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def joined_fields(*cols: Column) -> Column:
    """Fields with one blank between, skipping null and empty ones."""
    return F.concat_ws(" ", *[F.when(c != "", c) for c in cols])


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def has_table(text: Column) -> Column:
    return occurrences(text, "|") >= 6


def has_code(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | (occurrences(text, "`") >= 4)


def dropped_lines(text: Column, prefixes: list[str]) -> Column:
    bad = lambda line: reduce(lambda a, b: a | b, [F.startswith(line, F.lit(p)) for p in prefixes])
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(line)), "\n")


def packed(parts: Column, limit: int, glue: str) -> Column:
    """Greedy packing of parts in their order: a chunk is closed when the next part would take it over the limit; a
    part over the limit stays whole."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, part: Column) -> Column:
        over = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(part) > limit)
        done = F.when(over, F.concat(acc["done"], F.array(stripped(acc["cur"])))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(F.when(over, F.lit("")).otherwise(acc["cur"]), part, F.lit(glue)).alias("cur"))

    def close(acc: Column) -> Column:
        return F.filter(F.concat(acc["done"], F.array(stripped(acc["cur"]))), lambda c: c != "")

    return F.aggregate(parts, zero, step, close)


def bigrams(ws: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.size(ws)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.zip_with(F.slice(ws, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    )


def whole_json(text: Column) -> Column:
    """The text as a variant, null if it is anything but one JSON value: Spark's own parser reads the first value and leaves
    what follows. Put into a list and into an object, what isn't one value breaks at least one of the two."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    kept = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & (F.size(F.try_variant_get(kept, "$", "map<string,variant>")) == 1)
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))
