"""Which texts hold which parts, by an index of their rarest fingerprints: no part is compared with every text.

A text's fingerprints are the least hashes of K neighbouring characters in every stretch of WIDTH places. A stretch that
lies in a part lies in each text that holds the part, so all the part's fingerprints are the text's as well; the one that
the fewest texts have is looked up, and the texts found are searched for the part itself. Parts that are too short for a
stretch have smaller ones, and the shortest are looked up as they are, among the runs of characters of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import discarded, stored

#: (K, WIDTH) of parts with K + WIDTH - 1 characters at least; the first that fits is taken.
CLASSES = [(12, 16), (6, 4)]
SHORT = CLASSES[-1][0] + CLASSES[-1][1] - 1


def hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of every k neighbouring characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def fingerprints(text: str, k: int, width: int) -> np.ndarray:
    """The distinct least hashes of all stretches, as signed numbers; none if the text is shorter than one."""
    low, span = hashes(text, k), 1
    while span < width and len(low):
        step = min(span, width - span)
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        span += step
    return np.unique(low).view(np.int64)


def _prints(rows: DataFrame, k: int, width: int) -> DataFrame:
    """(h, print) of (h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = fingerprints(text, k, width)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), h, np.int64)), pa.array(found)], ["h", "print"])

    return rows.mapInArrow(run, "h long, print long")


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of so many characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda at: F.substring(text, at, F.lit(size)))))


def contained(rows: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """All columns of rows and parts for each pair in which the part stands in the text, letter by letter.

    Null and empty parts stand in nothing, and nothing stands in a null text. Repeated rows and parts each give their pairs.
    Any number of parts of any length: texts are read once for each class of lengths that there is and once for each
    length below SHORT.
    """
    texts = rows.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t <> ''")
    wanted = stored(parts.where(F.coalesce(F.length(part), F.lit(0)) > 0).select(F.xxhash64(part).alias("p"), F.col(part).alias("t"), F.length(part).alias("n")).dropDuplicates(["p", "t"]), "wanted")
    sizes = [r["n"] for r in wanted.where(F.col("n") < SHORT).select("n").distinct().collect()]  # under SHORT of them
    found, over, done = [], 1 << 30, [wanted]
    for k, width in CLASSES:
        own = wanted.where((F.col("n") >= k + width - 1) & (F.col("n") < over))
        over = k + width - 1
        if own.isEmpty():
            continue
        asked = stored(_prints(own.select("p", "t"), k, width).select(F.col("h").alias("p"), "print"), "asked")
        held = stored(_prints(texts, k, width).distinct().join(asked.select("print").distinct(), "print", "left_semi"), "prints")
        counts = held.groupBy("print").agg(F.count("*").alias("n"))
        rare = asked.join(counts, "print", "left").groupBy("p").agg(F.min_by("print", F.struct(F.coalesce("n", F.lit(0)), "print")).alias("print"))
        found.append(held.join(rare, "print").select("h", "p"))
        done += [asked, held]
    for size in sorted(sizes):
        own = wanted.where(F.col("n") == size).select("t", "p")
        runs = texts.select("h", F.explode(_runs(F.col("t"), size)).alias("t"))
        found.append(runs.join(own, "t").select("h", "p"))
    names = [*rows.columns, *parts.columns]
    pairs = rows.sparkSession.createDataFrame([], "h long, p long")
    for some in found:
        pairs = pairs.unionByName(some)
    pairs = stored(pairs.distinct(), "pairs")
    discarded(*done)
    r = rows.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rows.columns)], F.col(text).alias("_text"), F.xxhash64(text).alias("h"))
    p = parts.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(parts.columns)], F.col(part).alias("_part"), F.xxhash64(part).alias("p"))
    both = pairs.join(p, "p").join(r, "h").where(F.contains("_text", F.col("_part")) & (F.length("_part") > 0))
    return both.select(*[F.col(f"r{i}") for i in range(len(rows.columns))], *[F.col(f"p{i}") for i in range(len(parts.columns))]).toDF(*names)
