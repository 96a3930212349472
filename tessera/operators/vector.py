"""Vector search operators: similarity, top-k, score normalisation, mixing and de-duplication."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


#: The rows of a table of queries that are broadcast at once.
SMALL = 2000


def in_blocks(points: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """All rows beside all of a stated set of queries, which are counted: up to SMALL of them are broadcast, and more go in
    blocks of about so many, each a pass over the points. Nothing is shuffled."""
    n = len(queries.select(key).take(SMALL + 1))
    if n <= SMALL:
        return points.crossJoin(F.broadcast(queries))
    blocks = -(-queries.count() // SMALL)
    own = [queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(lambda a, b: a.unionByName(b), [points.crossJoin(F.broadcast(q)) for q in own])


def scored(points: DataFrame, queries: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Every point against every query (query_id, query_vec): score at or above the threshold."""
    pairs = in_blocks(points, queries, "query_id")
    return pairs.withColumn("score", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6)).where(F.col("score") >= max(0.0, threshold))


def top_k(hits: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group; rank is 1 for the first."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def minmax(hits: DataFrame, score: str, by: list[str], out: str) -> DataFrame:
    """Min-max normalised score in each group; 0 where all scores are equal. The bounds are summed map-side and joined,
    so a group of many hits isn't one task; they are a written table, so that Spark knows their size and broadcasts a few."""
    bounds = stored(hits.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high")), "limits")
    both = hits.join(bounds, by)
    return both.withColumn(out, F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)).drop("_low", "_high")


def mix(alpha: float, first: str, second: str) -> Column:
    return alpha * F.col(first) + (1 - alpha) * F.col(second)


def first_by_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay, and aren't brought together."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", n).where(F.col("_n") == 1).drop("_n").unionByName(rows.where(F.col(key).isNull()))


def two_stage(hits: DataFrame, reranked: Column, by: list[str], initial: int, final: int) -> DataFrame:
    """The best ``max(initial, final)`` candidates of each group by score, of these the best ``final`` by the second score."""
    first = top_k(hits, max(initial, final), by, [F.desc("score"), F.asc("vec_id")]).withColumnRenamed("rank", "first_rank")
    return top_k(first.withColumn("rerank_score", reranked), final, by, [F.desc("rerank_score"), F.asc("first_rank")])


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets, 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def retrieval_confidence(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean of the three best scores through a sigmoid, damped by .9 below .7 and by .8 below .5."""
    best = top_k(hits, 3, by, [F.desc(score), F.asc("vec_id")]).groupBy(*by).agg(F.avg(score).alias("top3"))
    s = sigmoid(F.col("top3"))
    return best.withColumn("confidence", s * F.when(s >= 0.7, 1.0).when(s >= 0.5, 0.9).otherwise(0.8))


#: Pairs of a task, about, and of those that it holds at once; queries beside one another in these.
PAIRS, BATCH, TILE = 2_000_000, 250_000, 256


def jaccard_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, jaccard): the overlap of every document's distinct words (doc_id, words) with those of every query
    (query_id, words). Queries go to the tasks in blocks, by word; 0 if either has no words, null where words are null.

    The rows are the square of the documents, so they leave the tasks in an order that takes little space as columns: a
    task, and each tile of its rows, has documents and queries of nearly the same numbers of words, and so few different
    overlaps, and whole bytes of codes of ids repeat from document to document.
    """
    spark, size = docs.sparkSession, F.coalesce(F.size("words"), F.lit(-1))
    sized = queries.select("query_id", "words", size.alias("_size"))
    blocks = _size_blocks([(r["_size"], r["n"]) for r in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()], SMALL)
    tasks = max(spark.sparkContext.defaultParallelism, -(-docs.count() * SMALL // PAIRS))
    near, out = docs.select("doc_id", F.to_json("words").alias("words"), size.alias("_size")).repartitionByRange(tasks, "_size", F.xxhash64("doc_id")), None  # a text is half of an array
    for low, high, part, parts in blocks:
        own = sized.where(F.col("_size").between(low, high) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part))
        rows = own.orderBy("_size", "query_id").collect()  # SMALL rows about
        sizes = np.array([-1 if r["words"] is None else len(r["words"]) for r in rows], np.int64)
        of: dict[str, list[int]] = {}
        for at, r in enumerate(rows):
            for w in r["words"] or []:
                of.setdefault(w, []).append(at)
        held = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), sizes, {w: np.array(x, np.int32) for w, x in of.items()}))
        found = near.mapInArrow(_overlaps(held), "query_id long, doc_id long, jaccard double")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, doc_id long, jaccard double") if out is None else out


def _size_blocks(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int, int, int]]:
    """(low, high, part, parts) of (size, n): ranges of sizes that hold up to most rows; a size with more goes in parts."""
    out: list[tuple[int, int, int, int]] = []
    held = 0
    for size, n in sorted(counts):
        if out and out[-1][3] == 1 and held + n <= most:
            out[-1], held = (out[-1][0], size, 0, 1), held + n
        else:
            parts = -(-n // most)
            out += [(size, size, k, parts) for k in range(parts)]
            held = n
    return out


def _overlaps(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, of = held.value
        none, whole = np.zeros(0, np.int32), len(ids) // 8 * 8
        tiles = [(a, min(a + TILE, whole)) for a in range(0, whole, TILE)] + [(whole, len(ids))]
        step = max(1, BATCH // max(1, len(ids)))
        for batch in batches:
            order = np.argsort(batch.column(2).to_numpy(), kind="stable")
            for lo in range(0, batch.num_rows, step):
                some = order[lo : lo + step]
                doc, docs = batch.column(0).take(pa.array(some)).cast(pa.int64()), [x and json.loads(x) for x in batch.column(1).take(pa.array(some)).to_pylist()]
                size = np.array([-1 if words is None else len(words) for words in docs], np.int64)[:, None]
                both = np.stack([np.bincount(np.concatenate([none, *(of[w] for w in words or [] if w in of)]), minlength=len(ids)) for words in docs])
                either = size + sizes - both
                score = np.where(either > 0, both / np.maximum(either, 1), 0.0)
                null = (np.minimum(sizes, size) < 0) & (sizes != 0) & (size != 0)
                for a, b in tiles:
                    if a < b:
                        own = doc.take(pa.array(np.repeat(np.arange(len(docs)), b - a)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids[a:b], len(docs))), own, pa.array(score[:, a:b].ravel(), mask=null[:, a:b].ravel())], ["query_id", "doc_id", "jaccard"])

    return run
