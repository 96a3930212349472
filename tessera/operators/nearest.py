"""Exact nearest neighbours by partial top-k, and 8-bit quantised search with exact rescoring.

The points stay where they are: each task scores its batches against the queries, which are broadcast in blocks of a
counted size, and keeps the k best rows of each query (and group). These are all that is shuffled, k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.vector import top_k
from tessera.session import scratch

#: Queries of a block, values of a block of scores, and groups that a task holds before it hands on what it has.
QUERIES, SCORES, GROUPS = 2000, 4_000_000, 64
#: Steps of 8 bits on either side of 0, and bins of the histogram that the bounds are read from.
STEPS, BINS = 127, 8192


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): of the lists with size values, none of them null or infinite, in double precision."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == size)
    at = column.offsets.to_numpy()[rows]
    flat = pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[at[:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fit = np.isfinite(x).all(1)
    return rows[fit], x[fit]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, y): vectors of length 1; a zero vector has no direction and isn't kept."""
    norm = np.sqrt((x * x).sum(1))
    kept = norm > 0
    return kept, x[kept] / norm[kept, None]


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


class Best:
    """The k best (score, id) of each query: highest scores, and of equal ones the smallest ids."""

    def __init__(self, k: int, queries: int):
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, threshold: float) -> None:
        """scores: a row for each id, a column for each query."""
        n = len(ids)
        if n > self.k:
            least = np.maximum(np.maximum(np.partition(scores, n - self.k, axis=0)[n - self.k], self.least), threshold)
        else:
            least = np.maximum(self.least, threshold)
        row, query = np.nonzero(scores >= least)
        query, score, own = np.concatenate([self.query, query]), np.concatenate([self.score, scores[row, query]]), np.concatenate([self.id, ids[row]])
        order = np.lexsort((own, -score, query))
        query, score, own = query[order], score[order], own[order]
        first = np.searchsorted(query, np.arange(len(self.least)))
        place = np.arange(len(query)) - first[query]
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], own[kept]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def _blocks(queries: DataFrame, per_block: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of the queries, per_block of them at most; those without a direction are left out."""
    q = queries.select(F.col("query_id").cast("long"), F.col("query_vec").cast("array<double>"))
    q = q.where(F.coalesce((F.size("query_vec") > 0) & ~F.exists("query_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    q = q.withColumn("_size", F.size("query_vec"))
    for size, n in sorted((r["_size"], r["n"]) for r in q.groupBy("_size").agg(F.count("*").alias("n")).collect()):
        parts = -(-n // per_block)
        own = q.where(F.col("_size") == size)
        for p in range(parts):
            rows = (own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else own).orderBy("query_id").collect()
            kept, x = unit(np.array([r["query_vec"] for r in rows], np.float64).reshape(len(rows), size))
            ids = [r["query_id"] for r, fit in zip(rows, kept, strict=True) if fit]
            if ids:
                yield ids, x


def _task(ids: list, held, k: int, threshold: float, score, group_type: pa.DataType | None):
    """The rows of a task: score(vectors, queries) of its batches, the k best of each query and group."""

    def out(best: dict, names: list[str]) -> pa.RecordBatch:
        parts = [(g, b) for g, b in best.items() if len(b.id)]
        query = np.concatenate([np.zeros(0, np.int64), *(b.query for _, b in parts)])
        columns = [pa.array([ids[q] for q in query.tolist()], pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.id for _, b in parts)])), pa.array(np.concatenate([np.zeros(0), *(b.score for _, b in parts)]))]
        if group_type is not None:
            columns.append(pa.array([g for g, b in parts for _ in range(len(b.id))], group_type))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        best: dict = {}
        names = ["query_id", "id", "score", "group"][: 3 + (group_type is not None)]
        for batch in batches:
            rows, x, more = score.read(batch.column(1), queries)
            own = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            groups = [None] * len(rows) if group_type is None else [batch.column(2)[int(r)].as_py() for r in rows]
            where: dict = {}
            for at, g in enumerate(groups):
                where.setdefault(g, []).append(at)
            for g, at in where.items():
                step = max(1, SCORES // len(ids))
                for a in range(0, len(at), step):
                    some = np.array(at[a : a + step])
                    best.setdefault(g, Best(k, len(ids))).add(score.scores(x[some], more[some], queries), own[some], threshold)
            if len(best) > GROUPS:
                yield out(best, names)
                best = {}
        yield out(best, names)

    return run


class Exact:
    """Cosine in double precision, rounded to six digits."""

    def __init__(self, size: int):
        self.size = size

    def read(self, column: pa.ListArray, queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, x = matrix(column, self.size)
        kept, y = unit(x)
        return rows[kept], y, np.zeros(int(kept.sum()))

    def scores(self, x: np.ndarray, more: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return rounded(x @ queries.T)


def nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", group: str | None = None, threshold: float = 0.0, per_block: int = QUERIES) -> DataFrame:
    """query_id, the id, score (and group) with rank: the k points with the highest cosine of each query (query_id,
    query_vec), and of each group if one is named; scores at or above the threshold, which is 0 at least.

    Ids are integers; a null id is left out, as are vectors that are null or zero, hold nulls, or are of another length.
    Equal scores go by rising id. Repeated points each count, repeated queries count once for each row. Without queries or
    points there are no rows. Over per_block queries, each block is a pass over the points and its rows a table.
    """
    spark = points.sparkSession
    kind = points.schema[group].dataType if group else None
    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"), *([F.col(group).alias("group")] if group else [])).where("id is not null")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())] + ([T.StructField("group", kind)] if group else []))
    found = []
    for ids, x in _blocks(queries, per_block):
        run = _task(ids, spark.sparkContext.broadcast(x), k, max(0.0, threshold), Exact(x.shape[1]), to_arrow_type(kind) if group else None)
        found.append(rows.mapInArrow(run, schema))
    return ranked(_together(spark, found, schema), k, ["query_id"] + (["group"] if group else []), id_col, group)


def similar(points: DataFrame, queries: DataFrame, keep: list[str], threshold: float = 0.0, per_block: int = QUERIES) -> DataFrame:
    """query_id, keep and score of all points at or above the threshold, which is 0 at least, for each query (query_id,
    query_vec). Vectors and scores are as in nearest(); the rows leave the tasks in batches and nothing is shuffled."""
    spark, least = points.sparkSession, max(0.0, threshold)
    rows = points.select(F.col("embedding").cast("array<double>").alias("_x"), *keep)
    schema = T.StructType([T.StructField("query_id", T.LongType()), *(points.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    out = None
    for ids, vectors in _blocks(queries, per_block):
        part = rows.mapInArrow(_pairs(pa.array(ids, pa.int64()), spark.sparkContext.broadcast(vectors), Exact(vectors.shape[1]), least, schema.names), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _pairs(ids: pa.Array, held, score: Exact, least: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x, _ = score.read(batch.column(0), held.value)
            step = max(1, SCORES // 8 // len(ids))
            for a in range(0, len(rows), step):
                found = rounded(x[a : a + step] @ held.value.T)
                at, query = np.nonzero(found >= least)
                own = pa.array(rows[a : a + step][at])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), *(c.take(own) for c in batch.columns[1:]), pa.array(found[at, query])], names)

    return run


def _together(spark, found: list[DataFrame], schema: T.StructType) -> DataFrame:
    if len(found) < 2:
        return found[0] if found else spark.createDataFrame([], schema)
    path = scratch(spark, "nearest")
    for part in found:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked(found: DataFrame, k: int, by: list[str], id_col: str, group: str | None = None) -> DataFrame:
    out = top_k(found, k, by, [F.desc("score"), F.asc("id")]).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("group", group) if group else out


class Codes:
    """Scores of 8-bit codes: x is about base + step * code, so a dot product is one of whole numbers and two sums."""

    def __init__(self, size: int, low: float, high: float):
        self.size, self.step, self.base = size, max((high - low) / (2 * STEPS), 1e-12), (low + high) / 2

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.base) / self.step), -STEPS, STEPS).astype(np.int8)

    def read(self, column: pa.Array, queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = pc.fill_null(pc.binary_length(column), -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(length == self.size)
        codes = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), self.size)
        return rows, codes, codes.sum(1, dtype=np.int64)

    def scores(self, codes: np.ndarray, sums: np.ndarray, queries: np.ndarray) -> np.ndarray:
        whole = codes.astype(np.float64) @ queries.astype(np.float64).T  # sums of whole numbers far below 2 ** 53
        both = sums[:, None] + queries.sum(1, dtype=np.int64)[None, :]
        return self.size * self.base**2 + self.base * self.step * both + self.step**2 * whole


def bounds(points: DataFrame, size: int, quantile: float = 0.99) -> tuple[float, float]:
    """The values between which a share of all components of unit vectors lies, to the width of a bin; counts of bins
    are summed over the tasks, so only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            _, x = matrix(batch.column(0), size)
            _, y = unit(x)
            total += np.histogram(y, BINS, (-1.0, 1.0))[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    counted = points.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BINS, np.int64)
    for r in counted:
        total[r["bin"]] = r["n"]
    up = np.cumsum(total)
    if not up[-1]:
        return -1.0, 1.0
    tail = (1 - quantile) / 2 * up[-1]
    low, high = np.searchsorted(up, tail, side="right"), np.searchsorted(up, up[-1] - tail, side="left")
    return float(low) / BINS * 2 - 1, float(min(high + 1, BINS)) / BINS * 2 - 1


def quantised(points: DataFrame, size: int, quantile: float = 0.99, id_col: str = "vec_id") -> tuple[DataFrame, Codes]:
    """((id, code), codes): a byte for each component of the points' unit vectors. Points that nearest leaves out have none."""
    codes = Codes(size, *bounds(points, size, quantile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column(1), size)
            kept, y = unit(x)
            data = codes.encode(y)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[kept])), pa.array([c.tobytes() for c in data], pa.binary())], ["id", "code"])

    rows = points.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where("id is not null")
    return rows.mapInArrow(run, "id long, code binary"), codes


def nearest_quantised(codes: DataFrame, how: Codes, points: DataFrame, queries: DataFrame, k: int, more: float = 3.0, id_col: str = "vec_id", threshold: float = 0.0, per_block: int = QUERIES) -> DataFrame:
    """As nearest, by the codes: the more * k best of each query by whole numbers are scored again by their vectors.

    Vectors of candidates are joined by id; a candidate whose point is gone is left out. What the codes lose is a
    candidate that they put behind more * k others.
    """
    spark, m = points.sparkSession, int(np.ceil(k * more))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    found = []
    for ids, x in _blocks(queries, per_block):
        if x.shape[1] == how.size:
            found.append(codes.mapInArrow(_task(ids, spark.sparkContext.broadcast(how.encode(x)), m, -np.inf, how, None), schema))
    some = top_k(_together(spark, found, schema), m, ["query_id"], [F.desc("score"), F.asc("id")]).select("query_id", "id")
    full = some.join(points.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("x")), "id").join(queries.select(F.col("query_id").cast("long"), "query_vec"), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, x = matrix(batch.column(2), how.size)
            b, y = matrix(batch.column(3), how.size)
            both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            fx, x = unit(x[at])
            fy, y = unit(y[bt])
            fit = fx & fy
            score = rounded((x[fit[fx]] * y[fit[fy]]).sum(1))
            rows = pa.array(both[fit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score)], ["query_id", "id", "score"])

    scored = full.select("query_id", "id", F.col("x").cast("array<double>"), F.col("query_vec").cast("array<double>")).mapInArrow(run, schema)
    return ranked(scored.where(F.col("score") >= max(0.0, threshold)), k, ["query_id"], id_col)
