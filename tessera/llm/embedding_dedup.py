"""Embedding near-dedup (4): an exact metric range join of unit vectors under labels.

Pivots divide the vectors of a label into cells by the nearest pivot. A vector within the search radius of another
cell's border is replicated into that cell, and cells are joined independently: between unit vectors the distance from
the bisector of two pivots is (d_j^2 - d_i^2) / (2 d_ij), and two vectors within the radius of each other that lie on
its two sides are both that near to it; the bound that the triangle inequality alone gives, (d_j - d_i) / 2, is wider.
Equal vectors are one class. Vectors of a cell that lie within half the radius of its pivot are links of each other by
the triangle inequality and are counted, not compared; so a dense group costs one pass. Everything else of a cell is
compared in blocks of BLOCK by BLOCK, however large the cell is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components

BLOCK = 1024
#: At most so many pivots are drawn, and broadcast.
MAX_PIVOTS = 512
#: Vectors of a label for each pivot that is drawn.
PER_PIVOT = 1500
SLACK = 1e-6
CORE, HOME, GUEST = 0, 1, 2


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding) to unit vectors as bytes; vectors that are null, empty, zero or not finite go."""
    for batch in batches:
        out = []
        for i, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not values or any(x is None for x in values):
                continue
            x = np.array(values, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            x = x / top
            x = x / np.sqrt((x * x).sum())
            data = (x + 0.0).astype("<f8").tobytes()
            out.append((i, f"{len(x)}|{label}", hashlib.blake2b(data, digest_size=16).digest(), data))
        if out:
            i, g, d, x = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(g), pa.array(d, pa.binary()), pa.array(x, pa.binary())], ["vec_id", "grp", "digest", "vec"])


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)


def _apart(pivots: np.ndarray, least: float) -> np.ndarray:
    """Pivots in their order, without those nearer than least to one before."""
    kept: list[np.ndarray] = []
    for p in pivots:
        if all(((p - q) ** 2).sum() >= least * least for q in kept):
            kept.append(p)
    return np.array(kept)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T), 0))


def _shifted(pivots: np.ndarray, radius: float):
    """Sums of the vectors within the radius of their nearest pivot, by pivot and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(pivots), np.zeros(len(pivots))
        for batch in batches:
            vecs = [v for v in batch.column(0).to_pylist() if len(v) == 8 * pivots.shape[1]]
            if vecs:
                x = _matrix(vecs)
                d = _distances(x, pivots)
                near = d.argmin(1)
                ok = d[np.arange(len(x)), near] <= radius
                np.add.at(total, near[ok], x[ok])
                np.add.at(count, near[ok], 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["pivot", "n", "total"])

    return run


def choose_pivots(classes: DataFrame, radius: float) -> np.ndarray:
    """Pivots of the commonest vector length: drawn by a hash of the id, each then moved to the middle of what lies
    within the radius of it, none within the radius of another. At most MAX_PIVOTS."""
    top = classes.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").first()
    if top is None:
        return np.zeros((0, 0))
    size = 8 * int(top["grp"].split("|")[0])
    wanted = int(min(MAX_PIVOTS, max(8, -(-top["n"] // PER_PIVOT))))
    drawn = classes.where(F.length("vec") == size).orderBy(F.xxhash64("id"), "id").select("vec").limit(2 * wanted).collect()
    pivots = _apart(_matrix([bytes(r["vec"]) for r in drawn]), 2 * radius)[:wanted]
    moved = classes.select("vec").mapInArrow(_shifted(pivots, radius), "pivot long, n double, total array<double>")
    sums = moved.select("pivot", "n", F.posexplode("total").alias("k", "x")).groupBy("pivot", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    means = pivots.copy()
    for r in sums:
        if r["n"] >= 3:
            means[r["pivot"], r["k"]] = r["x"] / r["n"]
    return _apart(means, radius)


ROW = "grp string, cell int, kind int, id long, n long, vec binary"


def _placed(pivots: np.ndarray, radius: float):
    """(grp, id, n, vec): each class in its own cell, and as a guest in every later cell whose border is within the radius."""
    between = _distances(pivots, pivots) if len(pivots) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(3).to_pylist()
            row, cell, kind = [], [], []
            fits = np.array([len(v) == 8 * pivots.shape[1] for v in vecs], bool)
            other = np.flatnonzero(~fits)
            row.append(other), cell.append(np.full(len(other), -1)), kind.append(np.full(len(other), HOME))
            mine = np.flatnonzero(fits)
            if len(mine):
                x = _matrix([vecs[i] for i in mine])
                d = _distances(x, pivots)
                home = d.argmin(1)
                low = d[np.arange(len(x)), home]
                row.append(mine), cell.append(home), kind.append(np.where(low <= radius / 2 - SLACK, CORE, HOME))
                border = (d**2 - low[:, None] ** 2) / np.maximum(2 * between[home], 1e-12)
                i, j = np.nonzero((border <= radius + SLACK) & (np.arange(len(pivots))[None, :] > home[:, None]))
                row.append(mine[i]), cell.append(j), kind.append(np.full(len(i), GUEST))
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(kind).astype(np.int32)), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take)],
                ["grp", "cell", "kind", "id", "n", "vec"],
            )

    return run


UNIT = "grp string, cell int, unit long, left boolean, kind int, id long, n long, vec binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sends every row to the pairs of blocks that it takes part in: home with all, core with guests."""
    for batch in batches:
        row, unit, left = [], [], []
        kinds, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        blocks = list(zip(*(batch.column(k).to_pylist() for k in (6, 7, 8)), strict=True))
        for i, (kind, key, size) in enumerate(zip(kinds, ids, blocks, strict=True)):
            start = (0, size[0], size[0] + size[1])
            mine = start[kind] + int(common.mix64(np.array([key], np.int64).view(np.uint64))[0] % np.uint64(size[kind]))
            for theirs in range(sum(size)):
                kinds2 = CORE if theirs < start[1] else HOME if theirs < start[2] else GUEST
                if HOME in (kind, kinds2) or {kind, kinds2} == {CORE, GUEST}:
                    a, b = min(mine, theirs), max(mine, theirs)
                    row.append(i), unit.append((a << 31) | b), left.append(mine == a)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(unit, pa.int64()), pa.array(left, pa.bool_()), batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take), batch.column(5).take(take)], [c.split()[0] for c in UNIT.split(", ")])


def _compared(least: float):
    """Of one pair of blocks: how many vectors each class links with, and its smallest partner."""

    def run(table: pa.Table) -> pa.Table:
        left = np.array(table.column("left").to_pylist())
        ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
        x = _matrix(table.column("vec").to_pylist())
        unit = table.column("unit")[0].as_py()
        if unit >> 31 == unit & 0x7FFFFFFF:
            hit = x @ x.T >= least
            np.fill_diagonal(hit, False)
            a = b = np.arange(len(x))
        else:
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            hit = x[a] @ x[b].T >= least
        out_id, out_n = [ids[a]], [hit @ n[b]]
        if a is not b:
            out_id.append(ids[b]), out_n.append(hit.T @ n[a])
        # a forest with the components of this pair of blocks, a row for each class at most
        i, j = np.nonzero(hit)
        edges = _forest(ids[a][i], ids[b][j])
        out_id, out_n = np.concatenate(out_id), np.concatenate(out_n).astype(np.int64)
        some = out_n > 0
        return pa.table({"u": np.concatenate([out_id[some], edges[:, 0]]), "v": np.concatenate([out_id[some], edges[:, 1]]), "n": np.concatenate([out_n[some], np.zeros(len(edges), np.int64)])})

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) of a small graph."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    off = low != np.arange(len(nodes))
    return np.stack([nodes[off], nodes[low[off]]], 1)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs of vectors of the same label and length with cosine >= least in double precision. Vectors with a
    null label or id, and vectors that are null, empty or zero or have null or non-finite components link with nothing
    and are kept. Rows that repeat an id give a row each, with the links of its own vector, in one component. An empty table gives no rows; other columns aren't looked at. least has to be above 0.
    """
    before = common.held()
    radius = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    unit = rows.where("label is not null and vec_id is not null").mapInArrow(_unit, "vec_id long, grp string, digest binary, vec binary")
    unit = common.written(unit, "vectors")
    classes = common.written(unit.groupBy("grp", "digest").agg(F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("id", F.xxhash64("grp", "digest")), "classes")
    pivots = choose_pivots(classes, radius)
    placed = classes.select("grp", "id", "n", "vec").mapInArrow(_placed(pivots, radius), ROW)
    placed = common.written(placed, "placed")
    size = [F.count(F.when(F.col("kind") == k, 1)) for k in (CORE, HOME, GUEST)]
    core = F.when(F.col("kind") == CORE, F.col("n"))
    cells = placed.groupBy("grp", "cell").agg(*[F.ceil(s / BLOCK).cast("long").alias(f"n{k}") for k, s in enumerate(size)], F.sum(core).alias("weight"), F.min(F.when(F.col("kind") == CORE, F.col("id"))).alias("head"))
    cells = common.written(cells, "cells")
    held = placed.join(cells.hint("merge"), ["grp", "cell"])
    inside = held.where(F.col("kind") == CORE)
    busy = held.where("n1 > 0 or (n0 > 0 and n2 > 0)").select("grp", "cell", "kind", "id", "n", "vec", "n0", "n1", "n2").mapInArrow(_units, UNIT)
    found = common.written(busy.groupBy("grp", "cell", "unit").applyInArrow(_compared(least), "u long, v long, n long").unionByName(inside.select(F.col("id").alias("u"), F.col("id").alias("v"), (F.col("weight") - F.col("n")).alias("n"))), "found")
    edges = found.where("u <> v").select("u", "v").unionByName(inside.where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")))
    counts = found.where("n > 0").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("more"))
    member = unit.select("vec_id", F.xxhash64("grp", "digest").alias("id")).join(classes.select("id", "n").hint("merge"), "id")
    twice = member.groupBy("vec_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("high").alias("u"), F.col("low").alias("v"))
    parts = components(edges.unionByName(twice)).withColumnRenamed("node", "id")
    member = member.join(counts.hint("merge"), "id", "left").join(parts.hint("merge"), "id", "left")
    member = member.select("vec_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("part"))
    lowest = member.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    member = member.join(lowest.hint("merge"), "part").select("vec_id", "n_links", "component_id")
    fits = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    values = F.col("embedding")
    fine = F.coalesce(fits & (F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(values, lambda x: x != 0), F.lit(False))
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = member.unionByName(alone)
    return common.swept(out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")), before)


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM e WHERE len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND list_max(list_transform(x, lambda v: abs(v))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT t.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = t.vec_id AS kept
FROM embeddings t JOIN m ON m.n = t.vec_id LEFT JOIN k ON k.u = t.vec_id
"""
