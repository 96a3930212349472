import math

import numpy as np
import pytest

from tessera.llm import common, embedding_dedup
from tessera.llm.embedding_dedup import _forest, near_duplicate_vectors


def brute(rows, least):
    unit, low = {}, list(range(len(rows)))
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = [0] * len(rows)

    def find(k):
        while low[k] != k:
            k = low[k]
        return k

    same = [(a, b) for a in unit for b in unit if a < b and rows[a][0] == rows[b][0]]
    for a, b in links + same:
        low[max(find(a), find(b))] = min(find(a), find(b))
    for a, b in links:
        n[a], n[b] = n[a] + 1, n[b] + 1
    least_id = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(i, least_id.get(find(k), i))
    return sorted((r[0] if r[0] is not None else -1, n[k], least_id.get(find(k), -1)) for k, r in enumerate(rows))


def check(spark, rows, least=0.98):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<float>, n int").repartition(3)
    exact = [(i, x, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, x, v in rows]
    got = near_duplicate_vectors(df, least).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.vec_id), r.n_links, none(r.component_id)) for r in got) == brute(exact, least)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng, rows = np.random.default_rng(block), []
    for size, spread in ((60, 0.09), (40, 0.25), (30, 0.01), (50, 0.16)):
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            x = centre + spread * rng.normal(size=16) / 4
            rows.append((len(rows), int(rng.integers(2)), (x * rng.uniform(0.1, 9)).tolist()))
    rows += [(len(rows) + k, k % 3, rng.normal(size=16).tolist()) for k in range(80)]
    rows += [(1000 + k, 1, rows[3][2]) for k in range(9)] + [(2000, 1, [2 * x for x in rows[3][2]])]
    check(spark, rows)


def test_edges(spark):
    one, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(9, 1, one), (4, 1, one), (5, 2, one), (4, 2, other), (7, 2, other), (8, None, one), (None, 1, one), (10, 1, None), (11, 1, []), (12, 1, [0.0, 0.0])]
    rows += [(13, 1, [1.0, None]), (14, 1, [1.0, float("nan")]), (15, 1, [float("inf"), 1.0]), (16, 1, [1.0, 0.0, 0.0]), (17, 1, [-1.0, 0.0]), (18, 1, [3.0, -0.0]), (18, 1, [3.0, -0.0])]
    check(spark, rows)
    check(spark, [])


def test_forest():
    assert _forest(np.array([5, 9, 1, 7]), np.array([9, 1, 3, 8])).tolist() == [[3, 1], [5, 1], [8, 7], [9, 1]]


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    got = near_duplicate_vectors(common.table(spark, sf, "embeddings")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.98)
