import random

import numpy as np
import pytest

from tessera.operators.series import errors, nearest_rows, passes


def check(ref, val):
    """As a loop over arrays: ref has (time, ..., value), val has (time, columns)."""
    align = lambda a, b: np.array([b[np.argmin(np.abs(b[:, 0] - t))] for t in a[:, 0]])
    if len(ref) < len(val):
        val = align(ref, val)
    elif len(ref) > len(val):
        ref = align(val, ref)
    best, column = float("inf"), None
    for k in range(1, val.shape[1]):
        d = np.linalg.norm(val[:, k] - ref[:, -1])
        if d < best:
            best, column = d, k
    return None if column is None else (column, float(np.mean((val[:, column] - ref[:, -1]) ** 2)))


@pytest.mark.parametrize("seed", [1, 2])
def test_errors_against_loops(spark, seed):
    r = random.Random(seed)
    series = lambda n, cols: np.array([[r.choice([0, 0.25, 1, 2, 3.5])] + [r.random() for _ in range(cols)] for _ in range(n)])
    refs = {m: series(r.choice([3, 8, 20]), 1) for m in range(6)}
    runs = {(m, k): series(r.choice([1, 3, 8, 20]), r.randint(1, 4)) for m in range(8) for k in range(3)}
    runs[0, 0] = np.column_stack([refs[0][:, 0], refs[0][:, 1], refs[0][:, 1]])  # equal columns: the first one
    runs[1, 0][:, 1:] = np.nan
    a = spark.createDataFrame([(m, k, float(x[0]), float(x[-1])) for m, s in refs.items() for k, x in enumerate(s)], "model int, idx int, t double, value double")
    b = spark.createDataFrame([(m, n, k, float(x[0]), c, f"c{c}", float(x[c])) for (m, n), s in runs.items() for k, x in enumerate(s) for c in range(1, s.shape[1])], "model int, run int, idx int, t double, o int, name string, value double")
    got = {(x.model, x.run): (int(x.name[1:]), x.mse) for x in errors(a, b).collect()}
    want = {key: check(refs[key[0]], s) for key, s in runs.items() if key[0] in refs}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want) and all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1]) for k, v in want.items()) and got[0, 0] == (1, 0.0)
    models = spark.createDataFrame([(m,) for m in [*range(9), 0]], "model int")
    counted = {x.model: x.passed for x in passes(models, a, b, 0.1).collect()}
    assert counted == {m: sum(v[1] <= 0.1 for k, v in want.items() if k[0] == m) for m in range(9)}
    assert {x.passed for x in passes(models, a.limit(0), b, 0.1).collect()} == {0} == {x.passed for x in passes(models, a, b.limit(0), 0.1).collect()}


def test_nearest_rows(spark):
    points = spark.createDataFrame([("a", 0, 1.5), ("a", 1, -9.0), ("a", 2, 9.0), ("b", 3, 1.0)], "g string, k long, t double")
    rows = spark.createDataFrame([("a", 7, 1.0), ("a", 5, 2.0), ("a", 6, 2.0), ("c", 1, 1.0)], "g string, idx long, t double")
    assert {x.k: x.idx for x in nearest_rows(points, rows, ["g"]).collect()} == {0: 5, 1: 7, 2: 5, 3: None}
