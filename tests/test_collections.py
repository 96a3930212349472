"""Collections by manifest, quantised and sparse search, and ingest of files, against brute force and broken writers."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nearest as N
from tessera.operators import sparse as P
from tessera.sources import collections as C
from tessera.streaming.events import ingest_files

POINT = "id string, embedding array<float>, text string, entry_id long"


def rows_of(spark, ids, text):
    return spark.createDataFrame([(str(i), [1.0, float(i)], text, i) for i in ids], POINT)


def told(held, name, version=None):
    return {r.id: r.text for r in held.points(name, version).collect()}


def test_layers_versions_and_compaction(spark, tmp_path, monkeypatch):
    held = C.Collections(spark, str(tmp_path))
    held.create("x", 2, buckets=4)
    want, sizes = {}, []
    r = random.Random(1)
    for k in range(6):
        ids = range(400) if not k else [r.randrange(420)]
        assert held.upsert("x", rows_of(spark, ids, f"t{k}"))
        want |= {str(i): f"t{k}" for i in ids}
        assert told(held, "x") == want
        newest = max((tmp_path / "x" / "data").iterdir(), key=lambda p: p.stat().st_mtime)
        sizes.append(sum(f.stat().st_size for f in newest.rglob("*.parquet")))
        if k:
            assert len(list(newest.glob("bucket=*"))) == 1
    assert max(sizes[1:]) < sizes[0] / 3
    assert told(held, "x", 1) == {str(i): "t0" for i in range(400)}
    assert max(map(len, held.manifest("x")["layers"].values())) > 2
    monkeypatch.setattr(C, "LAYERS", 2)
    held.upsert("x", rows_of(spark, [7], "last"))  # compacts the buckets that have more
    want["7"] = "last"
    assert max(map(len, held.manifest("x")["layers"].values())) <= 2 and told(held, "x") == want
    held.upsert("x", rows_of(spark, [7], "last"))
    assert held.compact("x") > 0 and held.compact("x") == 0
    assert told(held, "x") == want and {len(x) for x in held.manifest("x")["layers"].values()} == {1}
    assert held.vacuum("x") > 0 and held.versions("x") == [held.manifest("x")["version"]] and told(held, "x") == want


def test_failed_and_competing_writers(spark, tmp_path, monkeypatch):
    held, other = C.Collections(spark, str(tmp_path)), C.Collections(spark, str(tmp_path))
    held.create("x", 2, buckets=2)
    held.upsert("x", rows_of(spark, range(10), "a"))

    def broken(self, *a):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(C.Collections, "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            held.upsert("x", rows_of(spark, range(10), "b"))
    assert set(told(held, "x").values()) == {"a"} and held.versions("x") == [1]
    original = C.Collections._write

    def late(self, data, *parts):
        if self is held and parts[-2:-1] == ("manifest",) and data["version"] == 2:
            other.upsert("x", rows_of(spark, [5, 11], "other"))  # another writer comes first
        original(self, data, *parts)

    with monkeypatch.context() as m:
        m.setattr(C.Collections, "_write", late)
        assert held.upsert("x", rows_of(spark, [4, 5], "c"))
    assert held.versions("x") == [1, 2, 3] and told(held, "x") == {str(i): "a" for i in range(10)} | {"11": "other", "4": "c", "5": "c"}
    with pytest.raises(C.Conflict):
        held._write({}, "x", "manifest", f"{3:012d}.json")

    def later(self, data, *parts):
        if self is held and parts[-2:-1] == ("manifest",) and data["version"] == 4:
            other.upsert("x", rows_of(spark, range(12), "after"))
        original(self, data, *parts)

    with monkeypatch.context() as m:
        m.setattr(C.Collections, "_write", later)
        assert held.compact("x") > 0
    assert set(told(held, "x").values()) == {"after"} and held.upsert("x", rows_of(spark, [1], "s"), ("s", 4))
    assert not held.upsert("x", rows_of(spark, [1], "again"), ("s", 4)) and not held.upsert("x", rows_of(spark, [1], "older"), ("s", 3)) and told(held, "x")["1"] == "s"


def vectors(seed, n, size):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, size))
    return (centres[r.integers(0, 20, n)] + 0.7 * r.normal(size=(n, size))).astype(np.float32)


def exact(x, q, k):
    u, v = (m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1)[:, None] for m in (x, q))
    s = np.floor(v @ u.T * 1e6 + 0.5) / 1e6
    return {j: [(int(i), float(s[j, i])) for i in sorted(range(len(x)), key=lambda i: (-s[j, i], i))[:k] if s[j, i] >= 0] for j in range(len(q))}


def test_nearest(spark):
    x = vectors(3, 3000, 24)
    x[700:900] = x[100]  # ties
    points = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(7)
    odd = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [1.0], 1), (9004, [None] + [1.0] * 23, 1), (9005, [float("nan")] * 24, 1), (None, [1.0] * 24, 1), (9006, [], 1)], points.schema)
    both = points.unionByName(odd)
    queries = both.where("vec_id % 60 = 40 or vec_id > 9000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    asked = [i for i in range(3000) if i % 60 == 40]
    want = {asked[j]: hits for j, hits in exact(x, x[asked], 7).items()}
    for per_block in (2000, 20):
        got = {}
        for r in sorted(N.nearest(both, queries.where("query_id <> 9003"), 7, per_block=per_block).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
    one = N.nearest(both, queries.where("query_id = 9003"), 7).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in one] == [(9003, 9003, 1.0)]
    grouped = N.nearest(points, queries.where("query_id = 100"), 4, group="label").collect()
    assert sorted((r.label, r["rank"]) for r in grouped) == [(g, k) for g in range(3) for k in range(1, 5)] and all(r.vec_id % 3 == r.label for r in grouped)
    assert N.nearest(points.limit(0), queries, 3).count() == 0 == N.nearest(points, queries.limit(0), 3).count()


def test_quantised_recall(spark, tmp_path):
    x = vectors(5, 4000, 48)
    held = C.Collections(spark, str(tmp_path))
    held.create("v", 48, v2=True)
    points = spark.createDataFrame([(str(i), v.tolist(), i) for i, v in enumerate(x)], "id string, embedding array<float>, entry_id long")
    held.upsert("v", points)
    queries = points.where("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = {}
    for r in held.search("v", queries, 10, quantised=True).collect():
        found.setdefault(r.query_id, {})[r.entry_id] = r.score
    want = {20 * j: dict(hits) for j, hits in exact(x, x[::20], 10).items()}
    recall = sum(len(found[q].keys() & w.keys()) for q, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.95 and all(abs(found[q][i] - w[i]) < 1e-9 for q, w in want.items() for i in found[q].keys() & w.keys())
    plain = {(r.query_id, r.entry_id, r.score) for r in held.search("v", queries, 10).collect()}
    assert plain == {(q, i, s) for q, w in want.items() for i, s in w.items()}
    codes, how = N.quantised(points, 48, id_col="entry_id")
    row = codes.where("id = 7").first()
    back = how.base + how.step * np.frombuffer(row.code, np.int8)
    unit = x[7].astype(np.float64) / np.linalg.norm(x[7].astype(np.float64))
    assert np.abs(back - np.clip(unit, how.base - 127 * how.step, how.base + 127 * how.step)).max() <= how.step / 2 + 1e-9 and len(row.code) == 48
    held.create("plain", 48)
    with pytest.raises(ValueError):
        held.search("plain", queries, 3, quantised=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_sparse(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "SIZE", 32)
    r = random.Random(seed)
    vector = lambda n, low: {f"t{min(400, int(r.paretovariate(0.7)))}": round(r.uniform(low, 3), 2) for _ in range(n)}
    docs = [(i, vector(r.choice([0, 2, 15, 40]), -0.5)) for i in range(900)] + [(900 + k, docs0) for k, docs0 in enumerate([{"t1": 2.5}] * 50)] + [(5000, None), (None, {"t1": 9.0}), (5001, {"t1": None}), (5002, {"t1": float("inf")})]
    queries = [(i, vector(6, -1)) for i in range(30)] + [(100, {"t1": 1.0}), (101, {"none": 1.0}), (102, None), (103, {"t1": -1.0})]
    want = []
    for q, qv in queries:
        s = sorted((-round(sum(w * (d.get(t) or 0) for t, w in qv.items()), 6), i) for i, d in docs if i is not None and d and qv and i < 5000 and any(t in d for t in qv))
        want += [(q, i, -x, k + 1) for k, (x, i) in enumerate([y for y in s if y[0] < 0][:10])]
    held = P.postings(spark.createDataFrame(docs, "doc_id long, sparse map<string,double>").repartition(3))
    assert held.selectExpr("max(size(ids))").first()[0] < 100
    got = sorted((x.query_id, x.id, x.score, x["rank"]) for x in P.search(held, spark.createDataFrame(queries, "query_id long, sparse map<string,double>"), 10).collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, sorted(want), strict=True))
    empty = P.postings(spark.createDataFrame([], "doc_id long, sparse map<string,double>"))
    assert P.search(empty, spark.createDataFrame(queries, "query_id long, sparse map<string,double>"), 3).count() == 0


def test_files_are_ingested_once(spark, tmp_path):
    held, inbox = C.Collections(spark, str(tmp_path / "store")), tmp_path / "inbox"
    held.create("x", 1)
    inbox.mkdir()
    for k in range(4):
        (inbox / f"f{k}.json").write_text(json.dumps({"n": k % 3}))  # f3 is as f0
    fail = [True]

    def parse(files):
        out = files.select(F.concat(F.lit("p"), F.get_json_object(F.col("content").cast("string"), "$.n")).alias("id"), F.col("path").alias("text"), "file_hash")
        return out.withColumn("text", F.when(F.lit(fail[0]), F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.col("text")))

    def run(checkpoint="check"):
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(inbox))
        ingest_files(files, held, "x", parse, str(tmp_path / checkpoint), "inbox").awaitTermination(60)

    with pytest.raises(Exception, match="half-way"):
        run()
    assert held.points("x").count() == 0 and held.versions("x") == []
    fail[0] = False
    run()
    assert {r.id: Path(r.text).name for r in held.points("x").collect()} == {"p0": "f0.json", "p1": "f1.json", "p2": "f2.json"} and held.versions("x") == [1]
    run("another")  # the checkpoint is lost: the same batch comes again with its number
    assert held.versions("x") == [1]
    (inbox / "g.json").write_text(json.dumps({"n": 1}))  # known content under a new name
    (inbox / "h.json").write_text(json.dumps({"n": 7}))
    run()
    assert {r.id for r in held.points("x").collect()} == {"p0", "p1", "p2", "p7"} and held.versions("x") == [1, 2]
    run()
    assert held.versions("x") == [1, 2]
