"""Readers, sinks, collections and hooks on small files."""

import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hooks as H
from tessera.operators import schema as S
from tessera.operators import workflow as W
from tessera.sources import files as I
from tessera.sources import sinks as O
from tessera.sources.collections import Collections, rewritten
from tessera.sources.mat import MatSource, read_mat, trajectories


def test_lines_over_splits(spark, tmp_path):
    """A file of many splits: line numbers are those of the file, blank lines counted."""
    lines = [json.dumps({"id": k, "t": "x" * (k % 90)}) if k % 7 else "" for k in range(1, 5001)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('\n{"id": 1, "t": "é"}\nno json')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = I.jsonl(spark, str(tmp_path), "id long, t string").collect()
        assert I.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    a = {r.entry_id: r.data.id for r in got if r.source_file.endswith("a.jsonl")}
    assert a == {k: k for k in range(1, 5001) if k % 7}
    b = {r.entry_id: r.data and r.data.t for r in got if r.source_file.endswith("b.jsonl")}
    assert b[2] == "é" and set(b) == {2, 3} and b[3] is None
    assert "id" in I.jsonl(spark, str(tmp_path / "a.jsonl")).schema["data"].dataType.fieldNames()


def test_json_documents(spark, tmp_path):
    doc = {"document_metadata": {"filename": "f", "k": "doc"}, "chunks": [{"content": " a ", "chunk_metadata": {"k": "own"}}, {"content": " "}, {"chunk_id": "c", "content": "b"}, {}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    (tmp_path / "l.json").write_text('[{"t": "one"}, {"t": "two"}]')
    (tmp_path / "o.json").write_text('{"t": "three"}')
    rows = {r.entry_id: (r.text, r.metadata) for r in I.chunked_json(spark, str(tmp_path / "d.json")).collect()}
    assert rows == {1: ("a", {"filename": "f", "k": "own", "chunk_id": "chunk_0"}), 3: ("b", {"filename": "f", "k": "doc", "chunk_id": "c"})}
    got = sorted((r.entry_id, json.loads(r.raw)["t"]) for r in I.generic_json(spark, str(tmp_path)).collect())
    assert got == [(1, "one"), (1, "three"), (2, "two")]
    (tmp_path / "x.bin").write_bytes(b"\0")
    probe = {r.path[-6:]: (r.kind, r.entries, list(r.fields), len(r.sha256)) for r in I.probe(spark, str(tmp_path)).collect()}
    assert probe == {"d.json": ("json", 4, ["chunks[].content"], 64), "l.json": ("json", 2, [], 64), "o.json": ("json", 1, [], 64), "/x.bin": ("other", 0, [], 64)}
    texts = spark.createDataFrame([("a.jsonl", '{"t": "a long enough text", "u": "short"}\n\n{"u": 1}\n'), ("b.jsonl", "\n{}"), ("c.jsonl", ""), ("e.json", '{"chunks": []}'), ("f.json", "[]")], "path string, text string")
    assert {r.path: (r.entries, list(r.fields)) for r in I.probe_text(texts).collect()} == {"a.jsonl": (3, ["t"]), "b.jsonl": (2, []), "c.jsonl": (0, []), "e.json": (0, ["chunks[].content"]), "f.json": (0, [])}
    df = spark.read.json(spark.createDataFrame([('{"a": {"b": "longer than ten", "c": [{"d": "also longer than ten"}], "n": 3}, "l": ["x"], "s": "' + "y" * 101 + '"}',)], "v string").rdd.map(lambda r: r.v))
    assert sorted(I.long_text_fields(df)) == ["a.b", "a.c[0].d", "s"]
    assert df.select(I.flattened(df.schema).alias("m")).first().m == {"a.b": "longer than ten", "a.n": "3", "_original_structure": "a,l,s"}
    assert {r.name: r.keep for r in I.retained(I.folder(spark, str(tmp_path), "json"), [".mat"]).collect()} == {"d.json": False, "l.json": False, "o.json": False}


def test_series_and_mat(spark, tmp_path):
    (tmp_path / "1_é.csv").write_bytes('"time","größe"\n0.5, 1\n1,x\n'.encode("latin-1"))
    rows = {(r.idx, r.name): r.value for r in I.series(spark, str(tmp_path), "ISO-8859-1").collect()}
    assert rows == {(0, "time"): 0.5, (0, "größe"): 1.0, (1, "time"): 1.0, (1, "größe"): None}

    def matrix(name, m, text=False):
        m = np.asarray(m)
        kind = 51 if text else 0 if m.dtype == np.float64 else 20
        return struct.pack("<5i", kind, *m.shape, 0, len(name) + 1) + name.encode() + b"\0" + m.T.astype("u1" if text else m.dtype).tobytes()

    def chars(strings):
        n = max(map(len, strings))
        return np.array([[ord(c) for c in s.ljust(n)] for s in strings])

    names = ["time", "x", "p"]
    info = np.array([[0, 1, 0, -1], [2, -2, 0, -1], [1, 2, 0, 0]], np.int32)
    one, two = np.array([[0.0, 7.0], [1.0, 7.0]]), np.array([[0.0, 1.0], [0.5, 2.0], [1.0, 3.0]])
    data = matrix("Aclass", chars(["Atrajectory", "1.1", "", "binTrans"]), True) + matrix("name", chars(names).T, True) + matrix("description", chars(["", "", ""]).T, True) + matrix("dataInfo", info.T) + matrix("data_1", one.T) + matrix("data_2", two.T)
    got = {k: v.tolist() for k, v in trajectories(data).items()}
    assert got == {"time": [0.0, 0.5, 1.0], "x": [-1.0, -2.0, -3.0], "p": [7.0, 7.0, 7.0]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "run.mat").write_bytes(data)
    spark.dataSource.register(MatSource)
    both = lambda df: sorted(map(tuple, df.collect()))
    assert both(read_mat(spark, str(tmp_path / "m"), "x|time")) == both(spark.read.format("mat4").option("path", str(tmp_path / "m")).option("names", "x|time").load()) != []
    (tmp_path / "broken.mat").write_bytes(data[:-9])
    with pytest.raises(Exception, match="broken.mat"):
        read_mat(spark, str(tmp_path)).collect()
    rows = spark.read.format("mat4").option("path", str(tmp_path / "m")).option("names", "x|time").load()
    assert sorted(map(tuple, rows.where("idx = 1").collect())) == [("run", "time", 1, 0.5), ("run", "x", 1, -2.0)]


def test_converters(spark, tmp_path):
    for name in ("good", "half", "bad"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())

    def convert(data):
        if data != b"good":
            raise ValueError("broken")
        return "# all"

    def page(data, k):
        if data == b"bad" or k == 1:
            raise ValueError("page")
        return f"page {k}"

    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-8:-4]: (r.markdown, bool(r.error)) for r in I.documents_to_markdown(files, convert, page, lambda d: 3).collect()}
    assert got == {"good": ("# all", False), "half": ("page 0\n\n---\n\npage 2", True), "/bad": (None, True)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n int")
    with pytest.raises(O.DuplicateIds, match="a"):
        O.write_unique_jsonl(rows, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    O.write_unique_jsonl(rows.limit(2), str(tmp_path / "yes"))
    assert spark.read.json(str(tmp_path / "yes")).count() == 2
    with pytest.raises(O.DuplicateIds):
        O.write_split_outputs({"x": rows}, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split" / "stats.json")).first().duplicate_ids == 1


def test_documents_round_trip(spark, tmp_path):
    said = {1: "# a\n\nline\r\n", 2: "", 3: "<!-- document 9 -->\nx", 4: "one\x1etwo"}
    docs = spark.createDataFrame([(k, f"f{k}", v) for k, v in said.items()] + [(None, "none", None)], "document_id long, name string, markdown string")
    O.write_documents(docs, str(tmp_path / "out"), per_file=2)
    assert {r.id: r.markdown for r in O.read_markdown(spark, str(tmp_path / "out")).collect()} == {str(k): v.replace("\x1e", "") for k, v in said.items()} | {"": ""}
    assert {r.name for r in spark.read.json(str(tmp_path / "out" / "json")).collect()} == {"f1", "f2", "f3", "f4", "none"}
    assert not [p for p in (tmp_path / "out" / "markdown").iterdir() if p.is_dir()]


def test_quoted_series(spark, tmp_path):
    for k in (1, 2):  # two folders with a file of one name
        (tmp_path / f"n={k}").mkdir()
        (tmp_path / f"n={k}" / "s.csv").write_text(f'time,"x,y" ,"a ""b"""\n0,"{k}",\n\n"1" , 2.5,"1,5"\n')
    rows = sorted((r.series_id, r.idx, r.name, r.value) for r in I.series(spark, str(tmp_path)).collect() if r.value is not None)
    want = [("s", 0, "time", 0.0), ("s", 0, "x,y", 1.0), ("s", 0, "x,y", 2.0), ("s", 2, "time", 1.0), ("s", 2, "x,y", 2.5)]
    assert rows == sorted([*want, want[0], want[3], want[4]])
    assert {r.name for r in I.series(spark, str(tmp_path)).collect()} == {"time", "x,y", 'a "b"'}


def test_collections(spark, tmp_path):
    held = Collections(spark, str(tmp_path / "root"))
    assert held.names() == [] and not held.has_data("x")
    held.create("x", 2)
    with pytest.raises(ValueError):
        held.create("x", 2)
    points = spark.createDataFrame([("1", [1.0], "a", 1), (None, [1.0], "b", 2), ("1", [2.0], "newer", 5), ("3", None, "c", 3)], "id string, embedding array<float>, text string, entry_id long")
    assert held.upsert("x", points) and held.points("x").count() == 3 and held.has_data("x")
    assert held.upsert("x", points.where("id = '3'").withColumn("text", F.lit("C"))) and not held.upsert("x", points.limit(0))
    assert sorted(r.text for r in held.points("x").collect()) == ["C", "b", "newer"]
    assert json.loads(rewritten('{"a": {"target_collections": {"value": "rag_documents_ast"}}, "b": {"target_collections": ["rag_documents_ast"]}}')[0]) == {"a": {"target_collections": {"value": "rag_documents_ast_packages"}}, "b": {"target_collections": ["rag_documents_ast"]}}
    assert rewritten('{"nodes": [{"config": {"target_collections": ["x"]}}]}')[1] is False


def test_hooks(spark):
    hits = spark.createDataFrame([(1, "q", "text a", 0.5), (2, "q", None, 0.7)], "id int, query string, text string, score double")

    def broken(pairs):
        raise RuntimeError("model")

    assert [(r.id, r.rerank_score, r.reranked) for r in H.reranked(hits, "query", "text", broken).orderBy("id").collect()] == [(1, 0.5, False), (2, 0.7, False)]
    assert [r.rerank_score for r in H.reranked(hits, "query", "text", lambda ps: [len(t) for _, t in ps]).orderBy("id").collect()] == [6.0, 0.0]
    assert [H.encode_batch(b) for b in (2, 64, 500)] == [8, 32, 64]
    v = [r.embedding for r in H.encoded(hits, "text").orderBy("id").collect()]
    assert len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[1])
    prompts = spark.createDataFrame([(1, "slow"), (2, "ok"), (3, "bad"), (4, "done")], "id int, prompt string")

    def model(p):
        if p == "slow":
            time.sleep(3)
        if p == "bad":
            raise RuntimeError
        return p + "!"

    got = {r.id: (r.answer, r.source, r.tries) for r in H.generated(prompts, prompts.where("id = 4"), ["id"], model, lambda p: "plan b" if p == "bad" else model(p), timeout=0.5, tries=2).collect()}
    assert got == {1: (None, "failed", 2), 2: ("ok!", "model", 1), 3: ("plan b", "fallback", 2)}
    images = spark.createDataFrame([("map.png",), ("x.png",)], "path string")
    said = H.captioned(images, lambda p: '{"type": "map", "confidence": 0.8}' if "map" in p else "no idea", lambda p, k: f"a {k}", fits=lambda s: "map" in s, tries=3)
    assert {r.path: (r.type, r.confidence, r.caption, r.tries) for r in said.collect()} == {"map.png": ("map", 0.8, "a map", 1), "x.png": ("natural_image", 0.3, "a natural_image", 3)}
    registry = H.Registry()
    registry.add("first", lambda df: df.limit(1))
    assert registry.apply("first", hits).count() == 1 and registry.described(spark).count() == 1
    for wrong in (lambda: registry.add("first", None), lambda: registry.apply("none", hits), lambda: H.factory({}, "x"), lambda: H.call_tool(spark, {}, "x", {})):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    assert H.factory({"e": lambda mark: lambda p: p + mark}, "e", mark="?")("a") == "a?"
    tool = {"rows": lambda s, folder: s.createDataFrame([(1, folder)], "a int, b string")}
    assert H.tools(tool)[0]["name"] == "rows" and H.call_tool(spark, tool, "rows", {"sf_dir": "d"}) == [{"a": 1, "b": "d"}]


def test_schema_and_guard(spark):
    rows = spark.createDataFrame([(1, "{"), (2, "null"), (3, '{"a": 1, "b": [1, "x"]}'), (4, '{"a": "s", "b": []}')], "id int, raw string")
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "enum": ["s", "t"]}, "b": {"type": "array", "minItems": 1, "items": {"type": "integer", "maximum": 0}}}}
    got = sorted((r.id, r.path, r.code) for r in S.schema_errors(rows, "raw", schema, ["id"]).collect())
    assert got == [(1, "$", "JSON_PARSE"), (2, "$", "TYPE"), (3, "a", "ENUM"), (3, "a", "TYPE"), (3, "b[]", "MAXIMUM"), (3, "b[]", "TYPE"), (4, "b", "MIN_ITEMS")]
    with pytest.raises(ValueError):
        S.violations(F.lit(None), {"oneOf": []})
    old = spark.createDataFrame([('{"thresholds": {}}',)], "raw string")
    with pytest.raises(Exception, match="legacy"):
        S.guarded(old, "raw").collect()
    assert S.guarded(old.select(F.lit('{"node_thresholds": {}, "thresholds": {}}').alias("raw")), "raw").count() == 1
    assert spark.range(1).select(W.holds(F.lit("2"), F.lit("=="), F.lit("2.0")).alias("x")).first().x is True
