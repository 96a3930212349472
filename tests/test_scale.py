"""What a plan has to look like so that its work grows with the input and is dealt over the cluster."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.operators import records as R
from tessera.operators import schema as S
from tessera.operators import vector as V
from tessera.operators.nearest import similar
from tessera.plans import ast, chunks, code, models, quality, texts, vectors
from tessera.plans.registry import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [code.code, ast.files, ast.twice])
def test_code_is_dealt_over_tasks(spark, sf, rows):
    """The files are made from a small table, which is one task's input."""
    assert rows(Tables(spark, sf)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("check", [R.issues, R.quality, R.splits, R.packages])
def test_records_are_made_once(spark, check):
    files = spark.createDataFrame([("a.mo", "model A\n  Real x;\nend A;")], "path string, code string")
    assert "definitions" not in plan(check(R.records(R.symbols(files, "code", ["path"]), "path"))).lower()


def test_lines_are_read_once(spark):
    lines = spark.createDataFrame([('{"collections": {"ast_record": {"id": "i", "kind": "model", "package_path": ["P"], "code_text": "abc"}}}',), ("{",)], "line string")
    assert "parse" not in plan(R.file_report(lines, "line")).lower()


def test_arrays_are_computed_once(spark):
    """Spark puts filters before a plain inline that compute its array again."""
    codes = spark.createDataFrame([(1, "  Real x(unit=\"m\");\n"), (2, "none"), (3, None)], "k int, code string")
    for found in (E.components, E.variables, E.quantities):
        rows = E.rows_of(codes, ["k"], found(F.col("code")), "name")
        assert [(r.k, r.name) for r in rows.collect()] == [(1, "x")]
        assert plan(rows).count("regexp_extract_all") <= plan(codes.select(found(F.col("code")))).count("regexp_extract_all")


def test_attributes_lex_once(spark, sf):
    assert plan(ast.ast_attributes(Tables(spark, sf))).count("Generate") <= 3  # definitions, the arrays, the maps


def test_schema_values_are_bound(spark):
    """A value's kind is computed once for all of its rules."""
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "required": ["b"]}}}
    rows = spark.createDataFrame([(json.dumps({"a": {"c": 1}}),), (json.dumps({"a": {"b": 1}}),), ("{",)], "raw string")
    out = S.schema_errors(rows, "raw", schema, [])
    assert sorted(map(tuple, out.collect())) == [("$", "JSON_PARSE"), ("a.b", "REQUIRED")]
    kinds = plan(out).lower().replace("_", "").count("schemaofvariant")
    assert kinds <= 4  # of each value, however many rules it has


@pytest.mark.parametrize("rows", [vectors.union_collections, vectors.dedup_first_by_key, vectors.minmax_normalize, models.hashed_search, texts.jaccard_score])
def test_pairs_are_scored_in_batches(spark, sf, rows):
    """No expression goes over the arrays of each pair, and no pair is the row of a join of all with all."""
    said = plan(rows(Tables(spark, sf)))
    assert "zip_with" not in said and "array_intersect" not in said and "Join Cross" not in said


@pytest.mark.parametrize("per_block", [1, 100])
def test_similar(spark, per_block):
    points = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [1.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, "b", [0.0, 0.0]), (5, "b", None), (None, "c", [0.0, 2.0]), (6, "d", [1.0, None])], "vec_id long, label string, embedding array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0]), (9, [0.0, 0.0])], "query_id long, query_vec array<double>")
    got = sorted(map(str, map(tuple, similar(points, queries, ["vec_id", "label"], per_block=per_block).collect())))
    assert got == sorted(map(str, [(7, 1, "a", 1.0), (7, 2, None, 0.707107), (7, None, "c", 0.0), (8, 1, "a", 0.0), (8, 2, None, 0.707107), (8, 3, "b", 0.0), (8, None, "c", 1.0)]))


@pytest.mark.parametrize("small", [1, 100])
def test_jaccard_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(V, "SMALL", small)
    words = [["a", "b"], ["b"], [], None, ["z", "a", "b"]]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, words array<string>")
    got = {(r.query_id, r.doc_id): r.jaccard for r in V.jaccard_pairs(docs, docs.withColumnRenamed("doc_id", "query_id")).collect()}
    want = {(i, j): 0.0 if [] in (q, d) else None if q is None or d is None else len(set(q) & set(d)) / len(set(q) | set(d)) for i, q in enumerate(words) for j, d in enumerate(words)}
    assert got == want


@pytest.mark.parametrize("small", [7, 1000])
def test_jaccard_pairs_of_a_size_stand_together(spark, small, monkeypatch):
    """The result is the square of the documents: tasks hold documents of a range of sizes, so that columns are small."""
    monkeypatch.setattr(V, "SMALL", small)
    rng = np.random.default_rng(5)
    words = {k: [f"w{x}" for x in rng.permutation(60)[: rng.integers(0, 50)]] for k in range(150)}
    docs = spark.createDataFrame(list(words.items()), "doc_id long, words array<string>")
    rows = V.jaccard_pairs(docs, docs.where("doc_id < 37").withColumnRenamed("doc_id", "query_id")).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 37 * 150 and {(r.query_id, r.doc_id): r.jaccard for r in rows} == {(q, d): len(set(words[q]) & set(words[d])) / len(set(words[q]) | set(words[d])) if words[q] and words[d] else 0.0 for q in range(37) for d in words}
    spans = {}
    for r in rows:
        spans.setdefault(r.task, set()).add(len(words[r.doc_id]))
    blocks = len(V._size_blocks([(len(words[q]), 1) for q in range(37)], small))
    assert len(spans) >= 4 and sum(max(x) - min(x) for x in spans.values()) <= 50 * blocks


def test_size_blocks():
    assert V._size_blocks([(3, 2), (1, 4), (2, 1), (9, 12), (10, 1)], 5) == [(1, 2, 0, 1), (3, 3, 0, 1), (9, 9, 0, 3), (9, 9, 1, 3), (9, 9, 2, 3), (10, 10, 0, 1)]


def test_sparse_scores_are_no_rows(spark, sf):
    """Postings aren't joined with queries: a pair of both would be a row for each term that they share."""
    said = plan(vectors.sparse_topk(Tables(spark, sf)))
    assert "MapInArrow" in said and "Join" not in said and "Generate" not in said


@pytest.mark.parametrize("dense, sums", [(2.0, 50), (0.0, 50)])
def test_sparse_either_way(spark, monkeypatch, dense, sums):
    """Products and sums posting by posting give the same; rows of one id are one point, and queries go in two blocks."""
    from tessera.operators import sparse as P

    monkeypatch.setattr(P, "WIDTH", 3)
    monkeypatch.setattr(P, "SUMS", sums)
    monkeypatch.setattr(P, "DENSE", dense)
    at, weights = np.array([0, 2, 1, 0], np.int32), np.array([1.0, 2.0, 3.0, 0.5])
    got = P._scores(at, weights, np.array([0, 2, 3]), np.array([2, 1, 1]), np.array([1, 0, 1, 0]), np.array([4.0, 5.0, 6.0, -1.0]), np.array([0, 1, 3]), np.array([1, 2, 1]), (3, 2))
    assert got.tolist() == [[-0.5, 4.0], [15.0, 18.0], [0.0, 8.0]]
    points = spark.createDataFrame([(1, {"a": 1.0}), (1, {"a": 1.0, "b": 1.0}), (2, {"a": 1.5})], "doc_id long, sparse map<string,double>")
    queries = spark.createDataFrame([(k, {"a": 1.0 + k}) for k in range(4)], "query_id long, sparse map<string,double>")
    found = sorted((r.query_id, r.id, r.score, r["rank"]) for r in P.search(P.postings(points), queries, 1, per_block=2).collect())
    assert found == [(k, 1, 2.0 * (1 + k), 1) for k in range(4)]


@pytest.mark.parametrize("first, per_block", [(0.3, 7), (0.3, 100), (0, 100)])
def test_sparse_blocks_go_by_length(spark, monkeypatch, first, per_block):
    """The longest vectors come first and tell what the others have to reach; results are those of brute force, with ties."""
    from tessera.operators import sparse as P

    for name, value in (("SIZE", 16), ("PART", 4), ("FIRST", first)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(3)
    points = {k: {f"t{x}": float(rng.integers(1, 2 + k % 11)) for x in rng.permutation(30)[: 1 + k % 17]} for k in range(300)}
    df = spark.createDataFrame(list(points.items()), "doc_id long, sparse map<string,double>")
    held = P.postings(df)
    blocks = [r for r in held.orderBy("block").collect()]
    assert len(blocks) >= 10 and all(r.lengths == sorted(r.lengths, reverse=True) and len(r.ids) == len(r.lengths) for r in blocks)
    assert blocks[0].lengths[0] > 2 * blocks[-1].lengths[0] and sorted(i for r in blocks for i in r.ids) == list(points)
    got = P.search(held, df.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id"), 5, per_block=per_block).collect()
    want = []
    for q in range(0, 300, 9):
        scores = sorted((-sum(w * points[q].get(t, 0.0) for t, w in p.items()), k) for k, p in points.items() if points[q].keys() & p.keys())
        want += [(q, k, -x, n + 1) for n, (x, k) in enumerate(scores[:5])]
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got) == sorted(want)


def test_sparse_scores_few_pairs(spark, monkeypatch):
    """Points whose bounds don't reach the best scores so far aren't scored."""
    from tessera.operators import sparse as P

    rng = np.random.default_rng(4)
    points = [(k, {f"t{x}": float(1 + (k < 20) * 9) for x in rng.permutation(200)[: 150 if k < 20 else 8]}) for k in range(2000)]
    held = P.postings(spark.createDataFrame(points, "doc_id long, sparse map<string,double>"), size=100)
    batches = held.orderBy("block").select("ids", "terms", "high", "low", "counts", "at", "weights", "lengths").toArrow().to_batches()
    names = [f"t{x}" for x in range(0, 200, 10)]
    first, scored, score = np.arange(len(names) + 1), [], P._scores
    monkeypatch.setattr(P, "_scores", lambda *a: scored.append(a[-1]) or score(*a))
    asked = type("Held", (), {"value": (np.array([7]), P.pa.array(names), first, np.zeros(len(names), np.int32), np.ones(len(names)), np.full(1, -np.inf))})
    (found,) = P._found(asked, 5)(iter(batches))
    want = sorted((-sum(w for t, w in p.items() if t in names), k) for k, p in points)[:5]
    assert [(-s, i) for s, i in zip(found["score"].to_pylist(), found["id"].to_pylist(), strict=True)] == want
    assert sum(n * m for n, m in scored) < 300  # of 2000 pairs


def test_sparse_blocks_hold_whole_steps():
    from tessera.operators import sparse as P

    assert P._dealt([(2, 250, 10), (-3, 5, 10), (0, 20, 40), (1, 80, 10), (5, 1, P.POSTINGS * 2 + 1), (6, 1, 1)], 100) == [(-3, 0, 1), (0, 0, 1), (1, 1, 1), (2, 2, 3), (5, 5, 3), (6, 8, 1)]


@pytest.mark.parametrize("rows", [quality.payload_gaps, quality.payload_profile, quality.payload_report])
def test_payloads_are_read_once(spark, sf, rows):
    assert "variant_explode" not in plan(rows(Tables(spark, sf))).lower().replace("variantexplode", "variant_explode")


def test_parts_are_held_for_a_few_texts(spark, sf):
    """The parts of a whole Arrow batch aren't put into one array."""
    said = plan(chunks.chunk_lines(Tables(spark, sf)))
    assert "MapInArrow" in said and "ArrowEvalPython" not in said


def test_shuffles_of_rounds_are_released(spark, monkeypatch):
    from tessera.operators import apart

    rounds = []
    monkeypatch.setattr(apart, "released", rounds.append, raising=False)
    rows = spark.createDataFrame([(k, ["a b", "b c"]) for k in range(3)], "k int, g array<string>")
    assert [r.k for r in apart.kept_apart(rows, [], ["k"], "g").collect()] == [0] and rounds


def test_split_outputs_are_made_once(spark, tmp_path):
    from tessera.sources.sinks import write_split_outputs

    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = spark.range(5).select(F.udf(counted, "long")("id").cast("string").alias("id"), F.lit("none").alias("split_strategy"))
    stats = write_split_outputs({"packages": rows}, str(tmp_path))
    assert stats["packages"] == {"rows": 5, "unique_ids": 5, "duplicate_ids": 0, "split": 0} and made.value == 5


def test_split_outputs_go_in_slices(spark, tmp_path, monkeypatch):
    """Records of slices by name are those of one step; outputs are written as gzip files, slice by slice."""
    from tessera.operators import splitting as R
    from tessera.sources.sinks import write_split_outputs

    empty = lambda kind: f"cast(array() as array<{kind}>)"
    item = f"array(struct('x = y;' as str, array('x') as vars, {empty('string')} as ops, 2L as first_line, 2L as last_line))"
    rows = spark.range(40).selectExpr(
        "concat('P', id % 30, if(id < 20, '.A', '')) as fqn", "if(id % 7 = 0, 'function', 'model') as kind", f"if(id < 20, array(concat('P', id + 20)), {empty('string')}) as package_path", "concat('model P', id, '\\n  x = y;', repeat(' ', 60), '\\nend;') as code_text", "1L as first_line", "3L as last_line",
        "'1' as version", f"{empty('struct<name:string, type:string, prefixes:array<string>>')} as components", f"{empty('string')} as extends", f"array(struct('equation' as section_type, 2L as first_line, 2L as last_line, {item} as items)) as equations",
    )
    got = {}
    for size in (1000, 7):
        monkeypatch.setattr(R, "SLICE", size)
        outputs = R.split_outputs(rows)
        assert len(outputs["equations"]) == -(-40 // size)
        stats = write_split_outputs(outputs, str(tmp_path / str(size)))
        files = [p.name for p in (tmp_path / str(size)).glob("ast_*/part-*")]
        assert files and all(f.endswith(".json.gz") for f in files)
        got[size] = (stats, {name: sorted(r.value for r in spark.read.text(str(tmp_path / str(size) / f"ast_{name}.jsonl")).collect()) for name in stats})
    assert got[1000] == got[7] and got[7][0]["equations"]["rows"] > 20


def test_ids_are_counted_by_hash(spark):
    """Unique ids aren't shuffled as they are; those that are there twice, and null ones, are counted as before."""
    from tessera.sources.sinks import id_statistics

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), ("c",)], "id string")
    assert id_statistics(rows) == {"rows": 6, "unique_ids": 3, "duplicate_ids": 3, "split": 0}
    assert id_statistics(rows.limit(0)) == {"rows": 0, "unique_ids": 0, "duplicate_ids": 0, "split": 0}


def test_root_records_are_dealt(spark):
    """Records without a package share one path; counts of functions don't bring them into one task."""
    from tessera.operators import splitting as R

    rows = spark.range(3000).selectExpr("concat('P', id) as fqn", "case when id < 2 then 'function' else 'package' end as kind", "cast(array() as array<string>) as package_path", "concat('package P', id, repeat(' ', 60)) as code_text", "'1' as version", "1L as first_line", "3L as last_line")
    rows = rows.select("*", *[F.array().cast(c).alias(n) for n, c in (("components", "array<struct<name:string, type:string, prefixes:array<string>>>"), ("extends", "array<string>"), ("equations", f"array<struct<{R.BLOCK}>>"))])
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.package_records(rows).select("contained_functions", F.spark_partition_id().alias("p")).groupBy("p", "contained_functions").count().collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r.contained_functions for r in got} == {2} and sum(r["count"] for r in got) == 2998 and max(r["count"] for r in got) < 1500
