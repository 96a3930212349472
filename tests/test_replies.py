import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import replies as R
from tessera.operators import state as S
from tessera.operators.rules import targets


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ('x ```json\n{"intent": "find", "confidence": "85%", "optimized_query": "q"}\n``` y', (True, "find", "q", 0.85)),
    ('```\n{"confidence": 1.7}```', (True, None, None, 1.0)), ('{"confidence": "0.25"}', (True, None, None, 0.25)), ('{"intent": "a"}', (True, "a", None, None)),
    ('{"confidence": -3, "intent": "b"} ', (True, "b", None, 0.0)), ('{"confidence": "high"}', None), ('{"confidence": null}', None), ("[1]", None), ("no json", None), ("", None), ('```json\n{"intent": "open"}', (True, "open", None, None)),
    ("y" * 300, None), ('```json {"a": ``` }', None),
])
def test_analysis(spark, text, want):
    assert tuple(one(spark, R.analysis, text)) == (want or (False, "query", text[:200], 0.5))


def test_expertise_and_validation(spark):
    assert one(spark, R.expertise, '```json{"facts": ["a", 1], "gaps": "no list"}```').asDict() == {"analysis": "", "facts": ["a", "1"], "insights": [], "recommendations": [], "gaps": []}
    assert one(spark, R.expertise, "plain " * 300).asDict() == {"analysis": ("plain " * 300)[:1000], "facts": [], "insights": [], "recommendations": [], "gaps": [R.GAP]}
    assert tuple(one(spark, R.validation, 'so {"issues": ["x"], "confidence": 0.4} and {} ok')) == ([], 0.7, R.EVIDENCE)
    assert tuple(one(spark, R.validation, 'so {"issues": ["x"], "confidence": 0.4, "evidence_assessment": "weak"} ok')) == (["x"], 0.4, "weak")
    assert tuple(one(spark, R.validation, "} {")) == ([], 0.7, R.EVIDENCE) and one(spark, R.validation, None).confidence == 0.7
    assert [one(spark, R.in_other_script, t) for t in ("漢字", "漢字の", "カナ漢", "ﾊﾝ漢", "kana", "", None)] == [True, False, False, False, False, False, False]


def test_state(spark):
    writes = [("w", 1, "facts_5", '["a"]'), ("w", 2, "facts_2", '["b", {"x": 1}]'), ("w", 3, "facts_5", '["c"]'), ("w", 4, "facts_9", '"text"'), ("w", 5, "facts_8", "[]"), ("w", 6, "search_results_2", '[{"source": "s", "content": "' + "y" * 120 + '"}, {}]'),
              ("w", 7, "confidence_3", "0.2"), ("w", 8, "confidence_2", "true"), ("w", 9, "confidence_10", "0.9"), ("w", 10, "confidence_x", "0.1"), ("w", 11, "confidence_4", '"0.5"'), ("w", 12, "analysis_10", '"said"'), ("w", 13, "analysis_4", '""'), ("w", 14, "routing_metadata_7", "{}"), ("v", 1, "x", "1"), ("v", 2, None, None)]
    state = S.current(spark.createDataFrame(writes, "by string, seq int, key string, value string"), "by")
    items = S.lists(state, "by")
    assert sorted((r.kind, r.at, json.loads(r.item)) for r in items.where("kind = 'facts'").collect()) == [("facts", 0, "c"), ("facts", 1, "b"), ("facts", 2, {"x": 1})]
    assert sorted(map(tuple, S.citations(items, "by").collect())) == [("w", "cite_0", "s", "y" * 100), ("w", "cite_1", "unknown", "")]
    assert {r.by: (r.retriever, r.expert) for r in S.confidences(state, "by").collect()} == {"w": (0.2, 0.9), "v": (0.5, 0.5)}
    assert [(r.node, r.place) for r in S.decisions(state, "by").collect()] == [("7", 14)]
    assert [(r.node, r.answer, r.confidence, r.facts) for r in S.experts(state, "by").collect()] == [("10", "said", 0.9, 0)]


def test_targets(spark):
    asked = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "empty"), ("c", "none"), ("d", None)], "by string, name string")
    held = spark.createDataFrame([("x", 3), ("y", 1), ("empty", 0), ("z", 9)], "name string, points int")
    got = lambda strict: sorted((r.by, r.name) for r in targets(asked, held, "by", strict).collect())
    assert got(True) == [("a", "x"), ("a", "y")]
    assert got(False) == [("a", "x"), ("a", "y"), ("b", "x"), *[(k, n) for k in "cd" for n in "xyz"]]
