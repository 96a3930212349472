import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.operators.align import pass_at_k
from tessera.operators.profile import gaps, leaves, profile, report


def flat(value, prefix=""):
    for k, v in value.items():
        if isinstance(v, dict) and prefix.count(".") < 3:
            yield from flat(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def test_profile_against_brute_force(spark):
    r = random.Random(4)

    def make():
        out = {}
        if r.random() < 0.9:
            out["fqn"] = r.choice(["", "A.B", "é" * r.randint(1, 9), None])
        if r.random() < 0.5:
            out["at"] = {"line": r.randint(1, 3), "in": {"file": r.choice(["f", "g"]), "deep": {"deeper": {"x": 1}}}}
        if r.random() < 0.5:
            out["tags"] = [1, "x"]
        if r.random() < 0.3:
            out["content"] = "long " * r.randint(500, 900)
        return out

    docs = [make() for _ in range(300)]
    rows = spark.createDataFrame([(json.dumps(d), "k") for d in docs] + [("no json", "k"), (None, "k"), ("[1]", "k"), ("3", "k")], "raw string, key string")
    total = len(docs) + 4
    seen = defaultdict(list)
    for d in docs:
        for k, v in flat(d):
            seen[k].append(v)
    got = {x.key: x for x in profile(rows, "raw", ["fqn", "nothing"]).collect()}
    assert set(got) == set(seen) | {"nothing"} and (got["nothing"].rows, got["nothing"].missing, got["nothing"].examples) == (0, 1.0, [])
    for k, vs in seen.items():
        texts, said = [v for v in vs if isinstance(v, str)], Counter(json.dumps(v) for v in vs if v is not None)
        x = got[k]
        assert (x.rows, x.texts, x.max_chars) == (len(vs), len(texts), max(map(len, texts), default=None))
        assert x.mean_chars == pytest.approx(sum(map(len, texts)) / len(texts)) if texts else x.mean_chars is None
        assert x.missing == pytest.approx((total - sum(v not in (None, "") for v in vs)) / total)
        assert (x.distinct_values, x.repeated) == (len(said), sum(c > 1 for c in said.values())) and len(x.examples) == min(3, len(said))
    found = {(g.gap, g.key) for g in gaps(profile(rows, "raw"), {"vectors": ["dense"]}, ["fqn"], ["fqn", "content", "tags"]).collect()}
    assert found == {("no sparse vector", None), ("long text", "content"), ("duplicates", "fqn"), ("missing", "fqn"), ("missing", "content"), ("missing", "tags")}
    assert report(gaps(profile(rows, "raw"), {"vectors": ["sparse"]}, [], ["tags"]), "c").first().markdown.startswith("## c\n- long text: `content` 3") and report(gaps(profile(rows, "raw"), {"vectors": ["sparse"]}, [], []).limit(0), "c").first().markdown == "## c"
    assert profile(rows.limit(0), "raw").count() == 0 and leaves(rows, "raw", 1).where("key = 'at'").first().kind == "OBJECT"
    assert [g.gap for g in gaps(profile(rows.limit(0), "raw"), {"vectors": ["sparse"]}, [], []).collect()] == ["no main text"]


def test_sql_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(p, k < c) for p, n, c in ((1, 10, 3), (2, 5, 0), (3, 5, 5), (4, 129, 7)) for k in range(n)], "problem int, ok boolean")
    rows.createOrReplaceTempView("tries")
    said = spark.sql("SELECT problem, pass_at_k(count(*), count_if(ok), 3) AS p FROM tries GROUP BY problem")
    want = {r.problem: r.p for r in rows.groupBy("problem").agg(F.count("*").alias("n"), F.count_if("ok").alias("c")).select("problem", pass_at_k(F.col("n"), F.col("c"), 3).alias("p")).collect()}
    assert {r.problem: r.p for r in said.collect()} == pytest.approx(want)
    assert "partial_count" in said._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in spark.sql("SELECT clamped(2), clamped(-1), round(damped(0), 3)").collect()] == [(1.0, 0.0, 0.45)]
    spark.catalog.dropTempView("tries")
