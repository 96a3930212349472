import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import extract
from tessera.operators import align, graph, rules, scanners, text, vector
from tessera.streaming import events as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, text.tokens(lit("Élan_vital, 2nd  naïve!"))) == ["élan_vital", "2nd", "naïve"]
    assert one(spark, text.words(lit("  a  b "))) == ["a", "b"]
    assert one(spark, text.stripped(lit("\t a \n"))) == "a"
    assert one(spark, text.truncated(lit("éééé"), 3)) == "ééé..."
    assert [one(spark, extract.chunk_kind(lit(s))) for s in ("```x```", "$a$", "|a|b|c|d|e|", "plain")] == ["code", "formula", "table", "text"]
    assert one(spark, extract.html_text(lit("<p>a &lt;b&gt;</p><br/> &amp;lt; "))) == "a <b> &lt;"
    assert one(spark, text.bigrams(F.array(lit("a"), lit("b"), lit("a"), lit("b")))) == ["a b", "b a"]
    assert one(spark, text.bigrams(F.array(lit("a")))) == []


@pytest.mark.parametrize("limit", [1, 5, 12, 1000])
def test_packing(spark, limit):
    parts = ["aaa", "", "bb", "cccccccccccccccc", "d", "ee"]
    chunks = one(spark, text.packed(F.array(*[F.lit(p) for p in parts]), limit, "\n"))
    want, cur = [], ""
    for p in parts:
        if cur and len(cur) + len(p) > limit:
            want.append(cur.strip())
            cur = ""
        cur += p + "\n"
    assert chunks == [c for c in [*want, cur.strip()] if c]


def test_vector(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a"), (3, [-1.0, 0.0], None), (4, [0.0, 0.0], None)], "vec_id int, embedding array<float>, k string")
    queries = points.where("vec_id = 1").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = vector.scored(points, queries).select("vec_id", "score").collect()
    assert {r.vec_id: r.score for r in hits} == {1: 1.0, 2: pytest.approx(2**-0.5, abs=1e-6)}
    same = vector.minmax(points.withColumn("s", F.lit(2.0)), "s", ["k"], "n")
    assert {r.n for r in same.collect()} == {0.0}
    assert sorted(r.vec_id for r in vector.first_by_key(points, "k", [F.desc("vec_id")]).collect()) == [2, 3, 4]


def test_pass_at_k(spark):
    for n, c, k in [(5, 0, 1), (5, 5, 1), (10, 3, 5), (4, 3, 2), (129, 7, 8)]:
        want = 0.0 if c == 0 else 1 - math.prod(1 - k / i for i in range(n - c + 1, n + 1)) if n - c >= k else 1.0
        assert one(spark, align.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(want)


def test_asof(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 15), (3, "u", 1), (4, "v", 5)], "id int, by string, t long")
    right = spark.createDataFrame([("u", 5, 50), ("u", 15, 150), ("u", 20, 200), ("u", 15, 149)], "by string, t long, x int")
    back = {r.id: r.got for r in align.asof_backward(left, right, "by", "t", "x", "got").collect()}
    near = {r.id: r.got for r in align.asof_nearest(left, right, "by", "t", "x", "got").collect()}
    assert back == {1: 50, 2: 150, 3: None, 4: None} and near == {1: 50, 2: 149, 3: 50, 4: None}


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 205, 209), (3, 50, 50)], "id int, s int, e int")
    b = spark.createDataFrame([(7, 90, 205), (8, 50, 60)], "k int, cs int, ce int")
    pairs = sorted((r.id, r.k) for r in align.overlapping(a, b, "s", "e", "cs", "ce", 10).collect())
    assert pairs == [(1, 7), (1, 8), (2, 7), (3, 8)]
    assert align.overlapping(a, b.where("k = 8"), "s", "e", "cs", "ce", 10, "left_anti").select("id").collect()[0].id == 2
    nulls = spark.createDataFrame([(None, 50, 50), (1, None, 5), (2, 7, 5), (3, 700, 701), (3, 700, 701), (None, 55, 58)], "id int, s int, e int")
    key = lambda r: -1 if r.id is None else r.id
    assert sorted(map(key, align.overlapping(nulls, b, "s", "e", "cs", "ce", 10, "left_anti").collect())) == [1, 2, 3, 3]
    assert sorted(map(key, align.overlapping(nulls, b, "s", "e", "cs", "ce", 10, "left_semi").collect())) == [-1, -1]


@pytest.mark.parametrize("small, back", [(0, False), (0, True), (300, False)])
def test_single_ways_go_by_doubling(spark, monkeypatch, small, back):
    """A path of 5,000 nodes into a ring, random single ways and loops: rounds are as the logarithm of the longest path."""
    monkeypatch.setattr(graph, "SMALL", small)
    rounds, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (rounds.append(name), kept(df, name))[1])
    r = random.Random(5)
    to = {k: k + 1 for k in range(5000)} | {5000 + k: 5000 + (k + 1) % 40 for k in range(40)} | {10_000 + k: 10_000 + r.randrange(2050) for k in range(2000)} | {20_000: 20_000}
    want = {}
    for k in to:
        seen, at = [], k
        while at in to and at not in seen[:1] and len(seen) <= 2100:
            seen.append(at)
            at = to[at]
        if at == k:
            want[k] = max(seen)
    edges = spark.createDataFrame([(b, a) if back else (a, b) for a, b in to.items()], "src long, dst long")
    got = {x.id: x.cycle for x in graph.on_cycles(edges).collect()}
    assert got == want and len(rounds) <= 2 + 2 * 15


def test_positions_and_captions(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "x long").repartition(5)
    assert {r.x: r.pos for r in align.positions(rows, ["x"], "pos").collect()} == {k: k + 1 for k in range(1000)}
    said = spark.createDataFrame([(1, "a ![x]( 'A\\B.png' ) b <IMG src='c.PNG' w=1> ![](none)"), (2, "none"), (3, "")], "id int, t string")
    caps = spark.createDataFrame([("a/b.png", "one"), (" C.png", "two")], "path string, caption string")
    assert {r.id: r.t for r in align.with_captions(said, "id", "t", caps).collect()} == {1: "a one b two ![](none)", 2: "none", 3: ""}


@pytest.mark.parametrize("small", [0, 100_000])
def test_graph(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    ring = [(100 + k, 100 + (k + 1) % 12) for k in range(12)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (4, 100), (105, 6), (6, 7), (7, 6), *ring], "src int, dst int")
    got = {r.id: r.cycle for r in graph.on_cycles(edges).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 5: 5, 6: 7, 7: 7} | {100 + k: 111 for k in range(12)}
    assert graph.on_cycles(edges.limit(0)).count() == 0
    assert graph.illegal_cycles(edges.withColumn("type", F.when(F.col("src") == 4, "feedback").otherwise("data"))).count() == 0
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    both = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert sorted(map(tuple, graph.endpoints(nodes, both).collect())) == [(1, "start"), (2, "end")]


def test_rules(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, rules.compiled("", [])) is True and one(spark, rules.compiled("", [t, n])) is False
    assert one(spark, rules.compiled("[1] and not ([2] or [3])", [t, f, n])) is True
    for bad in ("[4]", "[1] or", "([1]", "x", "[1] [2]"):
        with pytest.raises(ValueError):
            rules.compiled(bad, [t, f, n])


def test_scanners():
    assert scanners.split_nested('a(x=1,y={2,3}), b[2,3] ,, c="p,q"') == ["a(x=1,y={2,3})", "b[2,3]", 'c="p,q"']
    assert scanners.split_nested(None) == []
    found = scanners.symbols_of("within L.P;\npackage A\n model B\n end B;\nend A;\n")
    assert found == [("package", "A", "L.P.A", 2, 5), ("model", "B", "L.P.A.B", 3, 4)]


def test_streams(spark, sf, tmp_path):
    events = S.read_events(spark, sf)
    q = S.tumbling(events).writeStream.format("memory").queryName("tumbling_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = S.tumbling(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    closed = spark.table("tumbling_out")
    assert 0 < closed.count() <= batch.count() and closed.exceptAll(batch).count() == 0
    q = S.history(events).writeStream.format("memory").queryName("history_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    got = {r.user_id: r.recent for r in spark.table("history_out").collect()}
    assert got == {u: sorted(ids)[-10:] for u, ids in want.items()}
    for name, plan in (("sliding", S.sliding), ("sessions", S.sessions)):
        plan(events).writeStream.format("memory").queryName(f"{name}_out").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        batch = plan(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
        closed = spark.table(f"{name}_out")
        assert 0 < closed.count() <= batch.count() and closed.exceptAll(batch).count() == 0
    for _ in range(2):
        S.ingest_once(events.select("user_id"), str(tmp_path / "store"), str(tmp_path / "cp"), "user_id").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == len(want)


def test_state_and_listener(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    said = []
    listener = S.Progress(lambda event, facts: said.append((event, facts.get("rows"))))
    spark.streams.addListener(listener)
    try:
        q = S.history_with_state(S.read_events(spark, sf).select("user_id", "event_id"), 3).writeStream.format("memory").queryName("state_out").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        want.setdefault(r.user_id, []).append(r.event_id)
    assert {r.user_id: r.recent for r in spark.table("state_out").collect()} == {u: sorted(ids)[-3:] for u, ids in want.items()}
    for _ in range(50):
        if ("ended", None) in said:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert said[0][0] == "started" and ("ended", None) in said and sum(n or 0 for e, n in said if e == "progress") == sum(map(len, want.values()))
