"""Joins: hierarchy, intervals, as-of, containment, lookups, feedback merge, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.operators.containment import contained
from tessera.plans.registry import query


@query("SELECT r_name, list(n_name ORDER BY n_name) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def hierarchy_children(t):
    j = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("children"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey")
def left_join_count_default(t):
    n = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


SPANS = """WITH a AS (SELECT p_partkey AS id, p_size * 40 AS s, p_size * 40 + 25 AS e FROM part),
b AS (SELECT s_suppkey AS child, s_suppkey * 17 AS cs, s_suppkey * 17 + 9 AS ce FROM supplier)"""


def spans(t):
    a = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40).alias("s"), (F.col("p_size") * 40 + 25).alias("e"))
    b = t.supplier.select(F.col("s_suppkey").alias("child"), (F.col("s_suppkey") * 17).alias("cs"), (F.col("s_suppkey") * 17 + 9).alias("ce"))
    return a, b


@query(SPANS + "SELECT id, child, greatest(s, cs)::BIGINT AS first, least(e, ce)::BIGINT AS last FROM a JOIN b ON s <= ce AND e >= cs")
def interval_overlap_join(t):
    a, b = spans(t)
    return A.overlapping(a, b, "s", "e", "cs", "ce", 50).select("id", "child", F.greatest("s", "cs").cast("long").alias("first"), F.least("e", "ce").cast("long").alias("last"))


@query(SPANS + "SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE s <= ce AND e >= cs)")
def interval_anti_join(t):
    a, b = spans(t)
    return A.overlapping(a, b, "s", "e", "cs", "ce", 50, "left_anti").select("id")


@query("""SELECT c.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND v.ts <= c.ts GROUP BY 1""")
def asof_backward(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'click'").drop("event_type")
    return A.asof_backward(left, e.where("event_type = 'view'"), "user_id", "ts", "event_id", "view_id").select("event_id", "view_id")


@query("""SELECT c.event_id, min_by(v.event_id, (abs(epoch_us(v.ts) - epoch_us(c.ts)), v.ts, v.event_id)) AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id GROUP BY 1""")
def asof_nearest(t):
    e = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    left = e.where("event_type = 'click'").drop("event_type")
    return A.asof_nearest(left, e.where("event_type = 'view'"), "user_id", "at", "event_id", "view_id").select("event_id", "view_id")


@query("""WITH l AS (SELECT l_returnflag AS g, unnest([struct_pack(o := 0, name := 'l_tax', y := l_tax), struct_pack(o := 1, name := 'l_discount', y := l_discount), struct_pack(o := 2, name := 'qty', y := l_quantity / 100)]) AS z, l_tax * 1.1 AS x FROM lineitem),
d AS (SELECT g, z.name AS name, z.o AS o, sqrt(sum((x - z.y) ^ 2)) AS dist FROM l GROUP BY 1, 2, 3) SELECT g, min_by(name, (round(dist, 6), o)) AS name, round(min(dist), 4) AS dist FROM d GROUP BY 1""")
def closest_column(t):
    cols = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(n).alias("name"), c.alias("y")) for o, (n, c) in enumerate((("l_tax", F.col("l_tax")), ("l_discount", F.col("l_discount")), ("qty", F.col("l_quantity") / 100)))])
    long = t.lineitem.select(F.col("l_returnflag").alias("g"), (F.col("l_tax") * 1.1).alias("x"), F.inline(cols))
    return A.nearest_column(long, "g", "x", "y", "o").select("g", "name", F.round("dist", 4).alias("dist"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def lookup_left_join(t):
    return t.customer.join(t.nation.where("n_regionkey < 3"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT s_suppkey, coalesce(CASE WHEN n_regionkey = 1 THEN n_nationkey END, 1.0)::DOUBLE AS duration FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def lookup_default(t):
    d = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("double").alias("d"))
    return t.supplier.join(d, F.col("k") == F.col("s_nationkey"), "left").select("s_suppkey", F.coalesce("d", F.lit(1.0)).alias("duration"))


@query("""WITH b AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS ok FROM orders GROUP BY 1),
f AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS fixed FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT b.o_custkey, n, CASE WHEN f.o_custkey IS NULL THEN ok ELSE ok + fixed END AS ok FROM b LEFT JOIN f USING (o_custkey)""")
def feedback_merge(t):
    b = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    f = t.orders.where("o_orderpriority like '1%'").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("fixed"))
    return b.join(f, "o_custkey", "left").select("o_custkey", "n", (F.col("ok") + F.coalesce("fixed", F.lit(0))).alias("ok"))


@query("""WITH c AS (SELECT item_id, text AS code FROM benchmark WHERE text <> ''), d AS (SELECT doc_id, text FROM documents) SELECT doc_id, item_id FROM d JOIN c ON contains(text, code)""")
def containment_join(t):
    """Documents that hold a benchmark item's text as it is, by the items' rarest fingerprints."""
    items = t.benchmark.where("text <> ''").select("item_id", F.col("text").alias("code"))
    return contained(t.documents.select("doc_id", "text"), "text", items, "code").select("doc_id", "item_id")


@query()
def replace_contained(t):
    """Every document with the benchmark items that stand in it cut out once, the longest first."""
    from tessera.operators.splitting import without_parts

    items = t.benchmark.where("text <> ''").select("item_id", F.col("text").alias("code"))
    found = contained(t.documents.select("doc_id", "text"), "text", items, "code").groupBy("doc_id").agg(F.collect_list(F.struct("code", F.col("item_id").cast("string").alias("fqn"))).alias("children"))
    rows = t.documents.select("doc_id", "text").join(found, "doc_id")
    return rows.select("doc_id", without_parts(F.col("text"), F.col("children")).alias("r")).select("doc_id", "r.text", "r.removed")


@query("SELECT count(*) AS orders, sum(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS dangling FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey")
def referential_integrity(t):
    k = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return t.orders.join(k, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count("*").alias("orders"), F.count_if(F.col("l_orderkey").isNull()).alias("dangling"))


@query("SELECT item_id, sha256(b.text) IN (SELECT sha256(text) FROM documents) AS present FROM benchmark b")
def exists_by_hash(t):
    known = t.documents.select(F.sha2("text", 256).alias("h")).distinct().withColumn("present", F.lit(True))
    return t.benchmark.withColumn("h", F.sha2("text", 256)).join(known, "h", "left").select("item_id", F.coalesce("present", F.lit(False)).alias("present"))


@query(r"""SELECT c_custkey, '# ' || c_name || ' ' || CASE WHEN c_nationkey < 20 THEN 'nation ' || c_nationkey ELSE '![a](IMG\N' || c_nationkey || '.png)' END || ' and ' || CASE WHEN c_nationkey < 20 THEN 'nation ' || c_nationkey ELSE '<img class="x" src="img/n' || c_nationkey || '.PNG"/>' END || ' end ![none](other.png)' AS said FROM customer""")
def replace_refs(t):
    """Texts whose image references, in Markdown or HTML, are replaced by the caption of their normalised path; unknown
    ones stay as they are."""
    k = F.col("c_nationkey").cast("string")
    said = F.concat(F.lit("# "), "c_name", F.lit(" ![a](IMG\\N"), k, F.lit('.png) and <img class="x" src="img/n'), k, F.lit('.PNG"/> end ![none](other.png)'))
    captions = t.nation.where("n_nationkey < 20").select(F.concat(F.lit("img/n"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("caption"))
    return A.with_captions(t.customer.select("c_custkey", said.alias("said")), "c_custkey", "said", captions)


RETRIEVERS = """WITH v AS (SELECT vec_id AS node, round(embedding[1]::DOUBLE, 5) AS score FROM embeddings WHERE label < 6), s AS (SELECT vec_id AS node, round(embedding[2]::DOUBLE, 5) AS score FROM embeddings WHERE label > 3)"""


def retrievers(t):
    one = lambda cond, k: t.embeddings.where(cond).select(F.col("vec_id").alias("node"), F.round(F.get("embedding", F.lit(k)).cast("double"), 5).alias(f"score{k}"))
    return one("label < 6", 0), one("label > 3", 1)


@query(RETRIEVERS + "SELECT coalesce(v.node, s.node) AS node, coalesce(s.score, v.score) AS score FROM v FULL JOIN s ON v.node = s.node")
def retriever_or(t):
    v, s = retrievers(t)
    return v.join(s, "node", "full_outer").select("node", F.coalesce("score1", "score0").alias("score"))


@query(RETRIEVERS + "SELECT v.node, s.score FROM v JOIN s ON v.node = s.node")
def retriever_and(t):
    v, s = retrievers(t)
    return v.join(s, "node").select("node", F.col("score1").alias("score"))
