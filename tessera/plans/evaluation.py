"""Evaluation: funnels, pass@k, errors of aligned series, classification and merging of results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.plans.registry import query


@query("""SELECT coalesce(o_orderpriority, 'total') AS k, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS loaded, count(*) FILTER (o_orderstatus = 'F') AS checked, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS simulated
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def funnel_rollup(t):
    s = F.col("o_orderstatus")
    out = t.orders.rollup("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s != "P").alias("loaded"), F.count_if(s == "F").alias("checked"), F.count_if((s == "F") & (F.col("o_totalprice") > 100000)).alias("simulated"))
    return out.select(F.coalesce("o_orderpriority", F.lit("total")).alias("k"), "n", "loaded", "checked", "simulated")


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1)
SELECT o_custkey, round(CASE WHEN c = 0 THEN 0 WHEN n - c < 5 THEN 1 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - c + 1, n + 1), lambda i: 1 - 5.0::DOUBLE / i)), lambda a, b: a * b) END, 6)::DOUBLE AS pass5 FROM p""")
def pass_at_k(t):
    p = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return p.select("o_custkey", F.round(A.pass_at_k(F.col("n"), F.col("c"), 5), 6).alias("pass5"))


@query("SELECT l_returnflag, round(avg((l_tax - l_discount) ^ 2), 8) AS mse FROM lineitem GROUP BY 1")
def mse_pairs(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(F.pow(F.col("l_tax") - F.col("l_discount"), 2)), 8).alias("mse"))


@query("""WITH m AS (SELECT l_suppkey, l_partkey % 5 AS run, avg((l_tax - l_discount) ^ 2) AS mse FROM lineitem GROUP BY 1, 2), c AS (SELECT l_suppkey, count(*) FILTER (round(mse, 9) <= 0.0018) AS passed FROM m GROUP BY 1)
SELECT s_suppkey, coalesce(passed, 0)::BIGINT AS passed FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey""")
def functional_pass_count(t):
    m = t.lineitem.groupBy("l_suppkey", (F.col("l_partkey") % 5).alias("run")).agg(F.avg(F.pow(F.col("l_tax") - F.col("l_discount"), 2)).alias("mse"))
    c = m.groupBy("l_suppkey").agg(F.count_if(F.round("mse", 9) <= 0.0018).alias("passed"))
    return t.supplier.join(c, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("passed", F.lit(0)).alias("passed"))


@query("""WITH f AS (SELECT 'model_' || (o_orderkey % 40) || '_response_' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.bak' ELSE '.txt' END AS name FROM orders)
SELECT regexp_extract(name, '^(model_\\d+)_response_\\d+\\.txt$', 1) AS k, count(*) AS n FROM f WHERE regexp_matches(name, '^(model_\\d+)_response_\\d+\\.txt$') GROUP BY 1""")
def count_by_filename_key(t):
    name = F.concat(F.lit("model_"), (F.col("o_orderkey") % 40).cast("string"), F.lit("_response_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".bak").otherwise(".txt"))
    k = F.regexp_extract(name, r"^(model_\d+)_response_\d+\.txt$", 1)
    return t.orders.select(k.alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 200 > 84 THEN '3.2.3' WHEN o_orderkey % 2 = 1 AND o_orderkey % 200 > 109 THEN '3.2.3' ELSE '4.0.0' END AS version FROM orders")
def version_bucket(t):
    n, even = F.col("o_orderkey") % 200, F.col("o_orderkey") % 2 == 0
    return t.orders.select("o_orderkey", F.when((even & (n > 84)) | (~even & (n > 109)), "3.2.3").otherwise("4.0.0").alias("version"))


@query("SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT), c_name) AS pos FROM customer")
def natural_sort(t):
    """Every name with its place in the order of the number in it."""
    rows = t.customer.select("c_name", F.regexp_extract("c_name", r"(\d+)", 1).cast("long").alias("n"))
    return A.positions(rows, ["n", "c_name"], "pos").select("c_name", "pos")


@query("""WITH p AS (SELECT o_orderpriority, o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1, 2),
v AS (SELECT o_orderpriority, CASE WHEN c = 0 THEN 0 WHEN n - c < 1 THEN 1 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - c + 1, n + 1), lambda i: 1 - 1.0::DOUBLE / i)), lambda a, b: a * b) END AS x FROM p)
SELECT o_orderpriority, round(avg(x), 6)::DOUBLE AS mean_pass1, count(*) AS problems FROM v GROUP BY 1""")
def pass_at_k_mean(t):
    """The mean over all problems of a mode."""
    p = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    return p.groupBy("o_orderpriority").agg(F.round(F.avg(A.pass_at_k(F.col("n"), F.col("c"), 1)), 6).alias("mean_pass1"), F.count("*").alias("problems"))


@query("""WITH b AS (SELECT 'model_' || (o_custkey % 50) AS k, count(*) AS simulated FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), x AS (SELECT 'model_' || (c_custkey % 60) AS k, count(*) AS txt_files FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT b.k, simulated, txt_files FROM b LEFT JOIN x USING (k)""")
def counts_into_summary(t):
    """Response counts beside the results of each model; a model without responses keeps its results only."""
    key = lambda c, n: F.concat(F.lit("model_"), (F.col(c) % n).cast("string"))
    b = t.orders.where("o_orderstatus = 'F'").groupBy(key("o_custkey", 50).alias("k")).agg(F.count("*").alias("simulated"))
    x = t.customer.where("c_acctbal > 0").groupBy(key("c_custkey", 60).alias("k")).agg(F.count("*").alias("txt_files"))
    return b.join(x, "k", "left")


@query("SELECT o_orderkey, coalesce(p_name, '') AS instruction FROM orders LEFT JOIN part ON p_partkey = CAST(regexp_extract('model_' || o_custkey % 3000 || '_response_' || o_orderkey, '\\d+') AS BIGINT)")
def prompt_by_number(t):
    """The instruction whose id is the first number of a file's name; none is the empty text."""
    name = F.concat(F.lit("model_"), (F.col("o_custkey") % 3000).cast("string"), F.lit("_response_"), F.col("o_orderkey").cast("string"))
    return A.by_first_number(t.orders.select("o_orderkey", name.alias("name")), "name", t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("instruction")), "id").select("o_orderkey", F.coalesce("instruction", F.lit("")).alias("instruction"))


@query("""WITH r AS (SELECT p_partkey % 97 AS n, min(p_partkey % 97 || '_' || p_brand || '.csv') AS csv FROM part WHERE p_partkey % 97 > 0 GROUP BY 1), f AS (SELECT l_orderkey, l_linenumber, l_partkey % 130 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, csv FROM f LEFT JOIN r USING (n)""")
def reference_by_prefix(t):
    """The reference series of a model's number: the first file name that begins with the number and an underscore."""
    csv = F.concat((F.col("p_partkey") % 97).cast("string"), F.lit("_"), "p_brand", F.lit(".csv"))
    files = t.part.where("p_partkey % 97 > 0").select(csv.alias("csv"))
    models = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("model_"), (F.col("l_partkey") % 130).cast("string"), F.lit("_")).alias("folder"))
    return A.by_number_prefix(models, "folder", r"^model_(\d+)_", files, "csv").select("l_orderkey", "l_linenumber", "csv")


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, l_quantity AS y, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), g AS (SELECT DISTINCT l_orderkey, n, unnest([0, 1, 2, 3, 4]) AS j FROM s WHERE n > 1),
p AS (SELECT *, j * (n - 1) / 4.0::DOUBLE AS x FROM g)
SELECT p.l_orderkey, j::BIGINT AS j, round(a.y + (x - floor(x)) * (b.y - a.y), 5) AS y FROM p JOIN s a ON a.l_orderkey = p.l_orderkey AND a.i = floor(x) JOIN s b ON b.l_orderkey = p.l_orderkey AND b.i = least(floor(x) + 1, p.n - 1)""")
def interpolate(t):
    """Each order's quantities, linearly interpolated to five points; the series stays inside its own row."""
    ys = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"])
    s = t.lineitem.groupBy("l_orderkey").agg(ys.alias("ys")).where(F.size("ys") > 1)
    x = s.select("l_orderkey", "ys", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).withColumn("x", F.col("j") * (F.size("ys") - 1) / F.lit(4.0))
    low = F.floor("x").cast("int")
    a, b = F.get("ys", low), F.get("ys", F.least(low + 1, F.size("ys") - 1))
    return x.select("l_orderkey", F.col("j").cast("long"), F.round(a + (F.col("x") - F.floor("x")) * (b - a), 5).alias("y"))


@query("""SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND value > 10 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 95)""")
def feedback_candidates(t):
    out = t.events.where("event_type = 'signup' and value > 95").select("user_id").distinct()
    return t.events.where("event_type in ('error', 'purchase') and value > 10").join(out, "user_id", "left_anti").select("event_id")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1)
SELECT o_custkey, round(CASE WHEN c = 0 THEN 0 WHEN n - c < 3 THEN 1 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0 / i)) END, 6)::DOUBLE AS p FROM g""")
def pass_at_k_sql(t):
    """pass@3 by its SQL function, over counts that are summed in parts."""
    from tessera.functions import sql

    sql.register(t.spark)
    p = t.spark.sql("SELECT o_custkey, pass_at_k(count(*), count_if(o_orderstatus = 'F'), 3) AS p FROM {orders} GROUP BY o_custkey", orders=t.orders)
    return p.withColumn("p", F.round("p", 6))


@query("""WITH b AS (SELECT min(floor(epoch(ts)))::BIGINT AS lo, max(floor(epoch(ts)))::BIGINT AS hi FROM events),
e AS (SELECT user_id AS m, event_type AS r, floor(epoch(ts))::BIGINT::DOUBLE AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, 0.3 * (floor(epoch(ts))::BIGINT - lo) / (hi - lo)::DOUBLE AS x FROM events, b),
f AS (SELECT * FROM e WHERE r = 'view'), v AS (SELECT * FROM e WHERE r <> 'view'),
s AS (SELECT m, r, nr, nv FROM (SELECT m, r, count(*) AS nv FROM v GROUP BY 1, 2) JOIN (SELECT m, count(*) AS nr FROM f GROUP BY 1) USING (m)),
p AS (SELECT f.m, s.r, min_by(v.x, (abs(v.t - f.t), v.idx)) AS x, any_value(f.x) AS want FROM s JOIN f USING (m) JOIN v ON v.m = s.m AND v.r = s.r WHERE nr < nv GROUP BY f.m, s.r, f.idx
 UNION ALL SELECT v.m, s.r, any_value(v.x), min_by(f.x, (abs(v.t - f.t), f.idx)) FROM s JOIN v ON v.m = s.m AND v.r = s.r JOIN f ON f.m = s.m WHERE nr > nv GROUP BY v.m, s.r, v.idx
 UNION ALL SELECT f.m, s.r, v.x, f.x FROM s JOIN f USING (m) JOIN v ON v.m = s.m AND v.r = s.r AND v.idx = f.idx WHERE nr = nv),
c AS (SELECT m, r, least(avg((x + m % 5 * 0.01 - want) ^ 2), avg((1 - x - want) ^ 2)) AS mse FROM p GROUP BY 1, 2)
SELECT u.m AS model, count(*) FILTER (mse <= 0.001) AS passed FROM (SELECT DISTINCT user_id AS m FROM events) u LEFT JOIN c USING (m) GROUP BY 1""")
def functional_passes(t):
    """Series of different lengths, aligned in time: how many of a model's runs come within the limit of its reference by
    their nearest column."""
    from tessera.operators.series import passes

    e = t.events.select(F.col("user_id").alias("model"), F.col("event_type").alias("run"), "ts", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"))
    w = Window.partitionBy("model", "run").orderBy("ts", "event_id")
    span = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    e = e.withColumn("idx", F.row_number().over(w) - 1).join(F.broadcast(span)).withColumn("x", 0.3 * (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")))  # one row
    columns = F.array(F.struct(F.lit(1).alias("o"), F.lit("near").alias("name"), (F.col("x") + F.col("model") % 5 * 0.01).alias("value")), F.struct(F.lit(2).alias("o"), F.lit("far").alias("name"), (1 - F.col("x")).alias("value")))
    reference = e.where("run = 'view'").select("model", "idx", "t", F.col("x").alias("value"))
    return passes(e.select("model"), reference, e.where("run <> 'view'").select("model", "run", "idx", "t", F.inline(columns)))
