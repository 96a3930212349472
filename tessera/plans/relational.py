"""Relational breadth: grouping sets, ranks, moving frames, approximate counts, pricing summary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY CUBE (event_type, part)")
def cube_events(t):
    e = t.events.select("event_type", (F.col("user_id") % 3).alias("part"), "value")
    return e.cube("event_type", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT n_name, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(3) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS tile, round(percent_rank() OVER w, 5) AS p FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY length(n_name))")
def rank_functions(t):
    w = Window.partitionBy("n_regionkey").orderBy(F.length("n_name"))
    return t.nation.select("n_name", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(3).over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long").alias("tile"), F.round(F.percent_rank().over(w), 5).alias("p"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 4) AS mean5 FROM events")
def moving_avg(t):
    return t.events.select("event_id", F.round(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)), 4).alias("mean5"))


@query()
def approx_distinct_users(t):
    """A sketch; its estimate has no SQL counterpart."""
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def revenue_by_nation(t):
    li = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = li.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_nationkey").agg(F.sum("v").alias("v")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", F.round("v", 2).alias("revenue"))
