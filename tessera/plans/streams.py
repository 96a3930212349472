"""Batch twins of the streaming plans; the same functions take a stream or a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import events as S


def rows(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    return S.tumbling(rows(t)).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - d * INTERVAL 1 DAY) AS start_us, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY 1")
def sliding_counts(t):
    return S.sliding(rows(t)).select(F.unix_micros("start").alias("start_us"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize(t):
    return S.sessions(rows(t), gap="6 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")
