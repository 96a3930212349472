"""Data quality: audits, issues, duplicates, schema rules, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.text import words
from tessera.plans.registry import query


@query("SELECT lang AS kind, count(*) AS n, max(length(text))::BIGINT AS longest, count(*) FILTER (length(text) > 6000) AS over_warn, count(*) FILTER (length(text) > 10000) AS over_max FROM documents GROUP BY 1")
def quality_stats(t):
    n = F.length("text")
    return t.documents.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"), F.max(n).cast("long").alias("longest"), F.count_if(n > 6000).alias("over_warn"), F.count_if(n > 10000).alias("over_max"))


@query("""WITH h AS (SELECT doc_id, text, count(*) OVER (PARTITION BY sha1(text)) AS copies FROM documents),
i AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 20 THEN 'MISSING_CORE' END, CASE WHEN length(text) > 8000 THEN 'OVERSIZE' END, CASE WHEN len(string_split(text, chr(10))) > 60 THEN 'MANY_LINES' END, CASE WHEN copies > 1 THEN 'DUPLICATE_CONTENT' END], lambda x: x IS NOT NULL)) AS code FROM h)
SELECT doc_id, code, CASE WHEN code IN ('MISSING_CORE', 'DUPLICATE_CONTENT') THEN 'error' ELSE 'warning' END AS level FROM i""")
def quality_issues(t):
    """Copies are counted by hash with partial sums, not in a window, so that one common text doesn't fill a task."""
    d = t.documents.select("doc_id", F.sha1("text").alias("h"), F.length("text").alias("n"), F.size(F.split("text", "\n")).alias("lines"))
    d = d.join(d.groupBy("h").agg(F.count("*").alias("copies")), "h")
    rules = [("MISSING_CORE", F.col("n") < 20), ("OVERSIZE", F.col("n") > 8000), ("MANY_LINES", F.col("lines") > 60), ("DUPLICATE_CONTENT", F.col("copies") > 1)]
    out = d.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))).alias("code"))
    return out.withColumn("level", F.when(F.col("code").isin("MISSING_CORE", "DUPLICATE_CONTENT"), "error").otherwise("warning"))


FIELDS = ["text", "lang", "source"]
UNPIVOT = """WITH u AS (SELECT doc_id, unnest([struct_pack(k := 'text', v := CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END), struct_pack(k := 'lang', v := lang), struct_pack(k := 'source', v := CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END)]) AS f FROM documents),
a AS (SELECT doc_id, f.k AS k, f.v AS v FROM u)"""


def fields(t):
    """(doc_id, k, v): the text fields of documents in long form, some of them missing."""
    v = {"text": F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")), "lang": F.col("lang"), "source": F.when(F.col("doc_id") % 3 != 0, F.col("source"))}
    return t.documents.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), v[k].alias("v")) for k in FIELDS])))


def missing(v="v"):
    return F.col(v).isNull() | (F.col(v) == "")


@query(UNPIVOT + "SELECT k, count(*) AS n, round(avg(CASE WHEN v IS NULL OR v = '' THEN 1.0 ELSE 0 END), 5) AS missing_rate FROM a GROUP BY 1")
def audit_missing_rate(t):
    return fields(t).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(F.when(missing(), 1.0).otherwise(0.0)), 5).alias("missing_rate"))


@query(UNPIVOT + ", g AS (SELECT k, v, count(*) AS n FROM a WHERE v <> '' GROUP BY 1, 2) SELECT k, count(*) AS distinct_values, count(*) FILTER (n > 1) AS repeated FROM g GROUP BY 1")
def audit_dup_counts(t):
    g = fields(t).where(~missing()).groupBy("k", F.xxhash64("v").alias("h"), F.sha2("v", 256).alias("s")).agg(F.count("*").alias("n"))
    return g.groupBy("k").agg(F.count("*").alias("distinct_values"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(UNPIVOT + ", g AS (SELECT k, avg(length(v)) AS mean FROM a GROUP BY 1) SELECT max_by(k, (mean, k)) AS k, round(max(mean), 4) AS mean FROM g")
def audit_primary_text(t):
    g = fields(t).groupBy("k").agg(F.avg(F.length("v")).alias("mean"))
    return g.agg(F.max_by("k", F.struct("mean", "k")).alias("k"), F.round(F.max("mean"), 4).alias("mean"))


@query(UNPIVOT + """, g AS (SELECT k, avg(length(v)) AS mean, avg(CASE WHEN v IS NULL OR v = '' THEN 1.0 ELSE 0 END) AS miss, count(v) - count(DISTINCT v) AS dup FROM a GROUP BY 1)
SELECT k, unnest(list_filter([CASE WHEN mean > 2000 THEN 'long_text' END, CASE WHEN dup > 0 THEN 'duplicates' END, CASE WHEN miss > 0.3 THEN 'missing' END], lambda x: x IS NOT NULL)) AS gap FROM g""")
def audit_gaps(t):
    hashed = fields(t).select("k", F.sha2("v", 256).alias("s"), F.length("v").alias("n"), missing().alias("gone"))
    same = hashed.groupBy("k", "s").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.count_if("gone").alias("gone"))  # texts by their hash, so none is shuffled
    g = same.groupBy("k").agg((F.sum("n") / F.sum(F.when(F.col("s").isNotNull(), F.col("c")))).alias("mean"), (F.sum("gone") / F.sum("c")).alias("miss"), (F.sum(F.when(F.col("s").isNotNull(), F.col("c"))) - F.count("s")).alias("dup"))
    rules = [("long_text", F.col("mean") > 2000), ("duplicates", F.col("dup") > 0), ("missing", F.col("miss") > 0.3)]
    return g.select("k", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("gap"))


@query("SELECT min(length(text))::BIGINT AS low, max(length(text))::BIGINT AS high, (sum(length(text)) // count(*))::BIGINT AS mean, count(*) FILTER (length(text) > 10000) AS over FROM documents")
def size_stats(t):
    n = F.length("text")
    return t.documents.agg(F.min(n).cast("long").alias("low"), F.max(n).cast("long").alias("high"), F.floor(F.sum(n) / F.count("*")).alias("mean"), F.count_if(n > 10000).alias("over"))


@query("""WITH j AS (SELECT CASE WHEN event_id % 11 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS line, event_type FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT json_valid(line)) AS errors, max(length(line))::BIGINT AS longest FROM j GROUP BY 1""")
def jsonl_report(t):
    line = F.when(F.col("event_id") % 11 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    j = t.events.select("event_type", line.alias("line"))
    bad = F.expr("try_parse_json(line) is null")
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.max(F.length("line")).cast("long").alias("longest"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) - count(DISTINCT (user_id, event_type)) AS repeats FROM events")
def distinct_counts(t):
    return t.events.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), (F.count("*") - F.count_distinct("user_id", "event_type")).alias("repeats"))


@query("SELECT sig, n FROM (SELECT sha1(concat_ws(chr(31), lang, source, substr(text, 1, 512))) AS sig, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def signature_dups(t):
    sig = F.sha1(F.concat_ws("\x1f", "lang", "source", F.substring("text", 1, 512)))
    return t.documents.groupBy(sig.alias("sig")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_size < 3 THEN 'min' END, CASE WHEN p_size > 45 THEN 'max' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') THEN 'options' END], lambda x: x IS NOT NULL)) AS violation FROM part""")
def threshold_violations(t):
    rules = {"min": F.col("p_size") < 3, "max": F.col("p_size") > 45, "options": ~F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")}
    return t.part.select("p_partkey", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("violation"))


@query("""WITH u AS (SELECT DISTINCT regexp_replace(event_type || '_' || (user_id % 7), '_\\d+$', '') AS k FROM events) SELECT k FROM u WHERE k NOT IN ('view', 'click', 'purchase')""")
def undefined_keys(t):
    used = t.events.select(F.regexp_replace(F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string")), r"_\d+$", "").alias("k")).distinct()
    known = t.spark.createDataFrame([("view",), ("click",), ("purchase",)], "k string")
    return used.join(F.broadcast(known), "k", "left_anti")


@query("SELECT count(*) FILTER (event_type IN ('view', 'purchase')) AS kept, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS skipped FROM events")
def allowed_kind_filter(t):
    ok = F.col("event_type").isin("view", "purchase")
    return t.events.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@query("SELECT o_orderkey, o_custkey || CASE WHEN row_number() OVER w > 1 THEN '#' || (row_number() OVER w - 1) ELSE '' END AS id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def dup_sequence(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return t.orders.select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.when(n > 0, F.concat(F.lit("#"), n.cast("string"))).otherwise("")).alias("id"))


@query("SELECT doc_id, sha1(text) AS s1, sha256(text) AS s256 FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s256"))


@query("SELECT label AS collection, count(*) AS points, min(len(embedding))::BIGINT AS size, count(*) > 0 AS has_data FROM embeddings GROUP BY 1")
def collection_stats(t):
    return t.embeddings.groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("points"), F.min(F.size("embedding")).cast("long").alias("size"), (F.count("*") > 0).alias("has_data"))


@query("SELECT lang, round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))), 4) AS mean_words FROM documents GROUP BY 1")
def word_stats(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg(F.size(words(F.col("text")))), 4).alias("mean_words"))


PAYLOAD = """'{"props": ' || props || ', "fqn": "' || CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END || '", "at": {"user": ' || user_id || ', "deep": {"kind": "' || event_type || '"}}, "list": [1, 2]' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "note": null' END || '}'"""


@query("""WITH l AS (SELECT unnest([{'k': 'props.k', 'v': json_extract_string(props, '$.k'), 't': false}, {'k': 'fqn', 'v': CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, 't': true}, {'k': 'at.user', 'v': user_id::VARCHAR, 't': false}, {'k': 'at.deep.kind', 'v': event_type, 't': true}, {'k': 'list', 'v': '[1,2]', 't': false}]
  || CASE WHEN event_id % 3 = 0 THEN [] ELSE [{'k': 'note', 'v': NULL, 't': false}] END) AS x FROM events), v AS (SELECT x.k AS key, x.v AS v, x.t AS t, count(*) AS c FROM l GROUP BY 1, 2, 3),
e AS (SELECT key, list(v ORDER BY sha256(v))[1:3] AS examples FROM v WHERE v IS NOT NULL GROUP BY 1)
SELECT key, sum(c)::BIGINT AS rows, coalesce(sum(c) FILTER (t), 0)::BIGINT AS texts, round(sum(c * length(v)) FILTER (t) / sum(c) FILTER (t), 5) AS mean_chars, max(length(v)) FILTER (t) AS max_chars,
  round(((SELECT count(*) FROM events) - sum(c) + coalesce(sum(c) FILTER (v IS NULL OR v = ''), 0)) / (SELECT count(*) FROM events), 5)::DOUBLE AS missing, count(v) AS distinct_values, count(v) FILTER (c > 1) AS repeated, coalesce(any_value(examples), []) AS examples
FROM v LEFT JOIN e USING (key) GROUP BY 1""")
def payload_profile(t):
    """Every key of payloads that are JSON texts: how often it is there, its texts, what is missing or repeated, examples."""
    from tessera.operators.profile import profile

    raw = F.expr(PAYLOAD.replace("|| user_id ||", "|| cast(user_id as string) ||"))
    p = profile(t.events.select(raw.alias("raw")), "raw")
    return p.withColumn("mean_chars", F.round("mean_chars", 5)).withColumn("missing", F.round("missing", 5))


@query("""WITH g AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, round(100 * count(*) FILTER (event_id % 3 = 0 OR true) / count(*))::BIGINT AS miss FROM events)
SELECT 'no sparse vector' AS gap, NULL AS key, NULL AS detail UNION ALL SELECT 'duplicates', 'fqn', (SELECT count(*) FROM (SELECT CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS f FROM events GROUP BY 1 HAVING count(*) > 1))::VARCHAR UNION ALL SELECT 'missing', 'note', miss || '%' FROM g""")
def payload_gaps(t):
    """What a collection with such payloads lacks."""
    from tessera.operators.profile import gaps, profile

    raw = F.expr(PAYLOAD.replace("|| user_id ||", "|| cast(user_id as string) ||"))
    return gaps(profile(t.events.select(raw.alias("raw")), "raw"), {"vectors": ["dense"]}, ["fqn", "chunk_id"], ["fqn", "note"])


@query("""WITH d AS (SELECT count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS f FROM events GROUP BY 1 HAVING count(*) > 1))
SELECT '## events' || chr(10) || '- duplicates: `fqn` ' || n || chr(10) || '- missing: `note` 100%' || chr(10) || '- no sparse vector:' AS markdown FROM d""")
def payload_report(t):
    """The gaps of a collection as Markdown."""
    from tessera.operators.profile import report

    return report(payload_gaps(t), "events")
