"""Graphs, routing, rules, scoring and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query

@query("""WITH p AS (SELECT p_partkey, string_split('Root.' || replace(p_type, ' ', '.'), '.') AS ps FROM part) SELECT prefix, count(*) AS n FROM (SELECT array_to_string(ps[1 : i], '.') AS prefix FROM (SELECT ps, unnest(range(1, len(ps) + 1)) AS i FROM p)) GROUP BY 1""")
def ancestor_prefixes(t):
    p = t.part.select(F.split(F.concat(F.lit("Root."), F.replace("p_type", F.lit(" "), F.lit("."))), r"\.").alias("ps"))
    return p.select("ps", F.explode(F.sequence(F.lit(1), F.size("ps"))).alias("i")).groupBy(F.array_join(F.slice("ps", F.lit(1), F.col("i")), ".").alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'vlm ' || doc_id END, nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), CASE WHEN length(text) > 50 THEN substr(text, 1, 20) END, 'none') AS answer FROM documents")
def priority_coalesce(t):
    d = F.col("doc_id")
    first = F.when(d % 5 == 0, F.concat(F.lit("vlm "), d.cast("string")))
    return t.documents.select("doc_id", F.coalesce(first, F.nullif(F.when(d % 3 == 0, "").otherwise(F.col("lang")), F.lit("")), F.when(F.length("text") > 50, F.substring("text", 1, 20)), F.lit("none")).alias("answer"))


@query("SELECT conv_id, round(0.3 + 0.2 + 0.25 * least(1, count(*) / 6.0) + 0.25 * least(1, count(*) FILTER (role = 'assistant') / 3.0), 5)::DOUBLE AS confidence FROM conversations GROUP BY 1")
def expert_confidence(t):
    one = lambda n, k: F.least(F.lit(1.0), n / float(k))
    c = 0.5 + 0.25 * one(F.count("*"), 6) + 0.25 * one(F.count_if(F.col("role") == "assistant"), 3)
    return t.conversations.groupBy("conv_id").agg(F.round(c, 5).alias("confidence"))


@query("SELECT user_id, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0.5), 5) AS expert, round(coalesce(avg(value) FILTER (event_type = 'signup' AND value > 98), 0.5), 5) AS retriever, len(list(event_id) FILTER (event_type = 'error'))::BIGINT AS errors FROM events GROUP BY 1")
def cascaded_inputs(t):
    v, k = F.col("value"), F.col("event_type")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, v)), F.lit(0.5)), 5)
    out = t.events.groupBy("user_id").agg(mean(k == "purchase").alias("expert"), mean((k == "signup") & (v > 98)).alias("retriever"), F.nullif(F.count_if(k == "error"), F.lit(0)).alias("errors"))
    return out


@query("""WITH a AS (SELECT user_id, avg(value) / 100 AS q, count(*) FILTER (event_type = 'error') AS issues, least(1, count(*) / 50.0) AS cover, least(1, count(DISTINCT event_type) / 5.0) AS kinds FROM events GROUP BY 1),
s AS (SELECT *, greatest(0, least(1, 0.4 * q + 0.3 * cover + 0.3 * kinds - least(0.05 * issues, 0.3))) AS rule FROM a)
SELECT user_id, round(greatest(0, least(1, 0.15 * q + 0.5 * cover + 0.25 * rule + 0.1 * kinds)), 5)::DOUBLE AS confidence, issues = 0 AND rule >= 0.5 AS passed FROM s""")
def cascaded_confidence(t):
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    a = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("q"), F.count_if(F.col("event_type") == "error").alias("issues"), F.least(F.lit(1.0), F.count("*") / 50.0).alias("cover"), F.least(F.lit(1.0), F.count_distinct("event_type") / 5.0).alias("kinds"))
    a = a.withColumn("rule", clamp(F.expr("0.4D * q + 0.3D * cover + 0.3D * kinds - least(0.05D * issues, 0.3D)")))
    return a.select("user_id", F.round(clamp(F.expr("0.15D * q + 0.5D * cover + 0.25D * rule + 0.1D * kinds")), 5).alias("confidence"), ((F.col("issues") == 0) & (F.col("rule") >= 0.5)).alias("passed"))


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, max_by(props, event_id) FILTER (props <> '') AS last_text, max(value) AS top, list(event_id ORDER BY event_id DESC) AS recent, count(*) AS n FROM events GROUP BY 1")
def state_merge(t):
    """Reducers of parallel branches: last wins, last non-empty text, maximum, concatenated lists."""
    lists = F.sort_array(F.collect_list("event_id"), asc=False).alias("recent")
    last_text = F.max_by("props", F.when(F.col("props") != "", F.col("event_id")))
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), last_text.alias("last_text"), F.max("value").alias("top"), lists, F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def last_n_history(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return t.events.withColumn("n", n).where("n <= 10").select("user_id", "event_id")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations")
def previous_row(t):
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("before"))


@query("SELECT user_id, list_sort(list(k || '=' || n)) AS found FROM (SELECT user_id, event_type || '_' || (event_id % 3) AS k, count(*) AS n FROM events GROUP BY 1, 2) WHERE starts_with(k, 'click_') GROUP BY 1")
def map_prefix_collect(t):
    k = F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string"))
    g = t.events.groupBy("user_id", k.alias("k")).agg(F.count("*").alias("n"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    hit = F.map_filter("m", lambda k, v: F.startswith(k, F.lit("click_")))
    return m.select("user_id", F.array_sort(F.transform(F.map_entries(hit), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("found")).where(F.size("found") > 0)


@query("SELECT event_id, (value > 40) OR ((event_type = 'view') AND NOT (user_id > 20)) AS ok FROM events")
def rule_logic_expr(t):
    """An expression over numbered checks, compiled to Catalyst."""
    from tessera.operators.rules import compiled

    checks = [F.col("value") > 40, F.col("event_type") == "view", F.col("user_id") > 20]
    return t.events.select("event_id", compiled("[1] or ([2] and not [3])", checks).alias("ok"))


@query("SELECT n_nationkey, 2::BIGINT AS temperature, CASE WHEN n_nationkey % 2 = 0 THEN 9 ELSE 5 END::BIGINT AS top_k, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END::BIGINT AS extra FROM nation")
def param_overlay(t):
    """Defaults, then the user's values, the last one winning."""
    k = F.col("n_nationkey")
    none = F.create_map().cast("map<string,bigint>")
    user = F.when(k % 2 == 0, F.create_map(F.lit("top_k"), F.lit(9).cast("long"))).otherwise(none)
    extra = F.when(k % 3 == 0, F.create_map(F.lit("extra"), F.col("n_regionkey").cast("long"))).otherwise(none)
    base = F.create_map(F.lit("temperature"), F.lit(2).cast("long"), F.lit("top_k"), F.lit(5).cast("long"))
    over = F.map_concat(user, extra)
    merged = F.map_concat(F.map_filter(base, lambda key, v: ~F.map_contains_key(over, key)), over)
    return t.nation.select("n_nationkey", *[F.try_element_at(merged, F.lit(x)).alias(x) for x in ("temperature", "top_k", "extra")])


@query("SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_nationkey < 8 UNION SELECT r_regionkey FROM region WHERE r_regionkey > 3")
def set_union(t):
    return t.nation.where("n_nationkey < 8").select(F.col("n_regionkey").alias("k")).union(t.region.where("r_regionkey > 3").select("r_regionkey")).distinct()


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT DISTINCT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).exceptAll(t.supplier.where("s_acctbal > 5000").select("s_nationkey").distinct()).distinct()


@query("SELECT conv_id, list(role ORDER BY first, role) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(t):
    """The roles of a conversation in the order in which they first speak; those that begin at one turn by name."""
    g = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return g.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]).alias("roles"))


STATE = """WITH w AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'facts_' WHEN 'click' THEN 'search_results_' WHEN 'purchase' THEN 'confidence_' WHEN 'signup' THEN 'analysis_' ELSE 'routing_metadata_' END || (event_id % 6) AS key,
  CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN '"no list"' ELSE '["f' || event_id || '",' || event_id || ']' END WHEN 'click' THEN '[{"source":"s' || event_id || '"},{"content":"c' || event_id || '"}]'
   WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '"0.9"' ELSE '0.' || (event_id % 7 + 1) END WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '""' ELSE '"answer ' || event_id || '"' END ELSE '{"to":' || event_id % 6 || '}' END AS value FROM events),
c AS (SELECT user_id, key, min(seq) AS place, max_by(value, seq) AS value FROM w GROUP BY 1, 2) """


def state(t):
    """The state of each user's workflow, from events as its writes."""
    from tessera.operators.state import current

    n, kind, s = F.col("event_id"), F.col("event_type"), F.col("event_id").cast("string")
    mod = lambda k: (n % k).cast("string")
    cat = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    key = F.when(kind == "view", "facts_").when(kind == "click", "search_results_").when(kind == "purchase", "confidence_").when(kind == "signup", "analysis_").otherwise("routing_metadata_")
    value = F.when(kind == "view", F.when(n % 5 == 0, '"no list"').otherwise(cat('["f', s, '",', s, "]"))).when(kind == "click", cat('[{"source":"s', s, '"},{"content":"c', s, '"}]'))
    value = value.when(kind == "purchase", F.when(n % 4 == 0, '"0.9"').otherwise(cat("0.", (n % 7 + 1).cast("string")))).when(kind == "signup", F.when(n % 3 == 0, '""').otherwise(cat('"answer ', s, '"'))).otherwise(cat('{"to":', mod(6), "}"))
    return current(t.events.select("user_id", n.alias("seq"), F.concat(key, mod(6)).alias("key"), value.alias("value")), "user_id")


@query(STATE + """, i AS (SELECT user_id, regexp_extract(key, '^(facts|search_results)_', 1) AS kind, place, key, unnest(json_extract(value, '$[*]')) AS item, unnest(range(len(json_extract(value, '$[*]')))) AS k FROM c WHERE regexp_matches(key, '^(facts|search_results)_') AND starts_with(value, '['))
SELECT user_id, kind, row_number() OVER (PARTITION BY user_id, kind ORDER BY place, key, k) - 1 AS at, item::VARCHAR AS item FROM i""")
def state_lists(t):
    """The lists of a workflow's state by their prefixes, joined in the order of their keys."""
    from tessera.operators.state import lists

    return lists(state(t), "user_id")


@query(STATE + """, x AS (SELECT user_id, TRY_CAST(regexp_extract(key, '^confidence_(\\d+)$', 1) AS BIGINT) AS node, CASE WHEN NOT starts_with(value, '"') THEN TRY_CAST(value AS DOUBLE) END AS x FROM c)
SELECT user_id, round(coalesce(avg(x) FILTER (node IN (2, 3)), 0.5), 6) AS retriever, round(coalesce(avg(x) FILTER (node >= 4), 0.5), 6) AS expert FROM x GROUP BY 1""")
def state_confidences(t):
    """Mean confidences of retrievers and experts by the numbers of their nodes."""
    from tessera.operators.state import confidences

    return confidences(state(t), "user_id").select("user_id", F.round("retriever", 6).alias("retriever"), F.round("expert", 6).alias("expert"))


@query(STATE + """, k AS (SELECT user_id, regexp_extract(key, '^(.*)_(\\d+)$', 1) AS kind, regexp_extract(key, '^(.*)_(\\d+)$', 2) AS node, value FROM c),
e AS (SELECT user_id, node, max(value[2:-2]) FILTER (kind = 'analysis') AS answer, max(TRY_CAST(value AS DOUBLE)) FILTER (kind = 'confidence') AS confidence, coalesce(max(CASE WHEN starts_with(value, '[') THEN 2 END) FILTER (kind = 'facts'), 0)::BIGINT AS facts FROM k GROUP BY 1, 2)
SELECT e.*, (SELECT count(*) FROM c WHERE c.user_id = e.user_id AND starts_with(key, 'routing_metadata_')) AS decisions FROM e WHERE answer <> ''""")
def state_experts(t):
    """Each expert's answer, confidence and facts, and how many routers have decided."""
    from tessera.operators.state import decisions, experts

    s = state(t)
    n = decisions(s, "user_id").groupBy("user_id").agg(F.count("*").alias("decisions"))
    e = experts(s, "user_id").select("user_id", "node", "answer", "confidence", "facts")
    return e.join(n, "user_id", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))
