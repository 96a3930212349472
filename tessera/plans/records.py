"""Nested records, equations, ids, nested JSON, configuration and ingest rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def nested_path_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("SELECT event_id, unnest(['event.type', 'event.user', 'k', '_original_structure']) AS key, unnest([event_type, user_id::VARCHAR, json_extract_string(props, '$.k'), 'event,k']) AS value FROM events")
def flatten_metadata(t):
    """Dotted keys of scalars up to 100 characters, and the list of top-level keys."""
    m = F.create_map(F.lit("event.type"), "event_type", F.lit("event.user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("_original_structure"), F.lit("event,k"))
    return t.events.select("event_id", F.explode(F.map_filter(m, lambda k, v: v.isNull() | (F.length(v) <= 100))))


EQS = "'x' || p_size || ' = a + b; der(y) = if x > ' || p_size || ' then 1 else 0;  ; z = 2*x;'"


def statements(t):
    src = F.expr(EQS.replace("|| p_size", "|| cast(p_size as string)"))
    return t.part.select("p_partkey", F.filter(F.split(src, r";\s*"), lambda x: F.trim(x) != "").alias("s"))


STATE = f"SELECT p_partkey, list_filter(regexp_split_to_array({EQS}, ';\\s*'), lambda x: trim(x) <> '') AS s FROM part"


@query(f"SELECT p_partkey, len(s)::BIGINT AS n, s[1] AS first FROM ({STATE})")
def split_statements(t):
    return statements(t).select("p_partkey", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"))


VARS = "list_sort(list_distinct(list_filter(regexp_extract_all(eq, '[A-Za-z_]\\w*'), lambda v: NOT list_contains(['if', 'then', 'else', 'der'], v))))"


@query(f"SELECT p_partkey, eq, {VARS} AS vars, list_filter(['der', 'if'], lambda o: contains(eq, o)) AS ops FROM (SELECT p_partkey, unnest(s) AS eq FROM ({STATE}))")
def equation_items(t):
    reserved = F.array(*[F.lit(w) for w in ("if", "then", "else", "der")])
    e = statements(t).select("p_partkey", F.explode("s").alias("eq"))
    names = F.filter(F.regexp_extract_all("eq", F.lit(r"[A-Za-z_]\w*"), 0), lambda v: ~F.array_contains(reserved, v))
    return e.select("p_partkey", "eq", F.array_sort(F.array_distinct(names)).alias("vars"), F.filter(F.array(F.lit("der"), F.lit("if")), lambda o: F.contains("eq", o)).alias("ops"))


@query(f"SELECT p_partkey || '#' || (row_number() OVER (PARTITION BY p_partkey ORDER BY i)) AS id, eq, 'equation' AS kind FROM (SELECT p_partkey, unnest(s) AS eq, unnest(range(len(s))) AS i FROM ({STATE}))")
def explode_equations(t):
    e = statements(t).select("p_partkey", F.posexplode("s").alias("i", "eq"))
    return e.select(F.concat_ws("#", F.col("p_partkey").cast("string"), (F.col("i") + 1).cast("string")).alias("id"), "eq", F.lit("equation").alias("kind"))


@query("SELECT doc_id, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 180) AS short FROM documents")
def collapse_ws(t):
    return t.documents.select("doc_id", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 180).alias("short"))


PAIRS = "'start=' || p_size || ', fixed=true, unit=\"m/s\", nominal= ' || p_partkey"


@query(f"WITH m AS (SELECT p_partkey, {PAIRS} AS s FROM part) SELECT p_partkey, trim(regexp_extract(s, 'start=\\s*([^,]+)', 1)) AS start, trim(regexp_extract(s, 'unit=\\s*\"([^\"]*)\"', 1)) AS unit, trim(regexp_extract(s, 'nominal=\\s*([^,]+)', 1)) AS nominal FROM m")
def parse_kv(t):
    src = F.expr(PAIRS.replace("|| p_size", "|| cast(p_size as string)").replace("|| p_partkey", "|| cast(p_partkey as string)"))
    kv = F.map_from_arrays(F.regexp_extract_all(src, F.lit(r"(\w+)\s*="), 1), F.transform(F.regexp_extract_all(src, F.lit(r"=\s*([^,]+)"), 1), lambda v: F.trim(F.regexp_replace(v, '"', ""))))
    m = t.part.select("p_partkey", kv.alias("m"))
    return m.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("start", "unit", "nominal")])


@query("SELECT p_name || '|' || p_type || '|' || substr(sha1(p_brand), 1, 8) || '|' || p_size || '-' || (p_size + 2) || CASE WHEN p_size > 25 THEN '_part1' ELSE '' END AS id FROM part")
def record_id(t):
    lines = F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") + 2).cast("string"))
    return t.part.select(F.concat(F.concat_ws("|", "p_name", "p_type", F.substring(F.sha1("p_brand"), 1, 8), lines), F.when(F.col("p_size") > 25, "_part1").otherwise("")).alias("id"))


@query("SELECT l_orderkey, count(*) AS components, sum(l_quantity)::DOUBLE AS quantity, len(list_distinct(list(l_returnflag)))::BIGINT AS kinds FROM lineitem GROUP BY 1")
def record_statistics(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("components"), F.sum("l_quantity").alias("quantity"), F.size(F.collect_set("l_returnflag")).cast("long").alias("kinds"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT list_contains(['the', 'of', 'and'], lower(x))))::BIGINT AS n FROM documents")
def filter_identifiers(t):
    reserved = F.array(F.lit("the"), F.lit("of"), F.lit("and"))
    w = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.array_contains(reserved, F.lower(x)))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderkey || '|order' AS id, count(l_orderkey) AS n_components, coalesce(round(sum(l_extendedprice), 2), 0) AS total, coalesce(list_sort(list_distinct(list(l_partkey) FILTER (l_partkey IS NOT NULL))), []) AS uses FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def build_record(t):
    """A nested record of each order with its components, then flattened for comparison."""
    parts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_extendedprice")).alias("components"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    o = t.orders.join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rec = o.select("o_orderkey", F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit("|order")).alias("id"), F.coalesce("components", F.array().cast("array<struct<l_partkey:bigint,l_extendedprice:double>>")).alias("components"), F.coalesce("total", F.lit(0.0)).alias("total")).alias("r"))
    uses = F.array_sort(F.array_distinct(F.transform("r.components", lambda c: c["l_partkey"])))
    return rec.select("o_orderkey", "r.id", F.size("r.components").cast("long").alias("n_components"), "r.total", uses.alias("uses"))


@query("SELECT c, CASE WHEN n_missing = 0 THEN n END AS targets FROM (SELECT label % 3 AS c, count(*) FILTER (len(embedding) = 0) AS n_missing, count(*) AS n FROM embeddings GROUP BY 1)")
def strict_targets(t):
    g = t.embeddings.groupBy((F.col("label") % 3).alias("c")).agg(F.count_if(F.size("embedding") == 0).alias("m"), F.count("*").alias("n"))
    return g.select("c", F.when(F.col("m") == 0, F.col("n")).alias("targets"))


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, ''), nullif(substr(text, 1, 10), ''), 'none') AS q FROM conversations")
def coalesce_nonempty(t):
    return t.conversations.select("conv_id", "turn", F.coalesce(F.nullif(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")), F.lit("")), F.nullif(F.substring("text", 1, 10), F.lit("")), F.lit("none")).alias("q"))


@query("SELECT user_id, list_filter([CASE WHEN avg(value) < 50 THEN 'raise coverage' END, CASE WHEN count(*) FILTER (event_type = 'error') > 12 THEN 'fix errors' END], lambda x: x IS NOT NULL) AS tips FROM events GROUP BY 1")
def suggestion_rules(t):
    rules = F.array_compact(F.array(F.when(F.avg("value") < 50, "raise coverage"), F.when(F.count_if(F.col("event_type") == "error") > 12, "fix errors")))
    return t.events.groupBy("user_id").agg(rules.alias("tips"))


@query("SELECT n_nationkey AS src, n_regionkey AS dst, CASE WHEN n_nationkey % 5 = 0 THEN 'conditional' ELSE 'data' END AS kind FROM nation")
def restore_edge_types(t):
    return t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.when(F.col("n_nationkey") % 5 == 0, "conditional").otherwise("data").alias("kind"))


@query("SELECT string_agg(n || 'x' || k, ' + ' ORDER BY k) AS architecture FROM (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1)")
def architecture_string(t):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit("x"), x["k"])), " + ").alias("architecture"))


@query("""WITH m AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '5, 7' WHEN 2 THEN '1,2,3,4' ELSE '1,x' END AS s FROM nation), l AS (SELECT n_nationkey, list_transform(string_split(s, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS v FROM m)
SELECT n_nationkey, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN NULL WHEN len(v) = 1 THEN [v[1], v[1], v[1], v[1]] WHEN len(v) = 2 THEN [v[1], v[2], v[1], v[2]] WHEN len(v) = 4 THEN v END AS margins FROM l""")
def coerce_margins(t):
    k = F.col("n_nationkey") % 4
    s = F.when(k == 0, "5").when(k == 1, "5, 7").when(k == 2, "1,2,3,4").otherwise("1,x")
    v = F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))
    m = t.nation.select("n_nationkey", v.alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    n = F.size("v")
    out = F.when(F.exists("v", lambda x: x.isNull()), F.lit(None)).when(n == 1, F.array_repeat(at(0), 4)).when(n == 2, F.array(at(0), at(1), at(0), at(1))).when(n == 4, F.col("v"))
    return m.select("n_nationkey", out.alias("margins"))


@query()
def near_duplicates_kept(t):
    """Of each conversation's texts, in turn, those that share less than half of their word pairs with any kept before."""
    from tessera.operators.apart import kept_apart
    from tessera.operators.text import bigrams, words

    rows = t.conversations.select("conv_id", "turn", "role", "text")
    return kept_apart(rows, ["conv_id"], ["turn", "role", "text"], bigrams(words(F.lower("text"))))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest_wins(t):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("n", n).where("n = 1").select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE doc_id >= 500 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 500)")
def ingest_skip_existing(t):
    h = F.sha2("text", 256)
    stored = t.documents.where("doc_id < 500").select(h.alias("h")).distinct()
    return t.documents.where("doc_id >= 500").select("doc_id", h.alias("h")).join(stored, "h", "left_anti").select("doc_id")


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Za-z_][\\p{L}\\p{M}\\p{Nd}_]*(\\.[A-Za-z_][\\p{L}\\p{M}\\p{Nd}_]*)*$') AND NOT list_contains(['if', 'then', 'else', 'elseif', 'end', 'for', 'while', 'loop', 'algorithm', 'in', 'and', 'or'], x)) AS names FROM documents")
def filter_names(t):
    """Tokens that are plain or qualified names and no reserved words."""
    from tessera.functions.extract import names_only

    return t.documents.select("doc_id", names_only(F.split("text", " ")).alias("names"))


@query("""WITH m AS (SELECT page_id, unnest([{'k': 'page.id', 'v': page_id::VARCHAR}, {'k': 'page.at.url', 'v': url}, {'k': 'page.at.short', 'v': substr(html, 1, 100)}, {'k': 'html', 'v': html}, {'k': '_original_structure', 'v': 'page,html,tags'}], recursive := true) FROM pages)
SELECT page_id, k AS key, v AS value FROM m WHERE v IS NULL OR length(v) <= 100""")
def metadata_map(t):
    """The scalars of nested metadata by dotted keys: long texts and lists are left out, the top keys are listed."""
    from tessera.sources.files import flattened

    at = F.struct("url", F.substring("html", 1, 100).alias("short"))
    rows = t.pages.select("page_id", F.struct(F.struct(F.col("page_id").alias("id"), at.alias("at")).alias("page"), "html", F.array(F.lit("x")).alias("tags")).alias("m"))
    return rows.select("page_id", F.explode(flattened(rows.schema["m"].dataType, "m")).alias("key", "value"))
