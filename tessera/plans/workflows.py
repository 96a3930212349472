"""Workflow queries: agent graphs from tables, connection rules, routing, rule checks, logs and configuration errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import schema as S
from tessera.operators import workflow as W
from tessera.plans.registry import query

#: Customers are the nodes; each has an edge to the customer whose number its dearest order points at, if there is one.
EDGES = """e AS (SELECT o_custkey AS src, 1 + max_by(o_orderkey, (o_totalprice, o_orderkey)) * 7 % (SELECT count(*) + 20 FROM customer) AS dst, CASE WHEN max_by(o_orderpriority, (o_totalprice, o_orderkey)) LIKE '1%' THEN 'merge_flow' ELSE 'data_flow' END AS type FROM orders GROUP BY 1),
n AS (SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'analyzer' WHEN 1 THEN 'retriever' WHEN 2 THEN 'router' ELSE 'validator' END AS type FROM customer)"""


def edges(t):
    best = F.struct("o_totalprice", "o_orderkey")
    o = t.orders.groupBy(F.col("o_custkey").alias("src")).agg(F.max_by("o_orderkey", best).alias("k"), F.max_by("o_orderpriority", best).alias("p"))
    n = t.customer.agg((F.count("*") + 20).alias("n"))
    e = o.crossJoin(n)  # one row
    return e.select("src", (F.col("k") * 7 % F.col("n") + 1).alias("dst"), F.when(F.col("p").like("1%"), "merge_flow").otherwise("data_flow").alias("type"))


def nodes(t):
    k = F.col("c_nationkey") % 4
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(k == 0, "analyzer").when(k == 1, "retriever").when(k == 2, "router").otherwise("validator").alias("type"))


@query(f"WITH RECURSIVE {EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a AS id, max(b) AS cycle FROM r WHERE a IN (SELECT b FROM r q WHERE q.a = r.a) AND EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = r.a) GROUP BY 1")
def cycle_detect(t):
    """Nodes on cycles of any length, with the largest id of the cycle; no edge is a feedback one, so all are illegal."""
    return G.illegal_cycles(edges(t))


@query(f"WITH {EDGES} SELECT src, dst, type FROM e WHERE dst NOT IN (SELECT id FROM n)")
def dangling_edges(t):
    return G.dangling(edges(t), nodes(t)).select("src", "dst", "type")


@query(f"WITH {EDGES} SELECT id, 'start' AS kind FROM n WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT id, 'end' FROM n WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT min(id), 'start' FROM n HAVING (SELECT count(*) FROM n WHERE id NOT IN (SELECT dst FROM e)) = 0 UNION ALL SELECT max(id), 'end' FROM n HAVING (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e)) = 0")
def graph_endpoints(t):
    return G.endpoints(nodes(t), edges(t))


@query(f"""WITH {EDGES}, f AS (SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)), l AS (SELECT id FROM n WHERE type <> 'router' AND id NOT IN (SELECT src FROM e))
SELECT src::VARCHAR AS "from", dst::VARCHAR AS "to", CASE WHEN src IN (SELECT id FROM n WHERE type = 'router') THEN 'conditional' ELSE 'data' END AS kind FROM (SELECT DISTINCT src, dst FROM e)
UNION ALL SELECT 'START', id::VARCHAR, 'start' FROM f UNION ALL SELECT id::VARCHAR, 'END', 'end' FROM l
UNION ALL SELECT 'START', min(id)::VARCHAR, 'start' FROM n HAVING (SELECT count(*) FROM f) = 0 UNION ALL SELECT max(id)::VARCHAR, 'END', 'end' FROM n HAVING (SELECT count(*) FROM l) = 0""")
def graph_compile(t):
    return W.compiled_graph(nodes(t), edges(t).select(F.col("src").alias("from"), F.col("dst").alias("to")))


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM n) AS total_nodes, count(*) AS total_connections, list_sort(list_distinct(list(type))) AS line_types_used, count(*) FILTER (type IN ('feedback', 'feedback_flow')) AS feedback_loops FROM e")
def workflow_stats(t):
    return W.workflow_statistics(nodes(t), edges(t).select(F.col("src").alias("from"), F.col("dst").alias("to"), "type"))


#: Who may send to whom, by which lines; r_name stands for nobody, so it is an unknown agent.
OUTS = [("analyzer", "retriever", ["data_flow"]), ("analyzer", "router", ["data_flow"]), ("retriever", "validator", ["data_flow", "merge_flow"]), ("retriever", "router", ["data_flow"]), ("router", "analyzer", ["conditional_flow"]), ("router", "retriever", ["merge_flow"]), ("validator", "analyzer", ["feedback_flow"])]
INS = [("retriever", "analyzer", ["data_flow"]), ("retriever", "router", ["conditional_flow"]), ("analyzer", "validator", ["feedback_flow"]), ("validator", "retriever", ["data_flow"]), ("analyzer", "router", ["conditional_flow"])]
RULE_SQL = ", ".join(f"{n}(agent, other, line_types) AS (VALUES " + ", ".join(f"('{a}', '{b}', {v})" for a, b, v in rows) + ")" for n, rows in (("o", OUTS), ("i", INS)))


def rules(t):
    schema = "agent string, other string, line_types array<string>"
    return t.spark.createDataFrame(OUTS, schema), t.spark.createDataFrame(INS, schema)


@query(f"""WITH {EDGES}, {RULE_SQL}, x AS (SELECT a.type AS f, coalesce(b.type, 'nobody') AS t, e.type FROM e JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst), p AS (SELECT DISTINCT f, t FROM x),
k AS (SELECT p.f, p.t, o.line_types AS outs, i.line_types AS ins, p.t IN (SELECT agent FROM i) AS restricted, (SELECT count(*) FROM x WHERE x.f = p.f AND x.t = p.t) AS there, p.f IN (SELECT agent FROM o) AS fk, p.t IN (SELECT agent FROM o) AS tk FROM p LEFT JOIN o ON o.agent = p.f AND o.other = p.t LEFT JOIN i ON i.agent = p.t AND i.other = p.f),
v AS (SELECT *, list_sort(CASE WHEN ins IS NULL THEN outs ELSE list_intersect(outs, ins) END) AS ty FROM k),
z AS (SELECT *, CASE WHEN NOT fk THEN 'unknown sender' WHEN NOT tk THEN 'unknown receiver' WHEN f = t THEN 'self connection' WHEN outs IS NULL THEN 'sender does not allow it' WHEN restricted AND ins IS NULL THEN 'receiver does not allow it' WHEN len(ty) = 0 THEN 'no common line type' END AS error FROM v)
SELECT f AS "from", t AS "to", error IS NULL AS valid, error, CASE WHEN error IS NULL THEN ty ELSE [] END AS line_types, error IS NULL AND len(ty) = 1 AS auto_select, CASE WHEN error IS NULL AND there > 0 THEN ['connection exists'] ELSE [] END AS warnings FROM z""")
def connection_rules(t):
    """Every pair of agent types that the graph connects, against the senders' outputs and the receivers' inputs."""
    n = nodes(t)
    x = edges(t).join(n.select(F.col("id").alias("src"), F.col("type").alias("from")), "src").join(n.select(F.col("id").alias("dst"), F.col("type").alias("to")), "dst", "left")
    x = x.select("from", F.coalesce("to", F.lit("nobody")).alias("to"), "type")
    out, inp = rules(t)
    return W.connection_checks(x.select("from", "to").distinct(), out, inp, x)


@query(f"WITH {EDGES}, {RULE_SQL} SELECT DISTINCT o.agent, o.other, o.line_types FROM o JOIN n ON n.type = o.agent")
def suggest_connections(t):
    return W.suggestions(rules(t)[0], nodes(t).select(F.col("type").alias("agent")).distinct())


ROUTES = """SELECT n_nationkey::BIGINT AS "from", NULL::BIGINT AS "to" FROM nation WHERE false"""


@query("""SELECT n_nationkey AS "from", n_regionkey::BIGINT AS "to", NULL AS condition, -1 AS seq FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT n_nationkey, n_regionkey::BIGINT, 'high', 0 FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, (n_regionkey + 1)::BIGINT, 'low', 1 FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, 7, 'default', 1000 FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, 9, 'max_iterations_exceeded', 1001 FROM nation WHERE n_nationkey % 10 = 0""")
def expand_router_edges(t):
    """Plain edges, and those of routers: conditions in order, the default, the one for too many iterations."""
    k = F.col("n_nationkey")
    target = lambda c: F.concat(F.lit("node_"), c.cast("string"))
    conditions = F.array(F.struct(F.lit("high").alias("name"), target(F.col("n_regionkey")).alias("target")), F.struct(F.lit("low").alias("name"), (F.col("n_regionkey") + 1).cast("string").alias("target")))
    r = t.nation.where(k % 5 == 0).select(k.alias("router"), conditions.alias("conditions"), F.lit("node_7").alias("default_target"), F.when(k % 10 == 0, "9").alias("max_target"))
    plain = t.nation.where(k % 5 != 0).select(k.alias("from"), F.col("n_regionkey").cast("long").alias("to"))
    return W.router_edges(r, plain)


@query("SELECT n_nationkey AS router, ['high=node_' || n_regionkey, 'low=node_' || (n_regionkey + 1)] AS conditions, 'node_7' AS default_target, CASE WHEN n_nationkey % 10 = 0 THEN 'node_9' END AS max_target FROM nation WHERE n_nationkey % 5 = 0")
def routers_back(t):
    """The routers' rules from the expanded edges again."""
    r = W.routers_from_edges(expand_router_edges(t))
    return r.select("router", F.transform("conditions", lambda c: F.concat_ws("=", c["name"], c["target"])).alias("conditions"), "default_target", "max_target")


@query("""WITH c AS (SELECT user_id, avg(value) AS v, count(*) FILTER (event_type = 'error') AS runs FROM events GROUP BY 1)
SELECT user_id, CASE WHEN runs >= 12 THEN 'max_iterations_exceeded' WHEN v > 52 THEN 'accept' WHEN v < 45 THEN 'retry' ELSE 'default' END AS decision, CASE WHEN runs >= 12 THEN 9 WHEN v > 52 THEN 1 WHEN v < 45 THEN 2 ELSE 1 END AS target FROM c""")
def first_match_route(t):
    """Routers' decisions: the first route that holds, the one for too many runs before all, else the default."""
    c = t.events.groupBy("user_id").agg(F.avg("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("runs"))
    route = lambda seq, name, target, hit: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("route"), F.lit(target).alias("target"), hit.alias("matched"))
    rows = c.select("user_id", "runs", F.inline(F.array(route(0, "accept", 1, F.col("v") > 52), route(1, "retry", 2, F.col("v") < 45), route(1001, "max_iterations_exceeded", 9, F.lit(False)))))
    return W.routed(rows, "user_id", 12)


CHECKS = [("value", ">", "40"), ("value", "<=", "abc"), ("event_type", "in", "view,click"), ("missing", "==", "1"), ("value", "lt", "20"), ("event_type", "ne", "view"), ("user_id", ">=", "75"), ("user_id", "==", "10.0"), ("event_type", "not in", "error"), ("value", "~", "1")]


@query("""SELECT event_id, unnest(range(10))::BIGINT AS k, unnest([value > 40, false, event_type IN ('view', 'click'), false, value < 20, event_type <> 'view', user_id >= 75, user_id = 10, event_type <> 'error', false]) AS ok FROM events""")
def rule_predicates(t):
    """All comparisons by name and alias; a cast that fails, a field that is missing and an unknown operator are false."""
    fields = set(t.events.columns)
    rows = []
    for k, (field, op, threshold) in enumerate(CHECKS):
        value = F.col(field).cast("string") if field in fields else F.lit(None).cast("string")
        options = F.split(F.lit(threshold), ",") if "in" in op else None
        rows.append(F.struct(F.lit(k).cast("long").alias("k"), W.holds(value, F.lit(op), F.lit(threshold), options).alias("ok")))
    return t.events.select("event_id", F.inline(F.array(*rows)))


@query("SELECT user_id, coalesce(min_by(value, event_id) FILTER (k = 'view'), min_by(value, event_id) FILTER (starts_with(k, 'view_'))) AS value FROM (SELECT user_id, event_id, value, CASE WHEN event_id % 11 = 0 THEN event_type ELSE event_type || '_' || event_id % 3 END AS k FROM events) WHERE k = 'view' OR starts_with(k, 'view_') GROUP BY 1")
def field_by_prefix(t):
    """A field of each user's state: the exact key, else the first key that begins with it."""
    key = F.when(F.col("event_id") % 11 == 0, F.col("event_type")).otherwise(F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string")))
    return W.field_value(t.events.select("user_id", key.alias("key"), "value", F.col("event_id").alias("seq")), "user_id", "view")


LOG = """WITH a AS (SELECT conv_id, turn, role AS agent, CASE turn % 3 WHEN 0 THEN 'MINIMAL' WHEN 1 THEN 'VERBOSE' ELSE 'debug' END AS level, text FROM conversations)"""


@query(LOG + """SELECT agent, level, '[' || agent || '] ' || CASE WHEN level = 'MINIMAL' AND length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS said FROM a WHERE agent IN ('assistant', 'user') AND (level = 'MINIMAL' OR agent = 'user')""")
def log_filter(t):
    """Messages that their agent's level lets through, cut unless verbose; agents without a level say nothing."""
    k = F.col("turn") % 3
    rows = t.conversations.select(F.col("role").alias("agent"), F.when(k == 0, "MINIMAL").when(k == 1, "VERBOSE").otherwise("debug").alias("level"), F.col("text").alias("message"))
    levels = t.spark.createDataFrame([("assistant", "INFO"), ("user", "VERBOSE")], "agent string, agent_level string")
    return W.log_lines(rows, F.broadcast(levels))


CONFIG = """'{"nodes": [{"id": "' || c_custkey || '", "type": "' || CASE WHEN c_nationkey % 6 = 0 THEN 'oracle' ELSE 'router' END || '"}' || CASE WHEN c_nationkey % 5 = 0 THEN ', {"type": "vlm"}' ELSE '' END || '], "connections": [{"from": "' || c_custkey || '", "to": "' || (c_custkey + c_nationkey % 2) || '"}]' || CASE WHEN c_nationkey % 7 = 0 THEN '' ELSE ', "node_thresholds": {}' END || '}'"""


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS k FROM customer) SELECT c_custkey, 'missing section' AS error, 'node_thresholds' AS detail FROM c WHERE k % 7 = 0
UNION ALL SELECT c_custkey, 'unsupported type', c_custkey::VARCHAR FROM c WHERE k % 7 <> 0 AND k % 6 = 0 UNION ALL SELECT c_custkey, 'node without id', 'vlm' FROM c WHERE k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT c_custkey, 'no node for to', (c_custkey + 1)::VARCHAR FROM c WHERE k % 7 <> 0 AND k % 2 = 1""")
def config_errors(t):
    """Errors of workflow configurations, which are JSON texts: sections, nodes, types and the ends of edges."""
    said = F.expr(CONFIG.replace("|| c_custkey ||", "|| cast(c_custkey as string) ||").replace("|| (c_custkey + c_nationkey % 2) ||", "|| cast(c_custkey + c_nationkey % 2 as string) ||"))
    return S.workflow_errors(t.customer.select("c_custkey", said.alias("raw")), "c_custkey", "raw")


SCHEMA = {
    "type": "object", "required": ["id", "kind", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 3, "pattern": "^[a-z]+[0-9]+$"}, "kind": {"type": "string", "enum": ["view", "click", "purchase"]}, "value": {"type": "number", "minimum": 5, "maximum": 95},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}}, "note": {"type": ["string", "null"]},
    },
}
RECORD = """'{"id": "' || CASE WHEN event_id % 13 = 0 THEN '7' ELSE 'e' END || event_id || '", "kind": "' || event_type || '", "value": ' || value || CASE WHEN event_id % 17 = 0 THEN '' ELSE ', "tags": [' || CASE WHEN event_id % 7 = 0 THEN '' ELSE props || CASE WHEN event_id % 5 = 0 THEN ', {"k": "x"}, {}' ELSE '' END END || ']' END || CASE WHEN event_id % 19 = 0 THEN ', "more": 1' ELSE '' END || CASE WHEN event_id % 23 = 0 THEN '' ELSE '}' END"""


@query("""WITH v AS (SELECT event_id AS i, event_type AS e, value AS x FROM events), r AS (
SELECT i, unnest(list_filter([CASE WHEN i % 13 = 0 OR i < 0 THEN {'path': 'id', 'code': 'PATTERN'} END, CASE WHEN length(CASE WHEN i % 13 = 0 THEN '7' ELSE 'e' END || i) < 3 THEN {'path': 'id', 'code': 'MIN_LENGTH'} END, CASE WHEN e NOT IN ('view', 'click', 'purchase') THEN {'path': 'kind', 'code': 'ENUM'} END,
 CASE WHEN x < 5 THEN {'path': 'value', 'code': 'MINIMUM'} END, CASE WHEN x > 95 THEN {'path': 'value', 'code': 'MAXIMUM'} END, CASE WHEN i % 17 = 0 THEN {'path': 'tags', 'code': 'REQUIRED'} END, CASE WHEN i % 17 <> 0 AND i % 7 = 0 THEN {'path': 'tags', 'code': 'MIN_ITEMS'} END,
 CASE WHEN i % 17 <> 0 AND i % 7 <> 0 AND i % 5 = 0 THEN {'path': 'tags[].k', 'code': 'TYPE'} END, CASE WHEN i % 17 <> 0 AND i % 7 <> 0 AND i % 5 = 0 THEN {'path': 'tags[].k', 'code': 'REQUIRED'} END, CASE WHEN i % 19 = 0 THEN {'path': '$', 'code': 'ADDITIONAL'} END], lambda p: p IS NOT NULL)) AS p FROM v WHERE i % 23 <> 0)
SELECT i AS event_id, p.path AS path, p.code AS code FROM r UNION ALL SELECT i, '$', 'JSON_PARSE' FROM v WHERE i % 23 = 0""")
def schema_violations(t):
    """Every rule of a JSON Schema document that a record breaks; records are reported, not rejected."""
    said = F.expr(RECORD.replace("|| event_id ||", "|| cast(event_id as string) ||").replace("|| value ||", "|| cast(value as string) ||"))
    return S.schema_errors(t.events.select("event_id", said.alias("raw")), "raw", SCHEMA, ["event_id"])


@query("""WITH d AS (SELECT p_partkey::VARCHAR AS id, list_sort(list_distinct(list_filter([lower(p_brand), split_part(lower(p_type), ' ', 1), 'Lib.' || p_size, '9bad'], lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_.]*$')))) AS uses FROM part),
u AS (SELECT dep AS id, list(id ORDER BY id) AS used_by FROM (SELECT id, unnest(uses) AS dep FROM d) GROUP BY 1)
SELECT coalesce(d.id, u.id) AS id, coalesce(d.uses, []) AS uses, len(coalesce(u.used_by, []))::BIGINT AS n_used_by, coalesce(u.used_by, [])[1] AS first_user FROM d FULL JOIN u ON d.id = u.id WHERE coalesce(len(d.uses), 1) > 0""")
def dependency_edges(t):
    """Sorted references of each part, and who refers to each name."""
    names = F.array(F.lower("p_brand"), F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1)), F.concat(F.lit("Lib."), F.col("p_size").cast("string")), F.lit("9bad"))
    refs = t.part.select(F.col("p_partkey").cast("string").alias("src"), F.explode(F.filter(names, lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_.]*$"))).alias("dst"))
    return G.neighbours(refs).select("id", "uses", F.size("used_by").cast("long").alias("n_used_by"), F.get("used_by", F.lit(0)).alias("first_user"))


@query("""SELECT n_nationkey, '{"value": ' || n_regionkey || '}' AS top_k, n_name AS log_level FROM nation""")
def config_wrap(t):
    """Values wrapped as {"value": ...}, but for the keys of the log."""
    config = F.create_map(F.lit("top_k"), F.col("n_regionkey").cast("string"), F.lit("log_level"), F.col("n_name"))
    m = W.wrapped(config, ["log_level"])
    return t.nation.select("n_nationkey", F.regexp_replace(F.try_element_at(m, F.lit("top_k")), '"(\\d+)"', "$1").alias("top_k"), F.try_element_at(m, F.lit("log_level")).alias("log_level"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k, 'c' || (c_custkey % 12) AS name FROM customer), h AS (SELECT 'c' || label AS name FROM embeddings GROUP BY 1 HAVING count(*) FILTER (len(embedding) > 0) > 0),
n AS (SELECT k, count(*) AS n, count(h.name) AS found FROM a LEFT JOIN h USING (name) GROUP BY 1)
SELECT 'strict' AS mode, k, name FROM a WHERE k IN (SELECT k FROM n WHERE n = found) UNION ALL SELECT 'fallback', k, name FROM a JOIN h USING (name) UNION ALL SELECT 'fallback', k, h.name FROM n, h WHERE found = 0""")
def search_targets(t):
    """The collections that searches go to, strictly and with a fallback."""
    from tessera.operators.rules import targets

    asked = t.customer.select(F.col("c_nationkey").alias("k"), F.concat(F.lit("c"), (F.col("c_custkey") % 12).cast("string")).alias("name"))
    held = t.embeddings.groupBy(F.concat(F.lit("c"), F.col("label").cast("string")).alias("name")).agg(F.count_if(F.size("embedding") > 0).alias("points"))
    both = [targets(asked, held, "k", strict).select(F.lit(mode).alias("mode"), "k", "name") for mode, strict in (("strict", True), ("fallback", False))]
    return both[0].unionByName(both[1])
