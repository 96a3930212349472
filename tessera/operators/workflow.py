"""Agent workflows: connection rules, router edges and decisions, rule comparisons, log filters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIASES = {"lt": "<", "le": "<=", "eq": "==", "ge": ">=", "gt": ">", "ne": "!="}
OPERATORS = ["==", "!=", ">", ">=", "<", "<=", "in", "not in"]
#: Levels of the log; the names in brackets are other spellings.
LEVELS = {"MINIMAL": 1, "INFO": 1, "VERBOSE": 2, "DEBUG": 2}


def holds(value: Column, operator: Column, threshold: Column, options: Column | None = None) -> Column:
    """Whether a comparison of text values holds. == and != compare as they are (as numbers where both are), the order
    comparisons as numbers and false where one is none; in and not in look into options, and without these are false and
    true. Aliases such as lt and ne count; a missing value or another operator is false."""
    op = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), operator), operator)
    x, y = value.try_cast("double"), threshold.try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(value.eqNullSafe(threshold))
    inside = F.array_contains(options, value) if options is not None else F.lit(None).cast("boolean")
    out = F.when(op == "==", same).when(op == "!=", ~same).when(op == ">", x > y).when(op == ">=", x >= y).when(op == "<", x < y).when(op == "<=", x <= y)
    out = out.when(op == "in", F.coalesce(inside, F.lit(False))).when(op == "not in", ~F.coalesce(inside, F.lit(False)))
    return F.coalesce(out, F.lit(False)) & value.isNotNull()


def field_value(state: DataFrame, by: str, field: str, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """(by, value) of a field: the exact key, else the first key in order that begins with the field and an underscore."""
    exact = F.col(key) == field
    fit = state.where(exact | F.col(key).startswith(f"{field}_"))
    return fit.groupBy(by).agg(F.min_by(value, F.struct((~exact).alias("other"), F.col(order))).alias("value"))


def connection_checks(pairs: DataFrame, outputs: DataFrame, inputs: DataFrame, existing: DataFrame, max_loops: int = 10) -> DataFrame:
    """Adds valid, error, line_types, auto_select and warnings to pairs (from, to) of agent types.

    outputs, inputs: (agent, other, line_types); an agent is known by its outputs. A pair has to be allowed by its sender
    and, where the receiver names inputs at all, by the receiver, and to share a line type. existing: (from, to, type);
    warnings are a connection that is there already, and feedback near max_loops.
    """
    known = outputs.select(F.col("agent").alias("k")).distinct()
    o = outputs.select(F.col("agent").alias("from"), F.col("other").alias("to"), F.col("line_types").alias("out_types"))
    i = inputs.select(F.col("agent").alias("to"), F.col("other").alias("from"), F.col("line_types").alias("in_types"))
    restricted = inputs.select(F.col("agent").alias("to"), F.lit(True).alias("restricted")).distinct()
    there = existing.groupBy("from", "to").agg(F.count("*").alias("there"))
    feedback = existing.agg(F.count_if(F.col("type").isin("feedback", "feedback_flow")).alias("feedback"))
    p = pairs.join(known.select(F.col("k").alias("from"), F.lit(True).alias("from_known")), "from", "left").join(known.select(F.col("k").alias("to"), F.lit(True).alias("to_known")), "to", "left")
    p = p.join(o, ["from", "to"], "left").join(i, ["from", "to"], "left").join(restricted, "to", "left").join(there, ["from", "to"], "left").crossJoin(F.broadcast(feedback))  # one row
    types = F.array_sort(F.when(F.col("in_types").isNotNull(), F.array_intersect("out_types", "in_types")).otherwise(F.col("out_types")))
    error = (
        F.when(F.col("from_known").isNull(), "unknown sender").when(F.col("to_known").isNull(), "unknown receiver").when(F.col("from") == F.col("to"), "self connection")
        .when(F.col("out_types").isNull(), "sender does not allow it").when(F.col("restricted") & F.col("in_types").isNull(), "receiver does not allow it").when(F.size(types) == 0, "no common line type")
    )
    warnings = F.array_compact(F.array(F.when(F.col("there") > 0, "connection exists"), F.when(F.col("feedback") >= max_loops - 1, "feedback near its limit")))
    fine, none = error.isNull(), F.array().cast("array<string>")
    return p.select("from", "to", fine.alias("valid"), error.alias("error"), F.when(fine, types).otherwise(none).alias("line_types"), (fine & (F.size(types) == 1)).alias("auto_select"), F.when(fine, warnings).otherwise(none).alias("warnings"))


def suggestions(outputs: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent, other, line_types) that agents may connect to; agents: (agent)."""
    return agents.join(outputs, "agent")


def node_number(target: Column) -> Column:
    """``node_7`` and ``7`` as the number 7; null for anything else."""
    return F.regexp_replace(target, "^node_", "").try_cast("long")


def router_edges(rules: DataFrame, plain: DataFrame) -> DataFrame:
    """(from, to, condition, seq): plain edges, and those of routers: conditions in their order, then the default, then
    the one for too many iterations.

    rules: (router, conditions: array of (name, target), default_target, max_target), targets as ``node_7`` or numbers.
    """
    routes = F.concat(
        F.transform("conditions", lambda c, k: F.struct(k.alias("seq"), c["name"].alias("condition"), c["target"].alias("target"))),
        F.array(F.struct(F.lit(1000).alias("seq"), F.lit("default").alias("condition"), F.col("default_target").alias("target")), F.struct(F.lit(1001).alias("seq"), F.lit("max_iterations_exceeded").alias("condition"), F.col("max_target").alias("target"))),
    )
    rows = rules.select(F.col("router").alias("from"), F.inline(routes)).where("target is not null")
    return plain.select("from", "to", F.lit(None).cast("string").alias("condition"), F.lit(-1).alias("seq")).unionByName(rows.select("from", node_number(F.col("target")).alias("to"), "condition", "seq"))


def routers_from_edges(edges: DataFrame) -> DataFrame:
    """The rules of ``router_edges`` from its edges again."""
    routed = edges.where("condition is not null")
    name = lambda c: F.max(F.when(F.col("condition") == c, F.concat(F.lit("node_"), F.col("to").cast("string"))))
    own = ~F.col("condition").isin("default", "max_iterations_exceeded")
    conditions = F.array_sort(F.collect_list(F.when(own, F.struct("seq", F.col("condition").alias("name"), F.concat(F.lit("node_"), F.col("to").cast("string")).alias("target")))))
    out = routed.groupBy(F.col("from").alias("router")).agg(conditions.alias("c"), name("default").alias("default_target"), name("max_iterations_exceeded").alias("max_target"))
    return out.select("router", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["target"].alias("target"))).alias("conditions"), "default_target", "max_target")


def compiled_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, to, kind) of an agent graph: edges once each, conditional where they leave a router; START to nodes that
    nothing leads to and END from nodes that lead nowhere and are no routers; without these the smallest and the largest
    id take their part. nodes: (id, type)."""
    e = edges.select("from", "to").dropDuplicates()
    routers = nodes.where("type = 'router'").select(F.col("id").alias("from"), F.lit("conditional").alias("kind"))
    inner = e.join(routers, "from", "left").select(F.col("from").cast("string"), F.col("to").cast("string"), F.coalesce("kind", F.lit("data")).alias("kind"))
    first = nodes.join(e.select(F.col("to").alias("id")), "id", "left_anti").select("id")
    last = nodes.where("type <> 'router'").join(e.select(F.col("from").alias("id")), "id", "left_anti").select("id")
    bounds = nodes.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    missing = lambda some, bound: bounds.crossJoin(some.agg(F.count("*").alias("n"))).where("n = 0").select(F.col(bound).alias("id"))  # noqa: E731  (one row each)
    first, last = first.unionByName(missing(first, "low")), last.unionByName(missing(last, "high"))
    return inner.unionByName(first.select(F.lit("START").alias("from"), F.col("id").cast("string").alias("to"), F.lit("start").alias("kind"))).unionByName(last.select(F.col("id").cast("string").alias("from"), F.lit("END").alias("to"), F.lit("end").alias("kind")))


def routed(checked: DataFrame, by: str, limit: int = 1) -> DataFrame:
    """(by, decision, target) of routers: the first route in order whose checks hold, unless the router has run ``limit``
    times or more; then the route for that. Without a route that holds, ``default`` with the first route's target.

    checked: (by, seq, route, target, matched, runs)."""
    over = F.col("route") == "max_iterations_exceeded"
    first = F.min_by(F.struct("route", "target"), "seq")
    out = checked.groupBy(by).agg(F.max("runs").alias("runs"), first.alias("first"), F.min_by(F.when(F.col("matched"), F.struct("route", "target")), F.when(F.col("matched"), F.col("seq"))).alias("hit"), F.max(F.when(over, F.struct("route", "target"))).alias("stop"))
    pick = F.when((F.col("runs") >= limit) & F.col("stop").isNotNull(), F.col("stop")).when(F.col("hit").isNotNull(), F.col("hit"))
    return out.select(by, F.coalesce(pick["route"], F.lit("default")).alias("decision"), F.coalesce(pick["target"], F.col("first.target")).alias("target"))


def log_lines(events: DataFrame, levels: DataFrame, limit: int = 500) -> DataFrame:
    """(agent, level, said) of messages at or below their agent's level; agents without a level say nothing, and other
    messages than verbose ones are cut at the limit. events: (agent, level, message); levels: (agent, agent_level)."""
    number = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.upper(c)), F.lit(1))
    rows = events.join(levels, "agent").where(number(F.col("level")) <= number(F.col("agent_level")))
    cut = F.when((number(F.col("level")) < 2) & (F.length("message") > limit), F.concat(F.substring("message", 1, limit), F.lit("..."))).otherwise(F.col("message"))
    return rows.select("agent", "level", F.concat(F.lit("["), "agent", F.lit("] "), cut).alias("said"))


def workflow_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_connections, line_types_used (sorted), feedback_loops. edges: (from, to, type)."""
    e = edges.agg(F.count("*").alias("total_connections"), F.array_sort(F.collect_set(F.coalesce("type", F.lit("unknown")))).alias("line_types_used"), F.count_if(F.col("type").isin("feedback", "feedback_flow")).alias("feedback_loops"))
    return nodes.agg(F.count("*").alias("total_nodes")).crossJoin(e)  # one row each


def wrapped(config: Column, plain: list[str]) -> Column:
    """Every value of a map as ``{"value": ...}``, but for the keys that stay plain."""
    return F.transform_values(config, lambda k, v: F.when(k.isin(plain), v).otherwise(F.concat(F.lit('{"value": '), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("}"))))

