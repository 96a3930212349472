"""What a workflow's state holds for its validator and its answer: lists by prefix, confidences by node, decisions, experts.

The state is a table of writes (by, seq, key, value), where value is JSON. A key's place is that of its first write, and its
value that of the last, as in a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes of lists, the fields of an expert, and what counts where nothing is known.
LISTS = ["facts", "insights", "recommendations", "search_results"]
EXPERT = ["facts", "insights", "recommendations", "gaps", "citations"]
ROUTING = "routing_metadata_"
UNKNOWN = 0.5


def current(writes: DataFrame, by: str) -> DataFrame:
    """(by, key, place, value): one row for each key, with partial results before the shuffle."""
    return writes.groupBy(by, "key").agg(F.min("seq").alias("place"), F.max_by("value", "seq").alias("value"))


def _items(value: Column) -> Column:
    """The elements of a JSON array as JSON texts; null for anything else."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: F.to_json(v)))


def lists(state: DataFrame, by: str, kinds: list[str] | None = None) -> DataFrame:
    """(by, kind, at, item) of current state: the elements of all lists whose key begins with a kind, joined in the order
    of their keys; at counts from 0. A value that is no list counts for nothing. Items are rows, so no list has to fit in
    one."""
    kind = F.regexp_extract("key", f"^({'|'.join(kinds or LISTS)})_", 1)
    rows = state.withColumn("kind", kind).where("kind <> ''").select(by, "kind", "place", "key", F.posexplode(_items(F.col("value"))).alias("k", "item"))
    at = F.row_number().over(Window.partitionBy(by, "kind").orderBy("place", "key", "k")) - 1
    return rows.select(by, "kind", at.cast("long").alias("at"), "item")


def citations(items: DataFrame, by: str) -> DataFrame:
    """(by, id, source, content) of the search results among lists(): numbered, with the first 100 characters."""
    found = items.where("kind = 'search_results'")
    get = lambda k, d: F.coalesce(F.get_json_object("item", f"$.{k}"), F.lit(d))
    return found.select(by, F.concat(F.lit("cite_"), F.col("at").cast("string")).alias("id"), get("source", "unknown").alias("source"), F.substring(get("content", ""), 1, 100).alias("content"))


def confidences(state: DataFrame, by: str) -> DataFrame:
    """(by, retriever, expert): the mean confidence of nodes 2 and 3, and of nodes from 4 on; UNKNOWN without any. Only
    numbers count, under keys that end in a node's number."""
    node = F.regexp_extract("key", r"^confidence_(\d+)$", 1).try_cast("long")
    number = F.try_variant_get(F.try_parse_json("value"), "$", "double")
    plain = F.regexp_extract(F.schema_of_variant(F.try_parse_json("value")), "^([A-Z]+)", 1).isin("STRING", "BOOLEAN")
    rows = state.select(by, node.alias("node"), F.when(~plain, number).alias("x"))
    mean = lambda c: F.coalesce(F.avg(F.when(c & F.col("x").isNotNull(), F.col("x"))), F.lit(UNKNOWN))
    return rows.groupBy(by).agg(mean(F.col("node").isin(2, 3)).alias("retriever"), mean(F.col("node") >= 4).alias("expert"))


def decisions(state: DataFrame, by: str) -> DataFrame:
    """(by, node, place, value) of the routers' decisions, by the key's place."""
    return state.where(F.startswith("key", F.lit(ROUTING))).select(by, F.expr(f"substring(key, {len(ROUTING) + 1})").alias("node"), "place", "value")


def experts(state: DataFrame, by: str) -> DataFrame:
    """(by, node, answer, confidence, and a count for each list of EXPERT) of each node that has an answer, a text that
    isn't empty."""
    kind, node = F.regexp_extract("key", r"^(.*)_(\d+)$", 1), F.regexp_extract("key", r"^(.*)_(\d+)$", 2)
    rows = state.select(by, kind.alias("kind"), node.alias("node"), "value").where("node <> ''")
    text = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    size = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.size(_items(F.col("value"))))), F.lit(0)).cast("long").alias(k)
    out = rows.groupBy(by, "node").agg(F.max(F.when(F.col("kind") == "analysis", text)).alias("answer"), F.max(F.when(F.col("kind") == "confidence", F.col("value").try_cast("double"))).alias("confidence"), *[size(k) for k in EXPERT])
    return out.where("answer <> ''")
