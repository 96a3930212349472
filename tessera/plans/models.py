"""Queries through the model hooks, with deterministic callables in the place of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hooks as H
from tessera.operators.nearest import nearest
from tessera.plans.registry import query


def length_vectors(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def shared_letters(pairs: list[tuple[str, str]]) -> list[float]:
    return [len(set(a) & set(b)) / max(1, len(set(a) | set(b))) for a, b in pairs]


def upper_or_fail(prompt: str) -> str:
    if prompt.startswith("a"):
        raise RuntimeError("no answer")
    return prompt.upper()


@query("SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents")
def encode_hook(t):
    """Vectors of an injected encoder, in batches."""
    rows = H.encoded(t.documents.select("doc_id", "text"), "text", length_vectors, batch=H.encode_batch(128))
    return rows.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("blanks"))


@query()
def hashed_search(t):
    """The five nearest documents of each benchmark item by the encoder without a model."""
    point = lambda df, k: H.encoded(df.select(F.col(k).alias("vec_id"), "text"), "text").select("vec_id", "embedding")
    q = point(t.benchmark, "item_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return nearest(point(t.documents, "doc_id"), q, 5).select("query_id", "vec_id", "score", "rank")


@query("""WITH s AS (SELECT p_partkey, list_distinct(string_split(p_name, '')) AS a, list_distinct(string_split(p_type, '')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS rerank_score, true AS reranked FROM s""")
def rerank_hook(t):
    """A second score by an injected scorer."""
    hits = t.part.select("p_partkey", "p_name", "p_type", F.lit(0.5).alias("score"))
    return H.reranked(hits, "p_name", "p_type", shared_letters).select("p_partkey", F.round("rerank_score", 6).alias("rerank_score"), "reranked")


@query("SELECT n_nationkey, CASE WHEN starts_with(lower(n_name), 'a') THEN NULL ELSE upper(n_name) END AS answer, CASE WHEN starts_with(lower(n_name), 'a') THEN 'failed' ELSE 'model' END AS source, CASE WHEN starts_with(lower(n_name), 'a') THEN 2 ELSE 1 END AS tries FROM nation WHERE n_regionkey <> 1")
def generation_loop(t):
    """Prompts that have no output yet, with retries; those that fail are told."""
    prompts = t.nation.select("n_nationkey", F.lower("n_name").alias("prompt"))
    done = t.nation.where("n_regionkey = 1").select("n_nationkey")
    return H.generated(prompts, done, ["n_nationkey"], upper_or_fail, tries=2)


REPLY = """CASE p_size % 4 WHEN 0 THEN '{"type": "map", "confidence": 0.9, "reason": "r"}' WHEN 1 THEN 'it is a Circuit drawing' WHEN 2 THEN 'nothing' ELSE '[1]' END"""


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'circuit' ELSE 'natural_image' END AS type, CASE WHEN p_size % 4 = 0 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence, CASE p_size % 4 WHEN 0 THEN 'r' ELSE {REPLY} END AS reason FROM part")
def classifier_fallback(t):
    """A classifier's JSON, else the first type named in its reply, else the default."""
    return H.classified(t.part.select("p_partkey", F.expr(REPLY).alias("reply")), "reply").select("p_partkey", "type", "confidence", "reason")


@query("SELECT n_nationkey, 'error: no answer' AS answer FROM nation WHERE starts_with(lower(n_name), 'a') UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE NOT starts_with(lower(n_name), 'a')")
def chat_hook(t):
    """Replies of an injected chat model; errors are replies."""
    return H.answered(t.nation.select("n_nationkey", F.lower("n_name").alias("prompt")), "prompt", upper_or_fail).select("n_nationkey", "answer")


@query("""WITH k AS (SELECT event_type || '_' || user_id AS key, value FROM events)
SELECT regexp_replace(key, '_\\d+$', '') AS base, count(*) AS uses, count(DISTINCT key) AS keys, min(key) AS example, '| ' || regexp_replace(key, '_\\d+$', '') || ' | float | ' || count(*) || ' |' AS line FROM k GROUP BY 1""")
def registry_export(t):
    """The keys of a workflow's state by their base names: uses, keys of nodes, an example and a line for the documents."""
    k = t.events.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("key"))
    g = k.groupBy(F.regexp_replace("key", r"_\d+$", "").alias("base")).agg(F.count("*").alias("uses"), F.count_distinct("key").alias("keys"), F.min("key").alias("example"))
    return g.withColumn("line", F.concat(F.lit("| "), "base", F.lit(" | float | "), F.col("uses").cast("string"), F.lit(" |")))
