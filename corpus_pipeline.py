"""A training-data pipeline over the documents table, each stage a table that the next one reads.

quality        rejects documents that the quality classifier puts under one half
exact_dedup    keeps one row of each group of equal texts, by the cuckoo-filter index
near_dedup     keeps one document of each MinHash component (five words, similarity 0.8)
mixing         repeats documents of domains below their target weight; no document goes
sentencepiece  encodes and decodes what is left: ids, their number and the digests of both
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.exact_dedup import build_index, normalised, text_digests
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.quality_classifier import good_documents
from tessera.llm.queries import tokenizer_path
from tessera.llm.sentencepiece_bpe import encode_documents
from tessera.llm.source_mixing import domain_labels, mixed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is one half or more; the model learns from the labels table."""
    common.arrow_limits(spark)
    return good_documents(docs, common.table(spark, sf_dir, "labels"))


def _new_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table doesn't have, whatever its columns are called."""
    held = {c.lower() for c in docs.columns}
    mark = "_"
    while any((mark + w).lower() in held for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id; rows that are equal in id and text count once."""
    common.arrow_limits(spark)
    digests = common.written(text_digests(docs), "digests")
    digest, = _new_names(docs, "digest")
    first = build_index(digests).select("keep_id", F.col("digest").alias("key"))
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    same = (marked[digest] == first["key"]) & marked["doc_id"].cast("long").eqNullSafe(first["keep_id"])
    kept = marked.join(first.hint("merge"), same, "left_semi")
    if not digests.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", digest])
    return kept.drop(digest)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates, and all that link with nothing."""
    common.arrow_limits(spark)
    gone = near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["gone"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, once at least; rows of one id have the largest of their rates."""
    common.arrow_limits(spark)
    labelled = domain_labels(docs, common.table(spark, sf_dir, "labels"))
    key, copies, copy = _new_names(docs, "key", "copies", "copy")
    rates = mixed(docs, labelled, temperature=0.7, keep_all=True).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 1)
    out = docs.join(rates.hint("merge"), docs["doc_id"].cast("long") == rates[key], "left")
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce(copies, F.lit(1).cast("long")))))
    return out.select(*[docs[c] for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    common.arrow_limits(spark)
    return encode_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Learned models, MinHash components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = common.held()
    for name, stage in STAGES[:-1]:
        docs = common.swept(common.written(stage(spark, docs, sf_dir), name), before)
        common.released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
