"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, embedding_dedup, fill_in_middle, license_scan, ranked_search, url_filter, warc_audit
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import identify
from tessera.llm.minhash_dedup import near_duplicates
from tessera.llm.quality_classifier import quality_scores
from tessera.llm.sentencepiece_bpe import encode_documents
from tessera.llm.source_mixing import domain_labels, mixed
from tessera.llm.suffix_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.fixity_drill(common.table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""



def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A vocabulary file that is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"), least=0.98)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return encode_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(common.table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    docs = common.table(spark, sf_dir, "documents")
    return mixed(docs, domain_labels(docs, common.table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return identify(common.table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return remove_repeats(common.table(spark, sf_dir, "documents"), span=400)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return ranked_search.ranked_search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = url_filter.build_index(url_filter.rule_table(spark, url_filter.RULES, url_filter.LISTED))
    return url_filter.url_verdicts(common.table(spark, sf_dir, "pages"), index)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.arrow_limits(spark)
    return fill_in_middle.fill_in_middle(common.table(spark, sf_dir, "documents"), digests=True)


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc_audit": op10_warc_audit,
    "op11_ranked_search": op11_ranked_search,
    "op12_url_filter": op12_url_filter,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op9_exact_dedup": OP9_SQL,
    "op10_warc_audit": warc_audit.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_url_filter": url_filter.oracle(),
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
