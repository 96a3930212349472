"""Replies of models as text: the JSON in them, with what counts where there is none or where a field is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.extract import bound
from tessera.operators.text import stripped, whole_json

# What a reply counts as where it can't be read.
INTENT, CONFIDENCE, KEPT = "query", 0.5, 200
GAP, SAID = "JSONパース失敗", 1000
ASSURED, EVIDENCE = 0.7, "中程度の証拠"
LISTS = ["facts", "insights", "recommendations", "gaps"]
KANA, CJK = r"[぀-ゟ゠-ヿｦ-ﾝ]", r"[一-鿿]"


def fenced(reply: Column) -> Column:
    """What stands in the first block marked as JSON, else in the first block, else the whole; a block that isn't closed
    goes to the end."""
    def block(mark: str) -> Column:
        return F.regexp_extract(reply, rf"(?s){mark}(.*?)(?:```|\z)", 1)

    return stripped(F.when(F.contains(reply, F.lit("```json")), block("```json")).when(F.contains(reply, F.lit("```")), block("```")).otherwise(reply))


def braced(reply: Column) -> Column:
    """From the first opening to the last closing brace; null without both in this order."""
    got = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def _object(text: Column) -> Column:
    return bound(whole_json(text), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def _has(v: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), key), F.lit(False))


def _number(v: Column, key: str) -> Column:
    """A number, or a text that is one; a percentage in hundredths. Null for anything else."""
    said = F.try_variant_get(v, f"$.{key}", "string")
    return F.when(F.contains(said, F.lit("%")), F.regexp_replace(said, "%+$", "").try_cast("double") / 100).when(said == "true", 1.0).when(said == "false", 0.0).otherwise(said.try_cast("double"))


def analysis(reply: Column) -> Column:
    """(parsed, intent, optimized_query, confidence) of an analyser's reply. Confidence is cut to 0 to 1, and null where the
    reply tells none. A reply without a JSON object, or with a confidence that is no number, is a query for its own first
    characters with a confidence of one half."""
    def read(v: Column) -> Column:
        number = _number(v, "confidence")
        fine = v.isNotNull() & (~_has(v, "confidence") | number.isNotNull())
        text = lambda k, other: F.when(fine, F.try_variant_get(v, f"$.{k}", "string")).otherwise(other)
        return F.struct(
            F.coalesce(fine, F.lit(False)).alias("parsed"), text("intent", F.lit(INTENT)).alias("intent"), text("optimized_query", F.substring(reply, 1, KEPT)).alias("optimized_query"),
            F.when(fine, F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))).otherwise(CONFIDENCE).alias("confidence"))

    return bound(_object(fenced(reply)), read)


def expertise(reply: Column) -> Column:
    """(analysis, facts, insights, recommendations, gaps) of an expert's reply, missing lists empty. A reply without a JSON
    object is an analysis by its first characters, with a gap that says so."""
    none = F.array().cast("array<string>")

    def read(v: Column) -> Column:
        fine = v.isNotNull()
        listed = lambda k: F.when(fine, F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), none)).otherwise(F.array(F.lit(GAP)) if k == "gaps" else none).alias(k)
        said = F.when(fine, F.coalesce(F.try_variant_get(v, "$.analysis", "string"), F.lit(""))).otherwise(F.substring(reply, 1, SAID))
        return F.struct(said.alias("analysis"), *[listed(k) for k in LISTS])

    return bound(_object(fenced(reply)), read)


def validation(reply: Column) -> Column:
    """(issues, confidence, evidence) of a validator's reply, from its first to its last brace; what is missing, and all of
    a reply that can't be read, has a fixed value."""
    def read(v: Column) -> Column:
        number = _number(v, "confidence")
        fine = v.isNotNull() & (~_has(v, "confidence") | number.isNotNull())
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(fine, F.coalesce(F.try_variant_get(v, "$.issues", "array<string>"), none)).otherwise(none).alias("issues"), F.when(fine, F.coalesce(number, F.lit(ASSURED))).otherwise(ASSURED).alias("confidence"),
            F.when(fine, F.coalesce(F.try_variant_get(v, "$.evidence_assessment", "string"), F.lit(EVIDENCE))).otherwise(EVIDENCE).alias("evidence"))

    return bound(_object(braced(reply)), read)


def in_other_script(text: Column) -> Column:
    """Whether a caption has ideographs and no kana, so that it has to be asked for again."""
    return F.coalesce(text.rlike(CJK) & ~text.rlike(KANA), F.lit(False))
