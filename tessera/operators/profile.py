"""A profile of payloads that have no schema: every key that occurs in JSON texts, by variants and a lateral join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

#: Characters of an example, and examples of a key.
SHOWN, EXAMPLES = 100, 3


def leaves(rows: DataFrame, raw: str, depth: int = 4) -> DataFrame:
    """(key, kind, value): the values of a column of JSON texts by their dotted keys, kinds as variants tell them. Lists, and
    objects below depth, are one value each, as JSON. Text that is no JSON, or no object, has none."""
    level = rows.select(F.lit("").alias("prefix"), F.try_parse_json(F.col(raw)).alias("v")).where("schema_of_variant(v) like 'OBJECT%'")
    out = None
    for k in range(depth):
        inside = level.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        inside = inside.select(F.concat("prefix", "key").alias("key"), F.col("value").alias("v"), F.regexp_extract(F.schema_of_variant("value"), "^([A-Z]+)", 1).alias("kind"))
        nested = F.col("kind") == "OBJECT" if k + 1 < depth else F.lit(False)
        text = F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
        part = inside.where(~nested).select("key", "kind", text.alias("value"))
        out = part if out is None else out.unionByName(part)
        level = inside.where(nested).select(F.concat("key", F.lit(".")).alias("prefix"), "v")
    return out


def profile(rows: DataFrame, raw: str, expected: list[str] | None = None, depth: int = 4) -> DataFrame:
    """A row for each key: rows (that have it), texts, mean_chars and max_chars of texts, missing (the share of all rows in
    which it isn't there, null or empty), distinct_values, repeated (values that stand twice or more) and up to three
    examples. Expected keys that never occur have a row as well. Values go to a hash before the shuffle, an example's
    first characters beside it, and are counted with partial sums, so a common value or key is no large group. The counts
    are a written table: all that reads the profile reads the texts once."""
    total = rows.agg(F.count("*").alias("_all"))
    n = F.length("value")
    one = leaves(rows, raw, depth).select("key", "kind", F.sha2("value", 256).alias("h"), F.substring("value", 1, SHOWN).alias("s"), n.alias("n"), F.coalesce(n == 0, F.lit(True)).alias("gone"))
    values = stored(one.groupBy("key", "kind", "h", "s", "n", "gone").agg(F.count("*").alias("c")), "values")
    text = F.col("kind") == "STRING"
    stats = values.groupBy("key").agg(
        F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(text, F.col("c"))), F.lit(0)).alias("texts"), (F.sum(F.when(text, F.col("n") * F.col("c"))) / F.sum(F.when(text, F.col("c")))).alias("mean_chars"),
        F.max(F.when(text, F.col("n"))).cast("long").alias("max_chars"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("c"))), F.lit(0)).alias("_gone"), F.count_if(F.col("h").isNotNull()).alias("distinct_values"),
        F.count_if(F.col("h").isNotNull() & (F.col("c") > 1)).alias("repeated"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("h", "kind"))
    shown = values.where("h is not null").withColumn("p", place).where(F.col("p") <= EXAMPLES).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]).alias("examples"))
    out = stats.join(shown, "key", "left")
    if expected:
        out = rows.sparkSession.createDataFrame([(k,) for k in expected], "key string").join(out, "key", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.join(total)  # one row
    missing = F.when(F.col("_all") > 0, (F.col("_all") - F.coalesce("rows", F.lit(0)) + F.coalesce("_gone", F.lit(0))) / F.col("_all"))
    return out.select("key", zero("rows"), zero("texts"), "mean_chars", "max_chars", missing.alias("missing"), zero("distinct_values"), zero("repeated"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def gaps(keys: DataFrame, about: dict, unique: list[str], main: list[str]) -> DataFrame:
    """(gap, key, detail) of a profile and the description of its collection: no sparse vector; no main text; a main text
    of over 2000 characters in the mean; repeated values of keys that should be unique; main keys of which over three
    tenths are missing."""
    spark = keys.sparkSession
    first = keys.where("texts > 0").agg(F.max_by(F.struct("key", "mean_chars"), F.struct("mean_chars", "key")).alias("m"))
    no = F.lit(None).cast("string")
    out = first.select(F.when(F.col("m").isNull(), F.struct(F.lit("no main text").alias("gap"), no.alias("key"), no.alias("detail"))).when(
        F.col("m.mean_chars") > 2000, F.struct(F.lit("long text").alias("gap"), F.col("m.key").alias("key"), F.floor("m.mean_chars").cast("string").alias("detail"))).alias("g")).where("g is not null").select("g.*")
    if "sparse" not in about.get("vectors", []):
        out = out.unionByName(spark.createDataFrame([("no sparse vector", None, None)], "gap string, key string, detail string"))
    twice = keys.where(F.col("key").isin(unique) & (F.col("repeated") > 0)).select(F.lit("duplicates").alias("gap"), "key", F.col("repeated").cast("string").alias("detail"))
    lost = keys.where(F.col("key").isin(main) & (F.col("missing") > 0.3)).select(F.lit("missing").alias("gap"), "key", F.concat(F.round(100 * F.col("missing")).cast("long").cast("string"), F.lit("%")).alias("detail"))
    return out.unionByName(twice).unionByName(lost)


def report(found: DataFrame, name: str) -> DataFrame:
    """(markdown): one row, the gaps of a collection as a list under its name; there are a few for each key at most."""
    line = F.concat_ws(" ", F.lit("-"), F.concat(F.col("gap"), F.lit(":")), F.concat(F.lit("`"), "key", F.lit("`")), "detail")
    lines = F.sort_array(F.collect_list(F.struct("gap", F.coalesce("key", F.lit("")).alias("k"), line.alias("line"))))
    return found.agg(F.array_join(F.concat(F.array(F.lit(f"## {name}")), F.transform(lines, lambda x: x["line"])), "\n").alias("markdown"))
