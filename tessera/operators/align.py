"""Joins that Spark has no keyword for: as-of, interval overlap and nearest column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, time: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it; ties take the largest value.

    A union and a running last over one sort, without a range join.
    """
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    r = right.select(by, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, time: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the right row nearest in time; the earlier one on a tie, then the smaller value.

    left needs numeric or timestamp time; time differences are in seconds.
    """
    pair = F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v"))
    l = left.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(right.select(pair.alias("p")).schema["p"].dataType))
    r = right.select(by, time, pair.alias("_p")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(by).orderBy(F.col(time), F.col("_side"), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col(time), F.col("_side").desc(), F.col("_p")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_b", F.last("_p", ignorenulls=True).over(back)).withColumn("_f", F.first("_p", ignorenulls=True).over(ahead))
    now = F.col(time).cast("double")
    gap_b, gap_f = now - F.col("_b.t"), F.col("_f.t") - now
    pick = F.when(F.col("_f").isNull() | (gap_b <= gap_f), F.col("_b")).otherwise(F.col("_f"))
    return both.where("_side = 1").withColumn(out, pick["v"]).drop("_side", "_p", "_b", "_f")


def overlapping(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, width: int, how: str = "inner") -> DataFrame:
    """Interval overlap by equal buckets of the given width; a pair counts in its first common bucket.

    Bounds are inclusive whole numbers; a row whose bounds are null or the wrong way round overlaps with nothing. how:
    inner, left_semi or left_anti. Left rows may hold nulls and repeat: whether a row has a partner is found for its
    bounds, which are compared null-safely.
    """
    span = lambda s, e: F.explode(F.when(F.col(s) <= F.col(e), F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    r = right.withColumn("_c", span(rs, re))
    hit = (F.col("_b") == F.col("_c")) & (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) & (F.col("_b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    if how == "inner":
        return left.withColumn("_b", span(ls, le)).join(r, hit).drop("_b", "_c")
    bounds = left.select(ls, le).distinct().withColumn("_b", span(ls, le))
    found = bounds.join(r, hit, "left_semi").select(F.col(ls).alias("_s"), F.col(le).alias("_e")).distinct()
    return left.join(found, left[ls].eqNullSafe(found["_s"]) & left[le].eqNullSafe(found["_e"]), how)


def clipped(pairs: DataFrame, ls: str, le: str, rs: str, re: str) -> DataFrame:
    """Adds the common part of both intervals: from_ and to."""
    return pairs.withColumn("from_", F.greatest(ls, rs)).withColumn("to", F.least(le, re))


def nearest_column(long: DataFrame, by: str, reference: str, candidate: str, order: str) -> DataFrame:
    """For each series the candidate column with the smallest L2 distance from the reference; the first on a tie.

    long: (by, name, order, reference value, candidate value).
    """
    dist = long.groupBy(by, "name", order).agg(F.sqrt(F.sum(F.pow(F.col(reference) - F.col(candidate), 2))).alias("dist"))
    return dist.groupBy(by).agg(F.min_by(F.struct("name", "dist"), F.struct(F.round("dist", 6).alias("d"), F.col(order).alias("o"))).alias("best")).select(by, "best.name", "best.dist")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod over i in n-c+1..n of (1 - k/i); 0 without a correct sample, 1 where fewer than k are wrong."""
    terms = F.transform(F.sequence(n - c + 1, n), lambda i: 1 - F.lit(float(k)) / i)
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1 - F.aggregate(terms, F.lit(1.0), lambda a, x: a * x))


def positions(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the place of each row, from 1, in a total order. Rows are sorted by ranges; a range's first place is the number
    of rows in the ranges before it, so the whole is never sorted in one task."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = parts.withColumn("_p", F.spark_partition_id())
    counts = placed.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return inside.join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn(out, (F.col("_before") + F.col("_k")).cast("long")).drop("_p", "_k", "_before")


def by_first_number(rows: DataFrame, name: str, records: DataFrame, id_col: str) -> DataFrame:
    """Rows with the record whose id is the first number in their name, if there is one."""
    n = F.regexp_extract(name, r"(\d+)", 1).try_cast("long")
    return rows.withColumn("_n", n).join(records, F.col("_n") == F.col(id_col), "left").drop("_n")


def by_number_prefix(rows: DataFrame, name: str, pattern: str, files: DataFrame, file: str) -> DataFrame:
    """Rows with the first file whose name begins with their number and an underscore; the number is what the pattern
    takes from their name."""
    first = files.withColumn("_n", F.regexp_extract(file, r"^(\d+)_", 1)).where("_n <> ''").groupBy("_n").agg(F.min(file).alias(file))
    return rows.withColumn("_n", F.regexp_extract(name, pattern, 1)).join(first, "_n", "left").drop("_n")


#: Image references in Markdown and HTML.
IMAGE = r"""!\[[^\]]*\]\(\s*(?:"[^"]+"|'[^']+'|[^\s)]+)\s*\)|(?i:<img[^>]*?src="[^"]+"[^>]*?>|<img[^>]*?src='[^']+'[^>]*?>)"""


def with_captions(rows: DataFrame, by: str, text: str, captions: DataFrame) -> DataFrame:
    """(by, text) with each image reference replaced by the caption of its path; captions: (path, caption). Paths are
    compared with slashes, in lower case, without blanks around. Ids are those of single rows."""
    from tessera.functions.extract import normalised_path

    parts = rows.select(by, F.split(text, IMAGE, -1).alias("around"), F.regexp_extract_all(text, F.lit(f"({IMAGE})"), 1).alias("refs"))
    refs = parts.select(by, F.posexplode("refs").alias("at", "ref"))
    path = F.regexp_replace(F.regexp_replace("ref", r"""(?i)^<img[^>]*?src=["']([^"']+)["'].*$""", "$1"), r"""^!\[[^\]]*\]\(\s*["']?(.*?)["']?\s*\)$""", "$1")
    known = captions.groupBy(normalised_path(F.col("path")).alias("_path")).agg(F.max("caption").alias("caption"))
    shown = refs.withColumn("_path", normalised_path(path)).join(known, "_path", "left").groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("caption", "ref").alias("s")))), lambda x: x["s"]).alias("shown"))
    both = parts.join(shown, by, "left")
    ends = F.concat(F.coalesce("shown", F.array().cast("array<string>")), F.array(F.lit("")))
    return both.select(by, F.array_join(F.zip_with("around", ends, lambda a, b: F.concat(a, b)), "").alias(text))
