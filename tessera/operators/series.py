"""Functional checks of simulated series: the shorter of two series sets the times, the nearest column the error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Mean squared error up to which a run passes.
LIMIT = 1e-3


def nearest_rows(points: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """points (by, k, t) with idx, that of the row (by, idx, t) nearest in time: of equally near ones the smallest.

    A union and two running values over one sort, without a range join. A point whose series has no rows has a null idx.
    """
    one = rows.groupBy(*by, "t").agg(F.min("idx").alias("idx"))
    p = F.struct("t", "idx")
    both = points.select(*by, "k", "t", F.lit(1).alias("_side"), F.lit(None).cast("struct<t:double,idx:long>").alias("_p")).unionByName(
        one.select(*by, F.lit(None).cast("long").alias("k"), "t", F.lit(0).alias("_side"), p.cast("struct<t:double,idx:long>").alias("_p")))
    back = Window.partitionBy(*by).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("t", F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_b", F.last("_p", ignorenulls=True).over(back)).withColumn("_f", F.first("_p", ignorenulls=True).over(ahead))
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("gap"), F.col(f"{c}.idx").alias("idx")))
    return both.where("_side = 1").select(*by, "k", "t", F.least(near("_b"), near("_f"))["idx"].alias("idx"))


def errors(references: DataFrame, runs: DataFrame) -> DataFrame:
    """(model, run, name, mse) of each run: its column nearest to the reference, the first one on a tie, and its error.

    references: (model, idx, t, value); runs: (model, run, idx, t, o, name, value), where o is a column's place. The series
    with fewer rows keeps them, and each takes the other's row that is nearest in time; with as many, rows go by idx. A
    run whose distances are no numbers has none, nor has one without a reference.
    """
    ref = references.select("model", F.col("idx").cast("long"), F.col("t").cast("double"), F.col("value").cast("double").alias("want"))
    run = runs.select("model", "run", F.col("idx").cast("long"), F.col("t").cast("double"), "o", "name", F.col("value").cast("double"))
    times = run.groupBy("model", "run", "idx").agg(F.min("t").alias("t"))
    sizes = times.groupBy("model", "run").agg(F.count("*").alias("nv")).join(ref.groupBy("model").agg(F.count("*").alias("nr")), "model")
    few, many, same = (sizes.where(c).select("model", "run") for c in ("nr < nv", "nr > nv", "nr = nv"))
    by = ["model", "run"]
    mine = nearest_rows(ref.join(few, "model").select(*by, F.col("idx").alias("k"), "t"), times.join(few, by), by)
    mine = mine.join(ref.select("model", F.col("idx").alias("k"), "want"), ["model", "k"]).select(*by, "idx", "want")
    theirs = nearest_rows(times.join(many, by).select(*by, F.col("idx").alias("k"), "t"), ref.join(many, "model").select(*by, "idx", "t"), by)
    theirs = theirs.join(ref.select("model", "idx", "want"), ["model", "idx"]).select(*by, F.col("k").alias("idx"), "want")
    level = ref.join(same, "model").select(*by, "idx", "want")
    pairs = mine.unionByName(theirs).unionByName(level)
    sums = pairs.join(run, [*by, "idx"]).groupBy(*by, "o", "name").agg(F.sum(F.pow(F.col("value") - F.col("want"), F.lit(2))).alias("s"), F.count("*").alias("n"))
    best = sums.where(~F.isnan("s") & F.col("s").isNotNull()).groupBy(*by).agg(F.min_by(F.struct("name", "s", "n"), F.struct("s", "o")).alias("b"))
    return best.select(*by, "b.name", (F.col("b.s") / F.col("b.n")).alias("mse"))


def passes(models: DataFrame, references: DataFrame, runs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(model, passed) of each model: its runs whose error is limit at most; 0 without a reference or without runs."""
    found = errors(references, runs).groupBy("model").agg(F.count_if(F.col("mse") <= limit).alias("passed"))
    return models.select("model").distinct().join(found, "model", "left").select("model", F.coalesce("passed", F.lit(0)).alias("passed"))
