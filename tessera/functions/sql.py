"""Functions that SQL can call by name, as SQL functions: the end of an aggregate over sums that Spark merges itself, as in
``SELECT pass_at_k(count(*), count_if(ok), 5) ... GROUP BY problem``. Partial sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "pass_at_k(n BIGINT, c BIGINT, k INT)": ("DOUBLE", "CASE WHEN c <= 0 THEN 0D WHEN n - c < k THEN 1D ELSE 1D - aggregate(sequence(n - c + 1, n), 1D, (p, i) -> p * (1D - k / CAST(i AS DOUBLE))) END"),
    "clamped(x DOUBLE)": ("DOUBLE", "greatest(least(x, 1D), 0D)"),
    "damped(x DOUBLE)": ("DOUBLE", "1 / (1 + exp(-x)) * CASE WHEN 1 / (1 + exp(-x)) >= 0.7 THEN 1D WHEN 1 / (1 + exp(-x)) >= 0.5 THEN 0.9D ELSE 0.8D END"),
}


def register(spark: SparkSession) -> None:
    """Creates the functions in the session, for as long as it lasts."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
