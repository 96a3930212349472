"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u; summed before the shuffle, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    moved = down.join(near.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node that has an edge; component_id is the smallest node reachable.

    edges: (u, v) of one ordered type, without nulls; loops, repeats and both directions are allowed. Every round is
    written to the shared folder, so an executor that is lost costs no more than its own tasks.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        after = common.written(small_star(large_star(now)), "edges")
        common.dropped(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return found.unionByName(found.select(F.col("component_id").alias("node"), "component_id").distinct())
