"""Ordered suppression of near-duplicates: of a list, each item stays that shares less than half of its word pairs with
every item that stays before it.

Lists of up to ROWS items are whole in a task, which goes through them in order and holds the pairs of what stays of one list:
the rows are shuffled once, and what has to go is left out on the way.

Items of longer lists decide one another, so these lists go in rounds, each a table. An item is free once no undecided item
before it has one of the pairs by which the two could be alike; free items stay, and what is near to them goes. Items of n
pairs that have to share t of them share one of any n - t + 1; these are taken from the rarest ones, so that a common pair
links few items. No such list is gathered in a row, and items are only paired with those that stay. Their order is that of
numbers, given in a sorted table, so that a row for each word pair of an item is short.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import dealt, discarded, released, scratch, stored

#: Items of a list, and their grams, that a task holds at most; longer lists go in rounds.
ROWS, GRAMS = 500, 200_000


def kept_apart(rows: DataFrame, by: list[str], order: list[str], grams: str | Column) -> DataFrame:
    """The rows that stay, with all their columns. by: the columns of a list, which may be none; order: columns that put
    its items into a total order, nulls first; grams: an array of distinct strings, a column of the rows or what makes it from
    them, which is then not shuffled.

    An item goes if it shares max(1, n // 2) of its n grams with one that stays before it; one without grams stays. Rows
    that are equal in by and order go by a hash of their grams.
    """
    spark, cols = rows.sparkSession, rows.columns
    own = F.col(grams) if isinstance(grams, str) else grams
    group = F.to_json(F.struct(F.lit(0), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]))
    lists = rows.select(group.alias("_g"), F.greatest(F.coalesce(F.size(own), F.lit(0)), F.lit(0)).alias("n"))
    lists = stored(lists.groupBy("_g").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")), "lists")
    released(spark)
    is_long = (F.col("rows") > ROWS) | (F.col("grams") > GRAMS)
    n, many = lists.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(is_long)).first()
    every = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_g", group)
    if not many:
        discarded(lists)
        return _in_tasks(every, n, order, grams).select(*cols)
    long_ = stored(lists.where(is_long).select("_g"), "long")
    discarded(lists)
    short = _in_tasks(every.join(long_, "_g", "left_anti"), n, order, grams)
    rounds = _in_rounds(every.join(long_, "_g", "left_semi").withColumn("_all", own), order)
    return short.select(*cols).unionByName(rounds.select(*cols))


def _in_tasks(rows: DataFrame, n: int, order: list[str], grams: str | Column) -> DataFrame:
    """What stays of lists that a task can hold. A column of grams is shuffled as a text, which is half of an array; others are
    made after the shuffle."""
    if isinstance(grams, str):
        lists = dealt(rows.withColumn("_grams", F.to_json(grams)).drop(grams), n, "_g", each=20_000)
    else:
        lists = dealt(rows, n, "_g", each=20_000).withColumn("_grams", F.to_json(grams))
    lists = lists.sortWithinPartitions("_g", *_place(order)).drop("_id")
    at = [lists.columns.index(c) for c in ("_g", "_grams")]
    stay = lists.mapInArrow(_stays(*at), lists.schema)
    return stay.withColumn(grams, F.from_json("_grams", "array<string>")) if isinstance(grams, str) else stay


def _place(order: list[str]) -> list[Column]:
    return [*[F.col(c) for c in order], F.xxhash64("_grams"), F.col("_id")]


def _stays(of: int, said: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, having = None, 0, {}
        for batch in batches:
            stays = []
            for g, x in zip(batch.column(of).to_pylist(), batch.column(said).to_pylist(), strict=True):
                if g != now:
                    now, kept, having = g, 0, {}
                own = [gram for gram in json.loads(x) if gram is not None] if x else []
                stays.append(not _near(own, having))
                if stays[-1]:
                    for gram in own:
                        having.setdefault(gram, []).append(kept)
                    kept += 1
            yield batch.filter(pa.array(stays, pa.bool_()))

    return run


def _near(grams: list[str], having: dict[str, list[int]]) -> bool:
    """Whether max(1, n // 2) of the n grams are those of one item. having: the items that have a gram."""
    least, shared = max(1, len(grams) // 2), {}
    for gram in dict.fromkeys(grams):
        for item in having.get(gram, ()):
            shared[item] = shared.get(item, 0) + 1
            if shared[item] >= least:
                return True
    return False


def _in_rounds(rows: DataFrame, order: list[str]) -> DataFrame:
    """What stays of lists of any length; _all are the grams."""
    numbered = stored(rows.withColumn("_grams", F.to_json("_all")).orderBy("_g", *_place(order)).drop("_grams").withColumn("_id", F.monotonically_increasing_id()), "items")
    every = numbered.select("_id", F.col("_g").alias("g"), F.explode("_all").alias("gram")).where("gram IS NOT NULL")
    common = every.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = every.join(common, "gram").groupBy("_id", "g").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("x"))  # an item's own grams
    n = F.size("x")
    least = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    shaped = stored(ranked.select("_id", "g", F.transform("x", lambda x: x["gram"]).alias("grams"), least.alias("t"), (n - least + 1).alias("first")), "shaped")
    whole = lambda df: df.select("_id", "g", F.explode("grams").alias("gram"))
    stay = scratch(rows.sparkSession, "stay")
    numbered.where(F.coalesce(F.size(F.array_compact("_all")), F.lit(0)) <= 0).select("_id").write.parquet(stay)
    open_ = stored(shaped.select("_id"), "open")
    released(rows.sparkSession)
    while not open_.isEmpty():
        held = shaped.join(open_, "_id", "left_semi")
        asks = held.select("_id", "g", "t", F.explode(F.slice("grams", F.lit(1), F.col("first"))).alias("gram"))
        earliest = whole(held).groupBy("g", "gram").agg(F.min("_id").alias("before"))
        blocked = asks.join(earliest, ["g", "gram"]).where("before < _id").select("_id").distinct()
        free = stored(open_.join(blocked, "_id", "left_anti"), "free")
        released(rows.sparkSession)
        free.write.mode("append").parquet(stay)
        fresh = whole(shaped.join(free, "_id", "left_semi"))
        rest = asks.join(free, "_id", "left_anti")
        one = rest.where("t = 1").join(fresh.groupBy("g", "gram").agg(F.min("_id").alias("before")), ["g", "gram"]).where("before < _id").select("_id")
        pairs = rest.where("t > 1").select("_id", "g", "gram").join(fresh.select("g", "gram", F.col("_id").alias("other")), ["g", "gram"]).where("other < _id").select("_id", "other").distinct()
        both = pairs.join(shaped.select("_id", "t", "grams"), "_id").join(shaped.select(F.col("_id").alias("other"), F.col("grams").alias("theirs")), "other")
        gone = one.unionByName(both.where(F.size(F.array_intersect("grams", "theirs")) >= F.col("t")).select("_id")).distinct()
        left = stored(open_.join(free, "_id", "left_anti").join(gone, "_id", "left_anti"), "open")
        discarded(open_, free)
        open_ = left
        released(rows.sparkSession)
    discarded(open_, shaped)
    return numbered.join(rows.sparkSession.read.schema("_id long").parquet(stay), "_id", "left_semi")
