"""Exact dedup (9): cuckoo-filter index of live digests.

A shard of the index is a cuckoo filter (four 16-bit fingerprints a bucket) with the full key of every fingerprint
stored in the same slot. A fingerprint hit is only a hint: it is verified against the stored keys of its two buckets.
Keys can be inserted and deleted; when an insertion finds no place, the table doubles and is filled anew from the
stored keys. Each input partition keeps an index over its own rows and sends one entry per distinct text, so a text
that a third of all rows share arrives at its shard as one entry per partition.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SLOTS = 4
KICKS = 200
ENTRY = "digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Digest -> (smallest id, number of rows), found through a cuckoo filter.

    Digests are bytes of 16 or more. ``insert`` returns True for a new digest; ``delete`` takes rows away again and
    forgets a digest with no rows left; ``get`` returns the entry or None.
    """

    def __init__(self, buckets: int = 64):
        self._start(buckets)

    def _start(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.entries: list[list[int] | None] = [None] * (SLOTS * buckets)
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """The slot of a live digest: fingerprint hits in both buckets, verified against the stored keys."""
        mark, first, second = self._places(key)
        for bucket in (first, second) if first != second else (first,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> tuple[int, int] | None:
        slot = self._slot(key)
        return None if slot < 0 else tuple(self.entries[slot])

    def insert(self, key: bytes, row_id: int | None, rows: int = 1) -> bool:
        slot = self._slot(key)
        if slot >= 0:
            entry = self.entries[slot]
            entry[0] = min((i for i in (entry[0], row_id) if i is not None), default=None)
            entry[1] += rows
            return False
        self._place(key, [row_id, rows])
        return True

    def _free(self, bucket: int, mark: int, key: bytes, entry: list) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.prints[slot] == 0:
                self.prints[slot], self.keys[slot], self.entries[slot] = mark, key, entry
                self.size += 1
                return True
        return False

    def _place(self, key: bytes, entry: list) -> None:
        mark, bucket, second = self._places(key)
        if self._free(bucket, mark, key, entry) or self._free(second, mark, key, entry):
            return
        for kick in range(KICKS):
            slot = bucket * SLOTS + (mark + kick) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.keys[slot], key = key, self.keys[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
            if self._free(bucket, mark, key, entry):
                return
        self._resize(key, entry)

    def _resize(self, key: bytes, entry: list[int]) -> None:
        """Twice the buckets, filled from the stored keys."""
        held = [*self.items(), (key, entry)]
        self._start(2 * (self.mask + 1))
        for k, e in held:
            self._place(k, e)

    def delete(self, key: bytes, rows: int = 1) -> bool:
        """Takes rows of a digest away; the entry goes with its last row. False if the digest isn't live."""
        slot = self._slot(key)
        if slot < 0:
            return False
        self.entries[slot][1] -= rows
        if self.entries[slot][1] <= 0:
            self.prints[slot], self.keys[slot], self.entries[slot] = 0, None, None
            self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list[int]]]:
        return ((k, e) for k, e in zip(self.keys, self.entries, strict=True) if k is not None)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct digest of a partition; negative group sizes are deletions."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for key, row_id, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows > 0:
                index.insert(key, row_id, rows)
            else:
                gone.append((key, row_id, rows))
    for key, row_id, rows in gone:
        if not index.delete(key, -rows):
            raise ValueError(f"digest {key.hex()} of row {row_id} isn't live")
    out: list[tuple] = []
    for k, e in index.items():
        out.append((k, *e))
        if len(out) == 20_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k, i, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["digest", "keep_id", "group_size"])


def normalised(text: Column) -> Column:
    """The text with each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACES, " ")


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of each normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


def build_index(digests: DataFrame) -> DataFrame:
    """Index rows (digest, keep_id, group_size) of (doc_id, digest) rows, a shard a partition."""
    local = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(common.trimmed(_folded), ENTRY)
    return local.repartition("digest").mapInArrow(common.trimmed(_folded), ENTRY)


def content_of(digests: DataFrame) -> DataFrame:
    """The bucketed content of an index: (digest, doc_id, n), how many live rows an id has of a digest."""
    return digests.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))


def insert_rows(index: DataFrame, content: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, content) after inserting (doc_id, digest) rows into stored ones."""
    more = index.unionByName(build_index(digests)).repartition("digest").mapInArrow(common.trimmed(_folded), ENTRY)
    return more, content.unionByName(content_of(digests)).groupBy("digest", "doc_id").agg(F.sum("n").alias("n"))


def delete_rows(index: DataFrame, content: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, content) after deleting (doc_id, digest) rows: sizes fall, digests without rows go, and where the id that
    stayed has no row left the next smallest takes its place. A row that isn't live is an error."""
    gone = content_of(digests)
    left = content.unionByName(gone.withColumn("n", -F.col("n"))).groupBy("digest", "doc_id").agg(F.sum("n").alias("n"))
    told = F.raise_error(F.concat(F.lit("not live: digest "), F.hex("digest"), F.lit(" of row "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    left = left.where(F.when(F.col("n") < 0, told.cast("boolean")).otherwise(F.col("n") > 0))
    taken = gone.groupBy("digest").agg(F.lit(None).cast("long").alias("keep_id"), (-F.sum("n")).alias("group_size"))
    less = index.unionByName(taken).repartition("digest").mapInArrow(common.trimmed(_folded), ENTRY)
    touched = left.join(taken.select("digest").hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("first"), F.lit(True).alias("touched"))
    less = less.join(touched.hint("merge"), "digest", "left")
    return less.select("digest", F.when(F.col("touched"), F.col("first")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size"), left


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are one group. Repeated ids are rows of their own and counted; a
    null id is larger than any other. An empty table gives no rows; other columns of the input are not looked at.
    """
    digests = common.written(text_digests(docs, id_col, text_col), "digests")
    index = build_index(digests)
    joined = digests.join(index.hint("merge"), "digest")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
