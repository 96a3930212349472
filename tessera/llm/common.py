"""What the operators of this subpackage share: tables, shared scratch folders, Arrow limits, text arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Folders that written() has made and nobody has deleted yet, with the thread that made each.
_paths: dict[str, int] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session with master local gets a folder of its own; on a cluster that is an error, as its
    machines don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. group: bytes of a
    row group, for long rows: a writer holds a whole group, and a reader up to 4096 rows of one."""
    spark = df.sparkSession
    path = scratch(spark, name)
    how = {} if group is None else {"parquet.block.size": group, "parquet.page.size": group // 8, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 16}
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; clear() deletes it."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _paths[path] = threading.get_ident()
    return path


def deleted(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _paths.pop(path, None)


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() stored, once no later step reads it."""
    for df in tables:
        files = df.inputFiles()[:1]
        for path in [p for p in _paths if files and p.rsplit("/", 1)[1] == files[0].rsplit("/", 2)[1]]:
            deleted(df.sparkSession, path)


def held() -> set[str]:
    """The folders that are there now, for swept()."""
    return set(_paths)


def swept(result: DataFrame, before: set[str]) -> DataFrame:
    """The result, after the tables that this thread has written since and that its plan doesn't read are deleted."""
    read = {f.rsplit("/", 2)[1] for f in result.inputFiles()}
    mine = threading.get_ident()
    for path in [p for p, thread in _paths.items() if thread == mine and p not in before and p.rsplit("/", 1)[1] not in read]:
        deleted(result.sparkSession, path)
    return result


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have left for the plans they returned, once these are consumed."""
    for path in list(_paths):
        deleted(spark, path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver's heap is
    collected, which by itself happens too seldom to bound the disk of a job of many steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_limits(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, so that a batch of long texts fits in a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker returns freed memory to the system: workers outlive their tasks, and an executor has to
    hold what all of them keep."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def drawn(rows: DataFrame, by: str, most: int, order: Column) -> DataFrame:
    """At most so many rows of (doc_id, by, text) for each value of by, the first by order, and one of each doc_id and value:
    that with the text of the smallest hash. So an id of many rows is one row, and what a model learns from is bounded."""
    one = rows.groupBy("doc_id", by).agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), F.length("text"))).alias("t")).select("doc_id", by, "t.text")
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, "doc_id"))
    return one.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def blocks_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to limit at most; an item over the limit stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, on a uint64 array."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))
