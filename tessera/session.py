"""Session defaults and table access shared by every part of the engine."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may be any URI that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt evenly over the cluster's tasks, or those of each value of by together: for steps whose work is far larger
    than the files that the rows come from, as Spark makes tasks by the size of files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def dealt(df: DataFrame, rows: int, *by: str, each: int = 100_000) -> DataFrame:
    """The rows of each value of by together, in as many tasks as hold about each of so many rows: what a task has to sort or
    collect doesn't grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *by)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, spark.checkpoint.dir; a local session without it has
    one of its own, and a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the plan, and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that stored() has written, once no later step reads them."""
    for df in tables:
        files = df.inputFiles()[:1]
        if files and "/tessera/" in files[0]:
            deleted(df.sparkSession, files[0].rsplit("/", 1)[0])


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() has named."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so when the driver's heap is collected, which by
    itself is too seldom to bound the disk of a job of many steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
