"""Session helpers: where shared intermediate files go, and how tables are read."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "corpuscle", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSCLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in equal parts over all cores where it comes in no more tasks than there are cores, for work that costs far more than moving the rows.

    A small file is often one row group, which leaves all but one of its tasks empty. A large table comes in
    more tasks than cores and is left where it is; so is a stream.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() <= cores else df


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python workers in Arrow batches of so many rows at most, so that a worker's memory stays small beside the texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in a local session with nothing set is a folder of this machine used; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpuscle-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stash/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or stash_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: How many bytes of rows a byte of Parquet may stand for; graph tables (repeated keys, few nodes) come to 20 and more.
UNPACKED = 20


def stash_sized(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, int]:
    """``df`` as by ``stash``, and the bytes of its files."""
    path = path or stash_path(df.sparkSession, name)
    out = stash(df, name, path)
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return out, where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def unbroadcast(df: DataFrame, size: int) -> DataFrame:
    """``df`` (``size`` bytes of Parquet) with a hint against its broadcast, unless its rows are few: Spark goes by the files' size, and the driver has to hold the rows."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.hint("merge") if size * UNPACKED > limit else df


def stash_wide(df: DataFrame, name: str) -> DataFrame:
    """``df`` as by ``stash``, kept from broadcasts unless its rows are few."""
    return unbroadcast(*stash_sized(df, name))


def stash_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same as a table bucketed by ``key``, so that later joins on it move only their other side."""
    spark = df.sparkSession
    path = stash_path(spark, name)
    table = "stash_" + path.rpartition("-")[2]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stash that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Stashes of one operator; those that no later step reads are deleted by ``clear``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(stash_path(self.spark, name))
        return stash(df, name, self.paths[-1])

    def stash_wide(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(stash_path(self.spark, name))
        return unbroadcast(*stash_sized(df, name, self.paths[-1]))

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
