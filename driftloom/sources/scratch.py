"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local folder is set, which only a local master can share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="driftloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialise(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage: lost executors
    cost no recomputation past this point. The files go with discard(), or when the application's file system closes.
    large_rows: rows of a megabyte or so, a page each, which keeps what readers and writers buffer small."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/driftloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    pages = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if large_rows else {}
    df.write.options(**pages).parquet(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again (what a later table has replaced), and lets Spark drop the shuffle
    files of queries that have ended."""
    for df in tables:
        spark = df.sparkSession
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    if tables:
        spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, most_bytes_a_core: int = 64 << 20) -> DataFrame:
    """Over all cores, for work that is heavy for its bytes. Only small inputs move: one that is larger than most_bytes_a_core for each core
    already comes in as many partitions, and stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * most_bytes_a_core else df
