"""Shared storage for intermediate tables.

Lineage is cut only through reliable storage: the folder the cluster names in
``spark.checkpoint.dir``. A folder of our own is made only where that is unset
and driver and executors are one local process; elsewhere that is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def multiplied(df: DataFrame) -> DataFrame:
    """Rows that an explode has multiplied, or that come out of such rows: their joins sort both sides.

    The size estimate of Spark does not see the explode (nor what compression saves in a file), so it would take them for a
    small table, collect them on the driver and send them whole to every executor.
    """
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named is None and jsc.getCheckpointDir().isDefined():
        named = jsc.getCheckpointDir().get()
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-skytable-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, for tables that are removed when they are no longer needed."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables in the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no DataFrame needs any more.

    It does so when the driver collects its garbage, which a driver with memory to spare seldom does by itself; a job of
    many rounds would keep the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
