"""Where long plans are cut: tables written to the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A private one is made only in local mode, and only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="weftline-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def own_folder(spark: SparkSession) -> str:
    """A new name below the checkpoint folder, deleted when the application ends."""
    folder = f"{checkpoint_folder(spark)}/weftline-{uuid.uuid4().hex}"
    _forget(spark, folder)
    return folder


def cut(df: DataFrame, *by: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later uses neither recompute it nor lose it with an executor.

    The files are compressed columns, so a later use reads only what it needs; with `by`, one folder for each of the few
    values of these columns. They go when the application ends.
    """
    spark = df.sparkSession
    folder = own_folder(spark)
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _forget(spark: SparkSession, folder: str) -> None:
    """Lets the folder's file system delete it when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
