"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine without that setting (a test) gets a temporary folder there.  On a
    cluster no folder of the driver's will do, so the setting must be there."""
    if (folder := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return folder
    if (folder := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Runs the plan so far and keeps its rows in the shared folder, so that lost executors lose none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle and checkpoint files of steps that nothing refers to any longer.

    The cleaner goes by the driver's garbage collection, which a driver with little to do may put off until long after
    the files of a first step stand beside those of the last.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written, wherever it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
