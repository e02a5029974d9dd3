"""Writing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a temporary folder only where none is set on one machine, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of finished phases.

    Checkpoints cut lineage, but files go only when the driver has collected the
    objects that stand for them, which a driver with memory to spare puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
