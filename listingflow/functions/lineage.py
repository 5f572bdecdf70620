"""Cutting lineage, so that a lost executor does not replay a whole job."""

import gc
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where the session names none, a local one gets a temporary folder; a cluster
    has no folder that could stand in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, materialised in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession, again: float = 0) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing needs any more.

    Its cleaner acts on what the driver has collected as garbage, which a quiet
    driver does not do for a long time. Between the rounds of a job of many, that
    keeps disks from holding all rounds at once. What the very last job left is let
    go by a second sweep, so many seconds later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if again:
        time.sleep(again)
        sweep(spark)


def step(df: DataFrame) -> DataFrame:
    """cut, after a sweep: while df is made, what steps before the last one left goes
    from disk. (What the last one left is still held by the driver's JVM for a moment.)"""
    sweep(df.sparkSession)
    return cut(df)


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many (narrow) rows.

    Beyond that Spark joins by shuffle and adaptive execution splits hot keys.
    df should be cheap to read twice, as a checkpointed one is.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
