"""Cutting lineage in loops, and the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir); one of our own where all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return f"{(where or _own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that executors share, so that a lost one costs a step and not the loop.

    Where all runs on one machine and no folder is set, one of our own is taken; on a cluster that fails.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()
