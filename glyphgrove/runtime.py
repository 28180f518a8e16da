"""Session-level helpers shared by every operator: table access and durable cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable cuts.

    The session's ``spark.checkpoint.dir`` is used as it stands. Where it is unset, a temporary folder
    is taken in local mode only; on a cluster an unset folder is an error, because a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="glyphgrove-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` before Python work, in pieces of the size that adaptive execution aims at.

    A table of one file with one row group is one task however long its rows take, and its number of splits doesn't
    tell so. The pieces are measured as they are written: small ones are joined, large ones split, at every size alike.
    """
    return df.hint("rebalance", *keys)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, one row per key, laid out so that a join by ``keys`` must shuffle it itself.

    A join with an aggregate on its own keys reads the aggregate's partitioning, and adaptive execution splits a hot key
    only where both sides of a join were shuffled for it. One more shuffle of the aggregate buys that.
    """
    return df.repartition(F.xxhash64(*keys))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and cut its lineage there.

    Loss of an executor afterwards costs nothing but a re-read of those files. Readers take the columns that they need,
    and joins know the table's size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/glyphgrove-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
