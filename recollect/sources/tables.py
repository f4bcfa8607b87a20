"""Readers. Every path goes through Spark, so any Hadoop file system works."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` from the shared checkpoint folder: lineage ends there and a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a shared folder")
        context.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)
