"""Parquet tables as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FEW_SPLITS = 64  # at most about 8 GB of input


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet table; one with a handful of splits is spread over the cores.

    Large tables keep their splits, so nothing of size is shuffled here.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(cores + 1, _FEW_SPLITS):
        df = df.repartition(cores)
    return df
