"""Partition layout of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input of few splits over the cores before costly per-row work.

    A small file with one row group is read by one task, and broadcast joins
    keep it there. Inputs with at least as many splits as cores are left alone,
    so on large tables this changes nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
