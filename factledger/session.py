"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are planned for.

    AQE sizes shuffle partitions, turns joins into broadcasts only after it has
    measured the side, and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``; a session without the setting is an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder (nothing is created yet)."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_tasks(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound what one task reads of a file or a shuffle, for sorts of whole partitions; smaller settings stay.

    A task sorts what it reads, so its memory follows these two sizes and not the table.
    """
    _at_most(spark, most, "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bound what a Python worker is sent at once, for rows of several MB; smaller settings stay."""
    _at_most(spark, most, "spark.sql.execution.arrow.maxBytesPerBatch")


def _at_most(spark: SparkSession, most: int, *keys: str) -> None:
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in keys:
        if not 0 < to_bytes(str(spark.conf.get(key))) <= most:
            spark.conf.set(key, f"{most}b")
