"""First/last rows, top-k and numbering that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.joins import broadcast_if_small
from factledger.session import cut_lineage


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each group.

    Written as ``row_number() <= k`` so that Spark plans a group limit ahead of
    the shuffle: every task sends at most ``k`` rows of a group, however large
    the group is.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of the last row per key (later rows overwrite earlier ones)."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def numbered(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    name: str = "row_no",
    start: int = 1,
) -> DataFrame:
    """Running number per group (or overall), without a single-task window.

    Rows are range partitioned by (keys, order) and sorted inside partitions, so
    a large group is spread over many tasks. The placement is written to the
    shared folder once; per-partition counts then give each partition its offset.
    The only window runs over one row per (group, partition).
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND((1 << 33) - 1)
    )
    placed = cut_lineage(placed.drop("_at"))

    held = placed.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *[F.col(k).alias(f"_key{i}_of_offset") for i, k in enumerate(keys)],
        F.col("_part").alias("_part_of_offset"),
        "_first",
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col("_part") == F.col("_part_of_offset")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}_of_offset"))
    number = (F.col("_pos") - F.col("_first") + F.col("_offset") + F.lit(start)).cast("bigint")
    # one offset per (group, partition): when that is few, the rows are not shuffled a second time
    return placed.join(broadcast_if_small(offsets), same).withColumn(name, number).select(*df.columns, name)


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """An ordered listing with each row's place in it, from 1.

    A sort leaves its partitions in order, so a row's place is its place in the
    partition plus the rows of the partitions before; there is one such start per
    partition.
    """
    placed = cut_lineage(df.withColumn("_listed", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_listed", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("_part").agg(F.count("*").alias("_held"))
    starts = held.select("_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_listed").bitwiseAND((1 << 33) - 1)
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, (inside + F.col("_start") + 1).cast("bigint")).select(*df.columns, name)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` up to and including each row, per group; a large group is spread over many tasks.

    Rows are range partitioned by (keys, order) and written once. Windows run inside
    (group, partition); one row per (group, partition) gives each its start.
    """
    placed = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy(*keys, "_part").agg(F.sum(amount).alias("_held"))
    starts = held.select(
        *[F.col(k).alias(f"_key{i}_of_start") for i, k in enumerate(keys)],
        F.col("_part").alias("_part_of_start"),
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_start"),
    )
    same = F.col("_part") == F.col("_part_of_start")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}_of_start"))
    summed = placed.withColumn("_sum", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = summed.join(broadcast_if_small(starts), same)
    return joined.withColumn(name, F.col("_sum") + F.col("_start")).select(*df.columns, name)

