"""Join sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

SMALL_BYTES = 32 << 20
WORD = 8


def value_bytes(value: Column, kind: DataType) -> Column:
    """About what a value takes in a row: its fixed slot, and its length where that varies."""
    if isinstance(kind, StringType | BinaryType):
        extra = F.octet_length(value)
    elif isinstance(kind, ArrayType | MapType | StructType):
        extra = F.octet_length(F.to_json(value)) if not isinstance(kind, StructType) or kind.fields else F.lit(0)
    else:
        extra = F.lit(0)
    return F.coalesce(extra, F.lit(0)).cast("bigint") + 2 * WORD


def table_bytes(df: DataFrame) -> int:
    """About the bytes of ``df`` as rows, in one aggregate over all tasks."""
    row = F.lit(WORD).cast("bigint")
    for field in df.schema.fields:
        row = row + value_bytes(df[field.name], field.dataType)
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its rows take at most ``max_bytes``, else leave the join to a shuffle.

    It is meant for lookups that are cheap to read again (written tables, or
    reductions of them), next to a large side that should not be shuffled only
    because the planner cannot see how small the lookup is. Beyond the bound,
    AQE splits skewed partitions.
    """
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df
