"""Rendezvous hashing of stable keys over weighted shards.

Every shard draws a number for every key; the key goes to the shard with the
largest ``weight / -ln(u)``. The draws of the old shards do not change when a
shard is added, so rows move only into the new shard, and only its share of them.

Defined results: a null key is the empty key; rows with one key share a shard;
an empty table gives no rows; columns other than those named are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import stored, whole

DIGITS = 13  # 52 bits of a digest, exact in a double
LANES = 4096


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """One struct (score, -shard) per shard, in shard order."""
    table = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def draw(shard: Column) -> Column:
        digest = F.md5(F.concat(key_text(key), F.lit("#"), shard["n"].cast("string")))
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return F.struct((-shard["w"] / F.ln(u)).alias("score"), (-shard["n"]).alias("back"))

    return F.transform(table, draw)


def winner(scores: Column, shards: int | None = None) -> Column:
    """The best shard among the first ``shards`` draws; equal scores go to the smaller number."""
    held = scores if shards is None else F.slice(scores, 1, shards)
    return (-F.array_max(held)["back"]).cast("int")


def assign(
    docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] = (1.0,)
) -> DataFrame:
    """``docs`` with ``shard`` among ``weights`` and ``grown_shard`` once the shards ``grown`` are added."""
    scores = draws(F.col(key), [*weights, *grown])
    held = docs.withColumn("_draws", scores)
    return (
        held.withColumn("shard", winner(F.col("_draws"), len(weights)))
        .withColumn("grown_shard", winner(F.col("_draws")))
        .drop("_draws")
    )


def with_slots(rows: DataFrame, order: Sequence[str], shard: str = "shard") -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    A shard is cut into 4,096 lanes by a digest of the ``order`` columns. Windows
    number the rows inside a lane; the lanes' counts (at most shards x 4,096
    rows, which is what bounds the broadcast) give each lane its start. Rows equal
    in all ``order`` columns are interchangeable.
    """
    spread = F.concat_ws("#", *[key_text(F.col(c)) for c in order])
    lane = F.conv(F.substring(F.md5(spread), 1, 3), 16, 10).cast("int")
    held = stored(rows.withColumn("_lane", lane), "slots")
    counts = held.groupBy(shard, "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_lane").orderBy(*order)) - 1
    return (
        held.withColumn("_at", inside)
        .join(F.broadcast(starts), [shard, "_lane"])
        .withColumn("slot", (F.col("_start") + F.col("_at")).cast("bigint"))
        .select(*rows.columns, "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size, checksum, shard, slot and the shard after one more is added."""
    slim = docs.select(
        "doc_id",
        (F.octet_length(whole("text")) + 1).cast("bigint").alias("size"),
        F.crc32(whole("text")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(slim, "doc_id", (1.0,) * shards, (1.0,))
    out = with_slots(placed, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
