"""Skew-safe exact deduplication.

Copies are combined three times: inside every input partition (the map side of
the first grouping), then per salted digest group, then over the salts. Each
grouping has the whole normalised text among its keys, so texts are compared in
full at every stage and different texts with one digest are never merged. A text
that a third of all rows hold leaves each partition as one row.

Defined results: a null text is empty; texts of white space only are one group;
among equal texts the row with the most code points stays, then the smallest id,
null ids last; rows that repeat both id and text share their decision; an empty
table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import SPACE, stored, whole

SALTS = 32


def normalised(text: Column | str) -> Column:
    """The text without ASCII white space."""
    return F.translate(whole(text), SPACE, "")


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        normalised("text").alias("body"),
        F.char_length(whole("text")).alias("length"),
    ).withColumn("digest", digest(F.col("body")))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct body: digest, body, the id and length of the row that stays, and the group's size."""
    # the longest text, then the smallest id, as one fixed-width number that a hash aggregate updates in place
    rank = (
        F.col("length").cast("decimal(10,0)") * F.expr("18446744073709551616BD")
        - F.coalesce(F.col("id").cast("decimal(20,0)"), F.expr("9223372036854775808BD"))
    ).cast("decimal(38,0)")
    best = [
        F.max_by("id", "rank").alias("id"),
        F.max_by("length", "rank").alias("length"),
        F.max("rank").alias("rank"),
    ]
    ranked = rows.withColumn("rank", rank).withColumn("salt", F.spark_partition_id() % salts)
    salted = ranked.groupBy("digest", "body", "salt").agg(*best, F.count("*").alias("n"))
    merged = salted.groupBy("digest", "body").agg(*best, F.sum("n").alias("n"))
    return merged.select(
        "digest",
        "body",
        F.col("id").alias("keep_id"),
        F.col("length").alias("keep_length"),
        F.col("n").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the digest of its normalised text.

    Rows find their group by the digest. Digests that several different texts
    share (none, with a good digest) are found by a count of the groups, and
    their rows are joined on the whole text instead.
    """
    rows = _rows(docs, digest)
    groups = stored(combine(rows, salts).drop("body"), "exact-groups")
    slim = rows.select("id", "length", "digest", F.sha2("body", 256).alias("text_sha256"))
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if shared.isEmpty():
        found = slim.join(groups.filter("group_size > 1"), "digest", "left")
    else:
        alone = groups.join(shared, "digest", "left_anti").filter("group_size > 1")
        rest = rows.join(shared, "digest", "left_semi")
        by_text = rest.withColumn("text_sha256", F.sha2("body", 256)).join(combine(rest, salts), ["digest", "body"])
        found = (
            slim.join(shared, "digest", "left_anti")
            .join(alone, "digest", "left")
            .unionByName(by_text.select("digest", "id", "length", "text_sha256", "keep_id", "keep_length", "group_size"))
        )
    single = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")))).alias("kept"),
        "text_sha256",
    )
