"""Entity graph as node and edge tables; the path question is three equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators.merge import merge_rows

PROVENANCE = ["source_type", "source_url", "fetched_at"]


def duplicate_keys(nodes: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one node; empty when the uniqueness rule holds."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def upsert_nodes(
    stored: DataFrame, new: DataFrame, key: str, order: Sequence[str], keep_present: Sequence[str] = ()
) -> DataFrame:
    """Merge nodes by key: latest attributes and provenance win, ``keep_present``
    attributes survive a missing new value, rows without a key are refused."""
    return merge_rows(stored, new.filter(F.col(key).isNotNull()), [key], order, keep_present=keep_present)


def upsert_edges(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], keep_present: Sequence[str] = ()
) -> DataFrame:
    """Merge edges by (endpoints, type); provenance is refreshed."""
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return merge_rows(stored, new.filter(present), keys, order, keep_present=keep_present)


def ownership_edges(links: DataFrame) -> DataFrame:
    """Type OWNS or CONTROLS from the ``controls`` flag."""
    kind = F.when(F.coalesce("controls", F.lit(False)), "CONTROLS").otherwise("OWNS")
    return links.withColumn("rel_type", kind).drop("controls")


def endpoints(edges: DataFrame, column: str | Column, key: str) -> DataFrame:
    """Nodes an edge table implies (endpoints are created when absent)."""
    source = F.col(column) if isinstance(column, str) else column
    return edges.select(source.alias(key)).filter(F.col(key).isNotNull()).distinct()


def add_missing(nodes: DataFrame, implied: DataFrame, key: str) -> DataFrame:
    fresh = implied.join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True)


def award_paths(related: DataFrame, owned: DataFrame, awarded: DataFrame) -> DataFrame:
    """Politician - relative - company - tender paths.

    Distinct edges only, joined from the rarest side inwards; every join is an
    equi-join on a node key, so a hot company or person is split by AQE.
    """
    kin = related.select("person_key", "relation", F.col("name").alias("relative")).distinct()
    own = owned.select(F.col("name").alias("relative"), "rel_type", "registration_id").distinct()
    won = awarded.select("registration_id", "tender_id").distinct()
    return kin.join(own, "relative").join(won, "registration_id").select(
        "person_key", "relation", "relative", "rel_type", "registration_id", "tender_id"
    )


def path_counts(related: DataFrame, owned: DataFrame, awarded: DataFrame) -> DataFrame:
    """Number of paths and distinct companies per politician without listing the paths.

    Awards are counted per company before the joins.
    """
    won = awarded.select("registration_id", "tender_id").distinct().groupBy("registration_id")
    won = won.agg(F.count("*").alias("tenders"))
    own = owned.select(F.col("name").alias("relative"), "rel_type", "registration_id").distinct()
    kin = related.select("person_key", "relation", F.col("name").alias("relative")).distinct()
    reach = own.join(won, "registration_id").groupBy("relative")
    reach = reach.agg(F.sum("tenders").alias("paths"), F.count("*").alias("holdings"))
    return (
        kin.join(reach, "relative")
        .groupBy("person_key")
        .agg(F.sum("paths").alias("paths"), F.sum("holdings").alias("holdings"))
    )
