"""Idempotent ingest: mapped rows into stored tables, with a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators.merge import insert_absent, merge_rows, replace_groups

ARRIVAL = ["fetched_at"]


def ingest_people(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by person id; an empty new name keeps the old one and the id map is never replaced."""
    keyed = new.filter(F.col("person_id").isNotNull())
    return merge_rows(
        stored,
        keyed,
        ["person_id"],
        ARRIVAL,
        keep_first=["external_ids", "current_party"],
        keep_present=["full_name"],
    )


def ingest_roles(stored: DataFrame, new: DataFrame, fetched_people: DataFrame) -> DataFrame:
    """Replace the roles of everyone whose positions were fetched."""
    return replace_groups(stored, new, ["person_id"], fetched_people)


def ingest_bills(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by bill id; a bill without a new detail row keeps what is stored."""
    return merge_rows(stored, new.filter(F.col("bill_id").isNotNull()), ["bill_id"], ARRIVAL)


def ingest_sponsorships(stored: DataFrame, new: DataFrame, bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest row per (person, bill); initiations of unknown bills are returned as rejects."""
    known = new.join(bills.select("bill_id"), "bill_id", "left_semi").select(*new.columns)
    rejects = new.join(bills.select("bill_id"), "bill_id", "left_anti")
    return merge_rows(stored, known, ["person_id", "bill_id"], ARRIVAL), rejects


def ingest_vote_events(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Insert headers not stored yet; stored ones are never updated."""
    return insert_absent(stored, new.filter(F.col("event_id").isNotNull()), ["event_id"], ARRIVAL)


def ingest_votes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Last stance per (person, event)."""
    return merge_rows(stored, new, ["person_id", "event_id"], ARRIVAL)


STATISTIC_KEY = ["metric", "dimension_type", "dimension_value", "period"]


def ingest_statistics(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert a catalog; a null period equals a null period, and an update only
    touches value, unit, notes and link. ``new`` carries ``pos``."""
    updated = {"value", "unit", "notes", "source_url"}
    fixed = [c for c in stored.columns if c not in updated and c not in STATISTIC_KEY]
    return merge_rows(stored, new, STATISTIC_KEY, ["pos"], keep_first=fixed)


def report(**counted: DataFrame) -> DataFrame:
    """Row counts of several outputs of a run, one row per name."""
    out = None
    for name, df in counted.items():
        part = df.agg(F.lit(name).alias("output"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out
