"""Published outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import DIMENSION_WEIGHTS, DISCLAIMER_EN, DISCLAIMER_HE, VOTES_NOTE
from factledger.functions.text import person_slug
from factledger.operators.merge import merge_rows
from factledger.plans.listings import recent_votes, sample_bills
from factledger.plans.scorecard import dimension_lists, scorecards


def write_by_person(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Files partitioned by person.

    The rebalance puts a person's rows together, so tasks do not write one tiny
    file per person each, and splits a person too large for one task.
    """
    placed = df.withColumn("pid", F.col("person_id")).hint("rebalance", "pid")
    writer = placed.write.mode("overwrite").partitionBy("pid")
    writer.option("maxRecordsPerFile", rows_per_file).json(path)


def write_index(df: DataFrame, path: str) -> None:
    """Compressed JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def person_profiles(
    people: DataFrame,
    roles: DataFrame,
    votes: DataFrame,
    events: DataFrame,
    sponsorships: DataFrame,
    bills: DataFrame,
    generated_at: Column,
    sources: Mapping[str, str],
    weights: Mapping[str, float] = DIMENSION_WEIGHTS,
) -> DataFrame:
    """One whole nested document per person.

    Votes and sponsorships are each grouped once for the counts and the scorecard,
    and cut once to the page the document shows (twenty votes, twelve bills per
    person), so the nested lists are bounded. The rest joins per-person tables.
    """
    head = ["person_id", "official_id", "full_name", "first_name", "last_name", "is_current", "party", "source_url"]
    cards = scorecards(dimension_lists(people, votes, sponsorships, weights))
    bill = F.struct("bill_no", "bill_id", "name", "term_num", "is_lead_initiator", "bill_url")
    vote = F.struct("recent_no", "stance", "event_title", "event_date", "source_url")
    bill_lists = sample_bills(sponsorships, bills).groupBy("person_id").agg(
        F.sort_array(F.collect_list(bill)).alias("sample_bills")
    )
    vote_lists = recent_votes(votes, events).groupBy("person_id").agg(
        F.sort_array(F.collect_list(vote)).alias("recent_votes")
    )
    held = roles.groupBy("person_id").agg(F.count("*").alias("roles"))
    out = people.select("person_id", F.struct(*head).alias("politician"))
    for part in (cards, held, bill_lists, vote_lists):
        out = out.join(part, "person_id", "left")
    index = F.struct(
        F.col("index_value").alias("value"), "coverage_scored", "coverage_total", "label", "included", "weights_used"
    )
    scorecard = F.struct(
        index.alias("index"),
        "dimensions",
        F.lit(DISCLAIMER_HE).alias("disclaimer_he"),
        F.lit(DISCLAIMER_EN).alias("disclaimer_en"),
        F.array_compact(F.array("note")).alias("notes"),
    )
    none = F.lit(0).cast("bigint")
    counts = F.struct(F.coalesce("roles", none).alias("roles"), "bills", "votes")
    places = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    slug = person_slug(F.col("politician.official_id"), F.col("person_id"))
    return out.select(
        "person_id",
        slug.alias("slug"),
        F.lit(1).alias("schema_version"),
        generated_at.alias("generated_at"),
        "politician",
        counts.alias("counts"),
        F.format_string(VOTES_NOTE, "votes").alias("votes_ingested_note"),
        scorecard.alias("scorecard"),
        F.coalesce("sample_bills", F.array().cast(bill_lists.schema["sample_bills"].dataType)).alias("sample_bills"),
        F.coalesce("recent_votes", F.array().cast(vote_lists.schema["recent_votes"].dataType)).alias("recent_votes"),
        places.alias("sources"),
    )


def update_manifest(manifest: DataFrame, profiles: DataFrame) -> DataFrame:
    """Manifest rows replaced by slug (last one wins)."""
    rows = profiles.select(
        "slug",
        "full_name",
        F.col("party"),
        F.concat("slug", F.lit(".json")).alias("file"),
        "index_value",
        F.lit(0).alias("pos"),
    )
    return merge_rows(manifest, rows, ["slug"], ["pos"])


def write_findings(findings: DataFrame, store_path: str, public_path: str) -> None:
    """Internal store and its public subset (confirmed findings only)."""
    from factledger.plans.review import public_findings

    findings.write.mode("overwrite").parquet(store_path)
    stored = findings.sparkSession.read.parquet(store_path)
    public_findings(stored).write.mode("overwrite").json(public_path)
