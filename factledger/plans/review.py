"""Findings store: merge of new findings, review decisions, leaderboard and counters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import PUBLISHED_FINDING_STATUSES
from factledger.functions.numbers import percent_of_max
from factledger.operators.merge import insert_absent, not_in, union_keys
from factledger.operators.ranking import numbered, top_rows

FINDING_KEY = ["person_id", "video_id", "quote"]
WATCH_URL = "https://www.youtube.com/watch?v="  # fixed value


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "contradicted").alias("contradicted"),
        F.count_if(F.col("outcome") == "consistent").alias("consistent"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed"),
    )


def finding_digest() -> Column:
    """A digest of person, video and quote, so that whole quotes are no shuffle keys; null differs from empty."""
    return F.unhex(F.sha2(F.to_json(F.struct(*FINDING_KEY)), 256))


def merge_findings(stored: DataFrame, new: DataFrame, retracted: DataFrame) -> DataFrame:
    """Stored findings plus the confirmed new ones that are neither stored nor retracted.

    Keys compare null-safe; among new rows with one key the first (by ``pos``)
    is kept. Ids continue from the highest stored one.
    """
    known = union_keys(*[f.select(finding_digest().alias("_key")) for f in (stored, retracted)])
    confirmed = new.filter(F.col("status") == "confirmed").withColumn("_key", finding_digest())
    fresh = not_in(top_rows(confirmed, ["_key"], ["pos"]), known, ["_key"]).withColumns(
        {
            "url": F.concat(F.lit(WATCH_URL), F.coalesce(F.col("video_id").cast("string"), F.lit("None"))),
            "id": F.lit(None).cast("string"),
        }
    )
    columns = [c for c in stored.columns]
    return assign_ids(stored.unionByName(fresh.select(*columns)))


def assign_ids(findings: DataFrame) -> DataFrame:
    """Give findings without an id the next ``F-0001`` style ids, in ``pos`` order."""
    number = F.regexp_extract(F.coalesce("id", F.lit("")), r"^F-(\d+)$", 1).try_cast("bigint")
    has_id = F.coalesce(F.col("id"), F.lit("")) != ""
    keyed = findings.filter(has_id)
    top = keyed.agg(F.coalesce(F.max(number), F.lit(0))).scalar()
    bare = numbered(findings.filter(~has_id), ["pos"], name="_no")
    return keyed.unionByName(bare.withColumn("id", finding_id(top + F.col("_no"))).drop("_no"))


def finding_id(number: Column) -> Column:
    """``F-0001`` style id: at least four digits, longer numbers in full."""
    digits = number.cast("string")
    return F.concat(F.lit("F-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept findings (with affirmation and note) and the keys of rejected ones.

    The last decision per id wins; findings without a decision are kept.
    """
    last = (
        decisions.filter(F.coalesce("id", F.lit("")) != "")
        .groupBy("id")
        .agg(F.max_by(F.struct("decision", "note"), "pos").alias("d"))
    )
    judged = findings.join(last, "id", "left")
    decision = F.coalesce(F.col("d.decision"), F.lit(""))
    rejected = judged.filter(decision == "reject").select(*FINDING_KEY)
    kept = judged.filter(decision != "reject").withColumns(
        {
            "affirmed": F.when(decision == "confirm", F.lit(True)),
            "review_note": F.when(decision == "confirm", F.nullif(F.col("d.note"), F.lit(""))),
        }
    )
    return kept.select(*findings.columns, "affirmed", "review_note"), rejected


def extend_blocklist(retracted: DataFrame, rejected: DataFrame) -> DataFrame:
    return union_keys(retracted.select(*FINDING_KEY), rejected.select(*FINDING_KEY)).orderBy(*FINDING_KEY)


def public_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status") == "confirmed")


def extend_backlog(backlog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Claims still lacking a statistic, deduplicated on (person, video, quote)."""
    return insert_absent(backlog, wanted, FINDING_KEY, ["pos"])


def extend_ledger(ledger: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Adjudicated ranking claims, deduplicated on (speaker, claim)."""
    return insert_absent(ledger, adjudications, ["speaker_name", "claim"], ["pos"])


def findings_leaderboard(
    findings: DataFrame, roster: DataFrame, statuses: Iterable[str] = PUBLISHED_FINDING_STATUSES
) -> DataFrame:
    """People by human-published contradicted findings.

    Name from the roster (last row per id), else the last finding's name, else the id.
    """
    counted = (
        findings.filter(F.col("outcome") == "contradicted")
        .filter(F.col("status").isin(*statuses) & F.col("person_id").isNotNull())
        .groupBy("person_id")
        .agg(F.count("*").alias("contradicted_count"), F.max_by("speaker_name", "pos").alias("last_name"))
    )
    people = roster.groupBy("person_id").agg(F.max_by(F.struct("name", "party"), "pos").alias("r"))
    blank = F.lit("")
    return (
        counted.join(people, "person_id", "left")
        .select(
            F.concat(F.lit("person-"), F.col("person_id").cast("string")).alias("slug"),
            F.coalesce(
                F.nullif(F.col("r.name"), blank), F.nullif(F.col("last_name"), blank), F.col("person_id").cast("string")
            ).alias("full_name"),
            F.when(F.col("r").isNull(), blank).otherwise(F.col("r.party")).alias("party"),
            "contradicted_count",
        )
        .orderBy(F.desc("contradicted_count"), "slug")
    )


def with_bars(board: DataFrame, count: str = "contradicted_count") -> DataFrame:
    """Bar width of every row relative to the largest count (never below 1).

    The maximum is a scalar subquery, so rows are not moved for it.
    """
    top = board.agg(F.max(F.col(count).cast("double"))).scalar()
    return board.withColumn("bar", percent_of_max(F.col(count).cast("double"), top))


def profile_findings(findings: DataFrame, person: Column | str) -> DataFrame:
    """Findings shown on a profile: contradicted by data, or by the person's own words."""
    shown = (F.col("outcome") == "contradicted") | (F.col("type") == "self_contradiction")
    return findings.filter(F.col("person_id").cast("string") == F.lit(str(person))).filter(
        F.coalesce(shown, F.lit(False))
    )


def contradictions_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.when(F.col("outcome") == "contradicted", 0).otherwise(1), "pos")


def with_topic(board: DataFrame, topic: str = "all") -> DataFrame:
    """Leaderboard rows of one topic; 'all' keeps every row."""
    return board if topic == "all" else board.filter(F.coalesce(F.array_contains("topics", topic), F.lit(False)))
