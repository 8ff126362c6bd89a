"""Participation scorecard and the coverage-aware composite index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import (
    DIMENSION_LABELS,
    DIMENSION_NOTES,
    DIMENSION_WEIGHTS,
    INDEX_NOTE,
    PENDING_DIMENSIONS,
    VOTE_STANCES,
)
from factledger.functions.numbers import round_half_even

CAST_STANCES = ("for", "against", "abstain")


def stance_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("person_id", "stance").agg(F.count("*").alias("n"))


def participation(votes: DataFrame, *extra: str) -> DataFrame:
    """Votes cast out of votes eligible (unknown stances do not count), for all people at once; ``extra``: ``votes``."""
    counts = votes.groupBy("person_id").agg(
        F.count("*").alias("votes"), *[F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in VOTE_STANCES]
    )
    cast = sum((F.col(f"n_{s}") for s in CAST_STANCES), F.lit(0))
    eligible = F.col("eligible")
    shares = F.map_filter(
        F.create_map(*[x for s in VOTE_STANCES for x in (F.lit(s), F.col(f"n_{s}"))]), lambda _, n: n > 0
    )
    return counts.withColumns({"cast": cast.cast("bigint"), "absent": F.col("n_absent")}).withColumn(
        "eligible", F.col("cast") + F.col("absent")
    ).select(
        "person_id",
        "cast",
        "absent",
        "eligible",
        F.when(eligible > 0, round_half_even(F.col("cast") / eligible * 100, 1)).alias("score"),
        shares.alias("by_stance"),
        *extra,
    )


def legislative_activity(sponsorships: DataFrame) -> DataFrame:
    return sponsorships.groupBy("person_id").agg(
        F.count("*").alias("bills_sponsored"),
        F.count_if(F.coalesce(F.col("is_initiator"), F.lit(False))).alias("as_lead_initiator"),
    )


def dimension_lists(
    people: DataFrame,
    votes: DataFrame,
    sponsorships: DataFrame,
    weights: Mapping[str, float] = DIMENSION_WEIGHTS,
) -> DataFrame:
    """Per person: the numbers of votes and sponsorships, and all dimensions, scored or pending, as one list."""
    base = (
        people.select("person_id")
        .join(participation(votes, "votes"), "person_id", "left")
        .join(legislative_activity(sponsorships), "person_id", "left")
    )
    eligible = F.coalesce("eligible", F.lit(0))
    sponsored = F.coalesce("bills_sponsored", F.lit(0))
    zero = F.lit(0)

    def dim(no: int, key: str, available: Column, scorable: Column, score: Column, raw: Column):
        label_he, label_en = DIMENSION_LABELS[key]
        source_note, method, reason = DIMENSION_NOTES[key]
        return F.struct(
            F.lit(no).alias("dimension_no"),
            F.lit(key).alias("key"),
            F.lit(label_he).alias("label_he"),
            F.lit(label_en).alias("label_en"),
            available.alias("available"),
            scorable.alias("scorable"),
            score.cast("double").alias("score"),
            F.lit(float(weights.get(key, 0.0))).alias("weight"),
            raw.alias("raw"),
            F.lit(source_note).alias("source_note"),
            F.lit(method).alias("method"),
            F.when(~available, F.lit(reason)).alias("pending_reason"),
        )

    counts = F.create_map(
        F.lit("cast"), F.coalesce("cast", zero), F.lit("absent"), F.coalesce("absent", zero), F.lit("eligible"), eligible
    )
    bills = F.create_map(
        F.lit("bills_sponsored"), sponsored, F.lit("as_lead_initiator"), F.coalesce("as_lead_initiator", zero)
    )
    nothing = F.create_map().cast("map<string,bigint>")
    none = F.lit(None)
    rows = [
        dim(
            1,
            "participation",
            eligible > 0,
            eligible > 0,
            F.col("score"),
            counts.cast("map<string,bigint>"),
        ),
        dim(
            2,
            "legislative_activity",
            sponsored > 0,
            F.lit(False),
            none,
            bills.cast("map<string,bigint>"),
        ),
    ]
    rows += [
        dim(3 + i, key, F.lit(False), F.lit(False), none, nothing)
        for i, key in enumerate(PENDING_DIMENSIONS)
    ]
    return base.select(
        "person_id",
        F.coalesce("votes", zero).cast("bigint").alias("votes"),
        sponsored.cast("bigint").alias("bills"),
        F.array(*rows).alias("dimensions"),
    )


def dimension_table(
    people: DataFrame,
    votes: DataFrame,
    sponsorships: DataFrame,
    weights: Mapping[str, float] = DIMENSION_WEIGHTS,
) -> DataFrame:
    """Long table: one row per person and dimension."""
    return dimension_lists(people, votes, sponsorships, weights).select("person_id", F.inline("dimensions"))


def scorecards(lists: DataFrame) -> DataFrame:
    """Per person of :func:`dimension_lists` the index over the list, without another grouping."""
    used = F.filter("dimensions", lambda d: d["available"] & d["scorable"] & d["score"].isNotNull())
    rows = lists.select("*", F.size("dimensions").cast("bigint").alias("coverage_total"), used.alias("used"))
    return _indexed(rows, lists.columns)


def composite_index(dimensions: DataFrame) -> DataFrame:
    """Index over the available, scorable, scored dimensions, weights renormalised on that subset.

    Each person has a fixed handful of dimensions, so collecting them is bounded.
    """
    used = F.col("available") & F.col("scorable") & F.col("score").isNotNull()
    per_person = dimensions.groupBy("person_id").agg(
        F.count("*").alias("coverage_total"),
        F.sort_array(F.collect_list(F.when(used, F.struct("dimension_no", "key", "score", "weight")))).alias("used"),
    )
    return _indexed(per_person, ["person_id"])


def _indexed(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The index from ``used``, the dimensions that count, in order."""
    n = F.size("used")
    total = F.aggregate("used", F.lit(0.0), lambda acc, d: acc + d["weight"])
    share = F.transform(
        "used",
        lambda d: F.struct(
            d["key"].alias("key"),
            d["score"].alias("score"),
            F.when(F.col("total") > 0, d["weight"] / F.col("total")).otherwise(F.lit(1.0) / n).alias("share"),
        ),
    )
    value = F.aggregate("shares", F.lit(0.0), lambda acc, d: acc + d["score"] * d["share"])
    return (
        rows.withColumn("total", total)
        .withColumn("shares", share)
        .select(
            *kept,
            F.when(n > 0, round_half_even(value, 1)).alias("index_value"),
            n.cast("bigint").alias("coverage_scored"),
            "coverage_total",
            F.when(n == F.col("coverage_total"), "full").when(n > 1, "partial").otherwise("preliminary").alias("label"),
            F.transform("shares", lambda d: d["key"]).alias("included"),
            F.map_from_entries(F.transform("shares", lambda d: F.struct(d["key"], d["share"]))).alias("weights_used"),
            F.when(
                n < F.col("coverage_total"),
                F.format_string(INDEX_NOTE, n, F.col("coverage_total")),
            ).alias("note"),
        )
    )


def normalized_weights(dimensions: DataFrame) -> DataFrame:
    """Weight of each included dimension as applied (long form of ``weights_used``)."""
    return composite_index(dimensions).select("person_id", F.explode("weights_used").alias("key", "share"))
