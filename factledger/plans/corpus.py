"""Scans over transcript segments and posts: topic map, ranking claims, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import (
    ACTIVE_WITHIN_SECONDS,
    RANKING_PATTERN,
    RANKING_TOPIC_PATTERN,
    SPOKEN_TOPICS,
    TOPIC_MIN_SEGMENTS,
)
from factledger.functions.numbers import percent_of_max, round_half_even
from factledger.functions.text import clock_label, contains_any, minutes, moment_link, strip
from factledger.operators.ranking import numbered

Topics = Mapping[str, tuple[str, Sequence[str]]]


# --- topic map -----------------------------------------------------------------
def topics_in(text: Column, topics: Topics = SPOKEN_TOPICS) -> Column:
    """Array of the topic keys a text mentions; a topic is listed once per text.

    The keyword table is an argument, so it becomes part of the expression: one
    pass over the text, no join.
    """
    return F.array_compact(
        F.array(*[F.when(contains_any(text, words), F.lit(key)) for key, (_, words) in topics.items()])
    )


def topic_edges(
    segments: DataFrame, topics: Topics = SPOKEN_TOPICS, min_segments: int = TOPIC_MIN_SEGMENTS
) -> DataFrame:
    """(person_id, topic, weight): segments of a person that mention the topic."""
    return (
        segments.filter(F.col("person_id").isNotNull())
        .select("person_id", F.explode(topics_in(F.col("text"), topics)).alias("topic"))
        .groupBy("person_id", "topic")
        .agg(F.count("*").alias("weight"))
        .filter(F.col("weight") >= min_segments)
    )


def topic_people(edges: DataFrame, roster: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Edges with name and party; name falls back to the transcript's, then to the id."""
    out = edges.join(roster.select("person_id", "name", "party"), "person_id", "left")
    spoken = F.lit(None).cast("string")
    if speakers is not None:
        out = out.join(speakers.select("person_id", "speaker_name"), "person_id", "left")
        spoken = F.col("speaker_name")
    return out.select(
        "topic",
        "person_id",
        F.coalesce(F.nullif("name", F.lit("")), F.nullif(spoken, F.lit("")), F.col("person_id").cast("string")).alias(
            "name"
        ),
        F.coalesce("party", F.lit("")).alias("party"),
        "weight",
    ).orderBy("topic", F.desc("weight"), "person_id")


def topic_table(spark, topics: Topics = SPOKEN_TOPICS) -> DataFrame:
    rows = [(i, key, label, words[0]) for i, (key, (label, words)) in enumerate(topics.items())]
    return spark.createDataFrame(rows, "topic_no int, topic string, topic_label string, keyword string")


def topic_summary(edges: DataFrame, series_latest: DataFrame, topics: Topics = SPOKEN_TOPICS) -> DataFrame:
    """One row per topic, topics nobody mentions included.

    ``series_latest`` has (key, label, unit, year, value, source_org, source_url).
    """
    counts = edges.groupBy("topic").agg(F.count("*").alias("people"))
    table = topic_table(edges.sparkSession, topics)
    peak = F.coalesce(counts.agg(F.max("people").cast("double")).scalar(), F.lit(0.0))
    out = (
        table.join(counts, "topic", "left")
        .join(series_latest.withColumnRenamed("key", "topic"), "topic", "left")
        .withColumn("people", F.coalesce("people", F.lit(0)))
        .withColumn("bar", percent_of_max(F.col("people").cast("double"), peak))
    )
    blank = F.lit("")
    return out.select(
        "topic",
        F.coalesce(F.nullif("topic_label", blank), "label", "topic").alias("label"),
        F.coalesce("unit", blank).alias("unit"),
        F.coalesce("label", blank).alias("official_label"),
        F.col("year").alias("latest_year"),
        F.col("value").alias("latest_value"),
        F.coalesce("source_org", blank).alias("source_org"),
        F.coalesce("source_url", blank).alias("source_url"),
        "keyword",
        "people",
        "bar",
        "topic_no",
    ).orderBy(F.desc("people"), "topic_no")


def topic_totals(edges: DataFrame, topics: Topics = SPOKEN_TOPICS) -> DataFrame:
    return edges.agg(
        F.lit(len(topics)).cast("bigint").alias("topics"),
        F.countDistinct("person_id").alias("people_connected"),
        F.count("*").alias("edges"),
    )


# --- ranking claims ---------------------------------------------------------------
def ranking_claims(
    segments: DataFrame,
    posts: DataFrame,
    rank_pattern: str = RANKING_PATTERN,
    topic_pattern: str = RANKING_TOPIC_PATTERN,
) -> DataFrame:
    """Texts that state a ranking on a covered topic, from interviews and own posts."""

    def hits(df: DataFrame) -> DataFrame:
        df = df.withColumn("quote", strip(F.coalesce("text", F.lit(""))))
        return df.filter(F.col("quote").rlike(rank_pattern) & F.col("quote").rlike(topic_pattern))

    spoken = hits(segments).select(
        F.lit("interview").alias("source"),
        "person_id",
        "speaker_name",
        "video_id",
        F.bround(F.coalesce("start", F.lit(0)).cast("double"), 0).cast("bigint").alias("start"),
        F.lit(None).cast("string").alias("url"),
        "quote",
    )
    written = (
        hits(posts)
        .filter(~F.col("quote").startswith("RT @"))
        .select(F.lit("tweet").alias("source"), "person_id", F.col("handle").alias("speaker_name"), "url", "quote")
    )
    return spoken.unionByName(written, allowMissingColumns=True)


def count_by(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows per value, most common first (claims by source, adjudications by verdict)."""
    return df.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key)


# --- search ---------------------------------------------------------------------------
def search_segments(interviews: DataFrame) -> DataFrame:
    """Flatten interviews with nested segments to one row per non-blank segment.

    The (person_id, video_id, pos) key orders the index: persons by id as text,
    interviews newest first, segments as spoken.
    """
    flat = interviews.select(
        "person_id", "name", "video_id", "url", "title", "published_at", F.posexplode("segments").alias("pos", "seg")
    )
    return flat.select(
        "person_id",
        "name",
        "video_id",
        "url",
        "title",
        "published_at",
        "pos",
        round_half_even(F.coalesce(F.col("seg.start").cast("double"), F.lit(0.0)), 1).alias("start"),
        strip(F.col("seg.text")).alias("text"),
    ).filter(F.coalesce(F.col("text"), F.lit("")) != "")


def index_order() -> list[Column]:
    return [
        F.col("person_id").cast("string").asc(),
        F.coalesce(F.col("published_at").cast("string"), F.lit("")).desc(),
        F.col("video_id").asc(),
    ]


def search_index(interviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interviews with a dense index number, and the segments that refer to it."""
    keyed = interviews.withColumns(
        {
            "_p": F.col("person_id").cast("string"),
            "_d": F.coalesce(F.col("published_at").cast("string"), F.lit("")),
        }
    )
    heads = numbered(
        keyed.select("person_id", "name", "video_id", "url", "title", "_p", "_d"),
        ["_p", F.desc("_d"), "video_id"],
        name="interview_no",
        start=0,
    ).drop("_p", "_d")
    lines = search_segments(interviews).select("person_id", "video_id", "pos", "start", "text")
    segments = lines.join(heads.select("person_id", "video_id", "interview_no"), ["person_id", "video_id"])
    return heads, segments.select("interview_no", "pos", "start", "text")


def search(segments: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """First ``limit`` hits in index order; the query is case-sensitive and at least two characters.

    Runs as a filter and a distributed top-k, so only hits are ever sorted.
    """
    q = (query or "").strip()
    hits = segments.filter(F.lit(len(q) >= 2) & F.col("text").contains(q))
    found = hits.orderBy(*index_order(), F.col("pos").asc()).limit(limit)
    return found.select(
        "person_id",
        "name",
        "video_id",
        "title",
        "pos",
        "start",
        "text",
        moment_link(F.col("url"), F.col("start")).alias("link"),
        clock_label(F.col("start")).alias("clock"),
    )


def person_hits(segments: DataFrame, query: str) -> DataFrame:
    """Hits per interview for the profile search; interviews without a hit are left out."""
    q = (query or "").strip()
    return (
        segments.filter(F.col("text").contains(q))
        .groupBy("person_id", "video_id")
        .agg(F.count("*").alias("hits"), F.min("start").alias("first_start"))
    )


# --- corpus reports ----------------------------------------------------------------------
def interview_cards(interviews: DataFrame) -> DataFrame:
    """Interview headers, newest first; a missing date sorts last."""
    return interviews.select(
        "person_id",
        "video_id",
        "title",
        "published_at",
        minutes(F.col("duration_sec")).alias("minutes"),
        F.coalesce(F.size("segments"), F.lit(0)).alias("segment_count"),
    ).orderBy("person_id", F.coalesce(F.col("published_at").cast("string"), F.lit("")).desc(), "video_id")


def person_index(roster: DataFrame, interviews: DataFrame) -> DataFrame:
    """Every roster person with interview and segment counts, busiest first."""
    counted = interviews.groupBy("person_id").agg(
        F.count("*").alias("interview_count"),
        F.sum(F.greatest(F.coalesce(F.size("segments"), F.lit(0)), F.lit(0))).alias("segment_count"),
    )
    return (
        roster.select("person_id", "name", F.coalesce("party", F.lit("")).alias("party"))
        .join(counted, "person_id", "left")
        .withColumns(
            {
                "interview_count": F.coalesce("interview_count", F.lit(0)),
                "segment_count": F.coalesce("segment_count", F.lit(0)),
            }
        )
        .orderBy(F.desc("interview_count"), "name", "person_id")
    )


def index_totals(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("people"),
        F.count_if(F.col("interview_count") > 0).alias("with_interviews"),
        F.coalesce(F.sum("interview_count"), F.lit(0)).alias("interviews"),
        F.coalesce(F.sum("segment_count"), F.lit(0)).alias("segments"),
    )


def people_with_interviews(roster: DataFrame, interviews: DataFrame) -> DataFrame:
    return roster.join(interviews.select("person_id"), "person_id", "left_semi")


def post_index(posts: DataFrame) -> DataFrame:
    """Posts with text per person; a person whose posts are all blank is left out."""
    return (
        posts.filter(strip(F.coalesce("text", F.lit(""))) != "")
        .groupBy("person_id", "handle")
        .agg(F.count("*").alias("posts"))
    )


def corpus_status(
    interviews: DataFrame, findings: DataFrame, activity: DataFrame, now: Column, within: int = ACTIVE_WITHIN_SECONDS
) -> DataFrame:
    """One row: corpus size, finding counters, and whether the harvest is active, in one aggregate over the three tables.

    ``activity`` has a timestamp column ``ts``; ``now`` is the reference time.
    """
    rows = (
        interviews.select(F.lit("interview").alias("kind"), "person_id")
        .unionByName(findings.select(F.lit("finding").alias("kind"), "outcome", "status"), allowMissingColumns=True)
        .unionByName(activity.select(F.lit("activity").alias("kind"), "ts"), allowMissingColumns=True)
    )
    out = rows.agg(
        F.count_if(F.col("kind") == "interview").alias("transcripts"),
        F.countDistinct("person_id").alias("people_with_interviews"),
        F.count_if(F.col("kind") == "finding").alias("total"),
        F.count_if(F.col("outcome") == "contradicted").alias("contradicted"),
        F.count_if(F.col("outcome") == "consistent").alias("consistent"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.max("ts").alias("_last"),
    )
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("_last").cast("timestamp"))
    return out.withColumns(
        {
            "last_activity_min": round_half_even(age / 60, 1),
            "active": F.coalesce(age < within, F.lit(False)),
        }
    ).drop("_last")
