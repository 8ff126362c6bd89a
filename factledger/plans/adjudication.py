"""Check structured claims against official statistics and gate publication.

The catalog is ranked once per peer set (metric, dimension_type) and reduced to
one row per dimension plus one row per peer set. Claims then meet those small
tables in two equi-joins; no claim is ever multiplied by its peer set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import (
    ADJUDICATOR_VERSION,
    FULL_COVERAGE_PEERS,
    MAX_CONFIDENCE,
    PUBLISH_CONFIDENCE,
    VALUE_CONSISTENT_REL,
    VALUE_INCONSISTENT_REL,
)
from factledger.functions.numbers import float_text, round_half_even
from factledger.operators.joins import broadcast_if_small
from factledger.operators.ranking import numbered
from factledger.session import cut_lineage

PEER_KEYS = ["metric", "dimension_type"]
VERDICT_COLUMNS = [
    "statement_id",
    "politician_id",
    "metric",
    "dimension_type",
    "official_statistic_id",
    "n_peers",
    "outcome",
    "confidence",
    "numeric_gap",
    "statement_url",
    "statistic_url",
    "rationale",
    "adjudicator_version",
    "published",
    "auto_published",
    "review_status",
]

Matcher = Callable[[DataFrame, DataFrame], DataFrame]


# --- peer sets --------------------------------------------------------------
def peer_members(statistics: DataFrame) -> DataFrame:
    """Every statistic with its place in its peer set (0 = lowest value)."""
    return numbered(statistics, ["value", "stat_id"], PEER_KEYS, name="place", start=0)


def peer_sets(members: DataFrame) -> DataFrame:
    """One row per peer set: its size and extremes."""
    row = F.struct("value", "stat_id")
    return members.groupBy(*PEER_KEYS).agg(
        F.count("*").alias("n_peers"), F.min(row).alias("lowest"), F.max(row).alias("highest")
    )


def dimension_lookup(members: DataFrame) -> DataFrame:
    """One row per (peer set, dimension): its lowest-valued and its first-listed statistic."""
    by_value = F.struct("value", "stat_id", "place", "source_url")
    by_listing = F.struct("stat_id", "value", "source_url")
    return members.groupBy(*PEER_KEYS, "dimension_value").agg(
        F.min(by_value).alias("ranked"), F.min(by_listing).alias("listed")
    )


def considered_members(statistics: DataFrame) -> DataFrame:
    """The statistics of every peer set in order: metric, dimension_type, place, stat_id.

    Verdicts name their peer set, so this one table holds what each of them
    considered, whatever the size of the sets.
    """
    return peer_members(statistics.select("stat_id", *PEER_KEYS, "value")).select(*PEER_KEYS, "place", "stat_id")


def considered_statistics(verdicts: DataFrame, statistics: DataFrame) -> DataFrame:
    """(statement_id, stat_id) pairs: every statistic a verdict considered, one row each.

    For the verdicts under review; the result has a row per verdict and peer.
    """
    keys = verdicts.select("statement_id", *PEER_KEYS)
    return keys.join(statistics.select(*PEER_KEYS, "stat_id"), PEER_KEYS).select("statement_id", "stat_id")


def ranked_statistics(statistics: DataFrame) -> DataFrame:
    """The catalog with every statistic's place in its peer set, ranked and stored once for all that read it."""
    return cut_lineage(peer_members(statistics.select("stat_id", *PEER_KEYS, "dimension_value", "value", "source_url")))


def match_statistics(claims: DataFrame, statistics: DataFrame) -> DataFrame:
    """Attach to each claim its peer set and its own dimension's statistic."""
    return match_ranked(claims, ranked_statistics(statistics))


def match_ranked(claims: DataFrame, members: DataFrame) -> DataFrame:
    """The same from a catalog ranked before.

    With both lookups broadcast the claims are not shuffled at all.
    """
    sets = broadcast_if_small(peer_sets(members))
    own = broadcast_if_small(dimension_lookup(members))
    return claims.join(sets, PEER_KEYS, "left").join(own, [*PEER_KEYS, "dimension_value"], "left")


# --- adjudication -----------------------------------------------------------
def adjudicate(matched: DataFrame) -> DataFrame:
    """Outcome, confidence, gap, primary statistic and rationale for every matched claim."""
    is_value = F.col("assertion") == "value"
    is_min = F.col("assertion") == "superlative_min"
    ranked, listed = F.col("ranked"), F.col("listed")
    n = F.col("n_peers")

    # The steps are separate projections so that each rounded value is a plain
    # column when the next step uses it.
    claimed = F.col("claimed_value")
    extreme = F.when(is_min, F.col("lowest")).otherwise(F.col("highest"))
    started = matched.withColumns(
        {
            "_n": n,
            "_decided": F.when(is_value, listed.isNotNull() & claimed.isNotNull()).otherwise(ranked.isNotNull()),
            "_holds": ranked["stat_id"] == extreme["stat_id"],
            "_actual": F.when(is_value, listed["value"]).otherwise(ranked["value"]),
            "_extreme": extreme["value"],
            "_place": F.when(n > 1, ranked["place"] / (n - 1)).otherwise(0.0),
            "_coverage": F.least(F.lit(1.0), n / F.lit(float(FULL_COVERAGE_PEERS))),
        }
    )
    actual, holds, decided = F.col("_actual"), F.col("_holds"), F.col("_decided")
    gapped = started.withColumn(
        "_raw_gap",
        F.when(is_value, claimed - actual).when(holds, F.lit(0.0)).otherwise(actual - F.col("_extreme")),
    ).withColumn("_gap", round_half_even(F.col("_raw_gap"), 4))
    measured = gapped.withColumn("_rel", F.abs("_gap") / F.greatest(F.abs(actual), F.lit(1e-9)))
    near, far = F.col("_rel") <= VALUE_CONSISTENT_REL, F.col("_rel") >= VALUE_INCONSISTENT_REL
    distance = F.when(is_min, F.col("_place")).otherwise(F.lit(1.0) - F.col("_place"))
    raw = (
        F.when(~decided, 0.0)
        .when(is_value & near, 0.9)
        .when(is_value & far, F.least(F.lit(MAX_CONFIDENCE), F.lit(0.6) + F.col("_rel")))
        .when(is_value, 0.5)
        .when(holds, F.lit(0.5) + F.lit(0.4) * F.col("_coverage"))
        .otherwise(F.least(F.lit(MAX_CONFIDENCE), distance * F.col("_coverage")))
    )
    outcome = (
        F.when(~decided, "unverifiable")
        .when(is_value & near, "consistent")
        .when(is_value & far, "inconsistent")
        .when(is_value, "unverifiable")
        .when(holds, "consistent")
        .otherwise("inconsistent")
    )
    chosen_id = F.when(is_value, listed["stat_id"]).otherwise(ranked["stat_id"])
    chosen_url = F.when(is_value, listed["source_url"]).otherwise(ranked["source_url"])
    return (
        measured.withColumn("_raw", raw)
        .withColumns(
            {
                "n_peers": F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"),
                "outcome": outcome,
                "confidence": round_half_even(F.col("_raw"), 4),
                "numeric_gap": F.when(decided, F.col("_gap")),
                "official_statistic_id": F.when(decided, chosen_id),
                "statistic_url": F.when(decided, chosen_url),
                "rationale": _rationale(is_value, is_min),
                "adjudicator_version": F.lit(ADJUDICATOR_VERSION),
            }
        )
        .drop("_n", "_decided", "_holds", "_actual", "_extreme", "_place", "_coverage", "_raw_gap", "_gap", "_rel", "_raw")
    )


def _rationale(is_value: Column, is_min: Column) -> Column:
    low_high = F.when(is_min, "נמוך").otherwise("גבוה")
    dim, count = F.col("dimension_value"), F.col("_n").cast("string")
    decided, holds = F.col("_decided"), F.col("_holds")
    # The wordings of the rationale.
    return (
        F.when(F.col("_n").isNull(), "אין נתון רשמי תואם להכרעה.")
        .when(~decided & is_value, "אין נתון מספרי תואם לאימות הערך הנטען.")
        .when(~decided, "הממד הנטען אינו קיים בקטלוג הנתונים הרשמי.")
        .when(
            is_value,
            F.concat(
                F.lit("הערך הנטען "),
                float_text(F.col("claimed_value")),
                F.lit(" מול הנתון הרשמי "),
                float_text(F.col("_actual")),
                F.lit(" (פער "),
                float_text(F.col("_gap")),
                F.lit(")."),
            ),
        )
        .when(
            holds,
            F.concat(
                F.lit("הטענה עקבית: "),
                dim,
                F.lit(" הוא אכן הערך ה"),
                low_high,
                F.lit(" ביותר מבין "),
                count,
                F.lit(" ערכים."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("הטענה אינה תואמת נתונים רשמיים: "),
                dim,
                F.lit(" אינו ה"),
                low_high,
                F.lit(" ביותר; ערכו "),
                float_text(F.col("_actual")),
                F.lit(" לעומת הקיצון "),
                float_text(F.col("_extreme")),
                F.lit(" (מתוך "),
                count,
                F.lit(" ערכים)."),
            )
        )
    )


# --- publication ---------------------------------------------------------------
def publish_gate(
    drafts: DataFrame,
    threshold: float = PUBLISH_CONFIDENCE,
    transcription_sources: Iterable[str] = (),
) -> DataFrame:
    """Publish only decisive, confident verdicts that do not come from speech-to-text."""
    passes = F.col("outcome").isin("consistent", "inconsistent") & (F.col("confidence") >= threshold)
    blocked = list(transcription_sources)
    if blocked:
        passes = passes & ~F.coalesce(F.col("source_type").isin(*blocked), F.lit(False))
    return drafts.withColumns(
        {
            "published": passes,
            "auto_published": passes,
            "review_status": F.when(passes, "approved").otherwise("pending"),
        }
    )


def verify(
    claims: DataFrame,
    statistics: DataFrame,
    *,
    matcher: Matcher = match_statistics,
    adjudicator: Callable[[DataFrame], DataFrame] = adjudicate,
    threshold: float = PUBLISH_CONFIDENCE,
    transcription_sources: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts for all claims, the rejected claims without a statement id, and the members of the peer sets."""
    usable = claims.filter(F.col("statement_id").isNotNull())
    rejects = claims.filter(F.col("statement_id").isNull()).withColumn(
        "reject_reason", F.lit("a verdict must be tied to a stored statement")
    )
    if matcher is match_statistics:  # one ranking serves the claims and the members
        ranked = ranked_statistics(statistics)
        matched, members = match_ranked(usable, ranked), ranked.select(*PEER_KEYS, "place", "stat_id")
    else:
        matched, members = matcher(usable, statistics), considered_members(statistics)
    drafts = adjudicator(matched)
    verdicts = publish_gate(drafts, threshold, transcription_sources).withColumn(
        "statement_url", F.col("source_url")
    )
    return verdicts.select(*VERDICT_COLUMNS), rejects, members


def verdict_leaderboard(verdicts: DataFrame, people: DataFrame) -> DataFrame:
    """People by number of published statements that contradict official data.

    Counts are taken per person before the names are joined.
    """
    from factledger.functions.text import person_slug

    counted = (
        verdicts.filter(F.col("published") & (F.col("outcome") == "inconsistent"))
        .groupBy("politician_id")
        .agg(F.count("*").alias("contradicted_count"))
    )
    board = counted.join(people, counted["politician_id"] == people["person_id"])
    return board.select(
        person_slug(F.col("official_id"), F.col("person_id")).alias("slug"),
        "person_id",
        "full_name",
        "party",
        "contradicted_count",
    ).orderBy(F.desc("contradicted_count"), "person_id")
