"""Numbers a person gave for the same metric in different videos that do not agree.

Listing every conflicting pair grows with the square of a person's claims, so the
review queue is kept linear: every claim gets its exact number of conflicting
claims and the lowest and highest of them. Reviewers open the partners of the
claims they pick with :func:`partners_of`.

Counts run over histogram cells (distinct values). A person and metric with very
many of them is spread over many tasks by range. Whether two numbers conflict is
judged on the doubles themselves; each value's nearest conflicting doubles are found
exactly, so no tolerance and no other person's value plays a part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.constants import MIN_PERCENT_GAP, PERCENT_MARKS, PERCENT_PATTERN, SPOKEN_METRICS
from factledger.functions.text import contains_any, strip
from factledger.operators.ranking import running_total
from factledger.session import cut_lineage

GROUP = ["person_id", "metric"]


def metric_of(text: Column, metrics: Sequence[tuple[str, str]] = SPOKEN_METRICS) -> Column:
    """Label of the first pattern found, in declared order."""
    chain = F.lit(None).cast("string")
    for pattern, label in reversed(metrics):
        chain = F.when(text.rlike(pattern), F.lit(label)).otherwise(chain)
    return chain


def percent_in(text: Column) -> Column:
    """The first percentage of a text, at most one decimal."""
    return F.nullif(F.regexp_extract(text, PERCENT_PATTERN, 1), F.lit("")).try_cast("double")


def percent_claims(segments: DataFrame, metrics: Sequence[tuple[str, str]] = SPOKEN_METRICS) -> DataFrame:
    """Segments that state a percentage of a covered metric."""
    text = strip(F.coalesce("text", F.lit("")))
    marked = segments.filter(F.col("person_id").isNotNull()).withColumn("quote", text)
    marked = marked.filter(contains_any(F.col("quote"), PERCENT_MARKS))
    return marked.select(
        "person_id",
        "speaker_name",
        metric_of(F.col("quote"), metrics).alias("metric"),
        percent_in(F.col("quote")).alias("value"),
        "video_id",
        F.bround(F.coalesce("start", F.lit(0)).cast("double"), 0).cast("bigint").alias("start"),
        "quote",
    ).filter(F.col("metric").isNotNull() & F.col("value").isNotNull())


def _keyed(claims: DataFrame) -> DataFrame:
    """Claims with a number and a video key without nulls; null and NaN values agree and disagree with nothing."""
    number = F.col("value").cast("double")
    kept = claims.filter(number.isNotNull() & ~F.isnan(number))
    return kept.withColumn("video", F.coalesce(F.col("video_id").cast("string"), F.lit("")))


def _ordinals(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, one apart for neighbouring doubles."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _doubles(n: np.ndarray) -> np.ndarray:
    return np.where(n < 0, np.int64(-(2**63)) - n, n).view(np.float64)


def nearest_apart(values: np.ndarray, gap: float) -> np.ndarray:
    """For each value the greatest double at least ``gap`` below it, as the subtraction of doubles judges; NaN if none.

    The rounded difference never grows with the smaller number, so the doubles that
    are far enough form one stretch from minus infinity up, and its end is found by
    halving, exactly, whatever the magnitudes. It lies within a few roundings of
    ``values - gap``; where that is checked to hold, the halving starts there.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        bottom = np.full_like(values, -np.inf)
        slack = 4 * np.spacing(np.maximum(np.abs(values), gap))
        under, over = values - gap - slack, np.minimum(values - gap + slack, values)
        near = (values - under >= gap) & ~(values - over >= gap)
        low, high = _ordinals(np.where(near, under, bottom)), _ordinals(np.where(near, over, values))
        some = values - bottom >= gap
        todo = np.arange(len(values))
        for _ in range(64):
            # the mean without overflow
            l, h = low[todo], high[todo]
            middle = (l >> 1) + (h >> 1) + (l & h & 1)
            good = values[todo] - _doubles(middle) >= gap
            low[todo], high[todo] = np.where(good, middle, l), np.where(good, h, middle)
            # a mean equal to the lower end moves nothing any more
            todo = todo[(middle != l) | ((h - l) > 1)]
            if not len(todo):
                break
    return np.where(some, _doubles(low), np.nan)


def _bounds(min_gap: float):
    """``low`` and ``high``: the nearest doubles that conflict with a value from below and above; null if none."""

    @F.pandas_udf("low double, high double")
    def bounds(value: pd.Series) -> pd.DataFrame:
        v = value.to_numpy("float64")
        found = pd.DataFrame({"low": nearest_apart(v, min_gap), "high": -nearest_apart(-v, min_gap)})
        return found.astype(object).where(found.notna(), None)

    return bounds


def _asked(cells: DataFrame, keys: list[str], min_gap: float) -> DataFrame:
    """Every distinct value of a group with its two questions and their answers ``upto``, by one running total.

    A value asks at two exact places: how many rows lie up to ``low`` (``kind`` 2), and how many
    below ``high`` (0). Values sort between the two kinds of questions of one place.
    """
    # written, since the range partitions are sampled first
    asked = cut_lineage(cells.withColumn("at", _bounds(min_gap)("value")))
    none = F.lit(0).cast("bigint").alias("n")
    asks = F.array(
        F.struct(F.col("value").alias("x"), F.lit(1).alias("kind"), F.col("n").alias("n")),
        F.struct(F.col("at.low").alias("x"), F.lit(2).alias("kind"), none),
        F.struct(F.col("at.high").alias("x"), F.lit(0).alias("kind"), none),
    )
    points = asked.select(*keys, "value", F.col("n").alias("rows"), F.explode(asks).alias("p"))
    points = points.select(*keys, "value", "rows", "p.*").filter("x IS NOT NULL")
    return running_total(points, keys, ["x", "kind"], "n", "upto").filter("kind <> 1")


def _far(cells: DataFrame, keys: list[str], min_gap: float, name: str) -> DataFrame:
    """Per distinct value of a group the number of rows at least ``min_gap`` away."""
    pair = _asked(cells, keys, min_gap).groupBy(*keys, "value").agg(
        F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("below"),
        F.max(F.when(F.col("kind") == 0, F.col("upto"))).alias("under_high"),
    )
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    above = F.col("total") - F.coalesce("under_high", F.col("total"))
    return pair.join(totals, keys).select(*keys, "value", (F.coalesce("below", F.lit(0)) + above).alias(name))


def _ends(cells: DataFrame, keys: list[str], min_gap: float, name: str) -> DataFrame:
    """Per group the sum over its rows of the rows at least ``min_gap`` away, summed from the answers themselves."""
    low, high = F.col("kind") == 2, F.col("kind") == 0
    sums = _asked(cells, keys, min_gap).groupBy(*keys).agg(
        F.sum(F.when(low, F.col("rows") * F.col("upto")).otherwise(-F.col("rows") * F.col("upto"))).alias("counted"),
        F.coalesce(F.sum(F.when(high, F.col("rows"))), F.lit(0)).alias("asking"),
    )
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    return sums.join(totals, keys).select(*keys, (F.col("counted") + F.col("asking") * F.col("total")).alias(name))


def _cells(claims: DataFrame, min_gap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims per (person, metric, video, value), per (person, metric, value), and the former of videos with conflicts of their own."""
    if not min_gap > 0:
        raise ValueError("the gap must be positive")
    keyed = _keyed(claims).withColumn("value", F.col("value").cast("double"))
    cells = cut_lineage(keyed.groupBy(*GROUP, "video", "value").agg(F.count("*").alias("n")))
    overall = cells.groupBy(*GROUP, "value").agg(F.sum("n").alias("n"))
    # most videos state one number a metric, or numbers that agree: these have no conflict inside the video
    wide = cells.groupBy(*GROUP, "video").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wide = wide.filter(apart(F.col("hi"), F.col("lo"), min_gap)).drop("lo", "hi")
    # few rows, read again for the sample of the range partitions and for the totals
    return cells, overall, cut_lineage(cells.join(wide, [*GROUP, "video"], "left_semi"))


def conflict_cells(claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """Per (person, metric, video, value): claims and exact number of conflicting claims, whatever the values' size or decimals."""
    cells, overall, own = _cells(claims, min_gap)
    inside = _far(own, [*GROUP, "video"], min_gap, "_own")
    counted = cells.join(_far(overall, GROUP, min_gap, "_all"), [*GROUP, "value"]).join(inside, [*GROUP, "video", "value"], "left")
    return counted.select(
        *GROUP, "video", "value", F.col("n").alias("claims"), (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("conflicts")
    )


def conflict_ends(claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """Per (person, metric) with conflicts: ``ends``, the conflicts of all its claims together, without a row per claim."""
    _, overall, own = _cells(claims, min_gap)
    inside = _ends(own, [*GROUP, "video"], min_gap, "_own").groupBy(*GROUP).agg(F.sum("_own").alias("_own"))
    ends = _ends(overall, GROUP, min_gap, "_all").join(inside, GROUP, "left")
    return ends.select(*GROUP, (F.col("_all") - F.coalesce("_own", F.lit(0))).alias("ends")).filter("ends > 0")


def apart(high: Column, low: Column, min_gap: float) -> Column:
    """The difference of two numbers reaches the gap; two equal infinities do not differ."""
    return F.coalesce((high - low >= min_gap) & ~F.isnan(high - low), F.lit(False))


def conflict_queue(claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """Claims with at least one conflicting claim, its count and the extreme partners."""
    cells = conflict_cells(claims, min_gap).filter(F.col("conflicts") > 0)
    keyed = _keyed(claims)
    # cells are pre-aggregated; the claims themselves join on the fine key only
    partners = cells.select(*GROUP, "video", "value", "conflicts").join(_video_extremes(keyed), GROUP)
    queue = keyed.join(partners, [*GROUP, "video", "value"])

    def other(side: str) -> Column:
        own = F.col(f"{side}1.video") == F.col("video")
        return F.when(own, F.col(f"{side}2")).otherwise(F.col(f"{side}1"))

    low, high = other("low"), other("high")
    return queue.select(
        *claims.columns,
        "conflicts",
        F.when(apart(F.col("value"), low["value"], min_gap), low["value"]).alias("lowest_partner"),
        F.when(apart(high["value"], F.col("value"), min_gap), high["value"]).alias("highest_partner"),
        F.lit("candidate").alias("status"),
    )


def _video_extremes(keyed: DataFrame) -> DataFrame:
    """The two lowest and two highest videos of each group (by their own extreme value)."""
    per_video = keyed.groupBy(*GROUP, "video").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    group = Window.partitionBy(*GROUP)

    def side(value: str, ascending: bool, name: str) -> DataFrame:
        order = F.col(value).asc() if ascending else F.col(value).desc()
        best = per_video.withColumn("r", F.row_number().over(group.orderBy(order, "video"))).filter("r <= 2")
        pair = F.struct(F.col(value).alias("value"), F.col("video"))
        return best.groupBy(*GROUP).agg(
            F.max(F.when(F.col("r") == 1, pair)).alias(f"{name}1"),
            F.max(F.when(F.col("r") == 2, pair)).alias(f"{name}2"),
        )

    return side("lo", True, "low").join(side("hi", False, "high"), GROUP)


def conflict_totals(claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """Candidate pairs and people per metric, most pairs first."""
    return (
        conflict_ends(claims, min_gap)
        .groupBy("metric")
        .agg((F.sum("ends") / 2).cast("bigint").alias("pairs"), F.count("*").alias("people"))
        .orderBy(F.desc("pairs"), "metric")
    )


def conflicting_people(claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """Number of people with at least one candidate pair."""
    return conflict_ends(claims, min_gap).agg(F.countDistinct("person_id").alias("people"))


def partners_of(picked: DataFrame, claims: DataFrame, min_gap: float = MIN_PERCENT_GAP) -> DataFrame:
    """All conflicting claims of the picked ones (a reviewer's page of the queue).

    The output is linear in the claims for a fixed number of picks per group.
    """
    a = picked.select(*GROUP, *[F.col(c).alias(f"a_{c}") for c in picked.columns if c not in GROUP])
    b = claims.select(*GROUP, *[F.col(c).alias(f"b_{c}") for c in claims.columns if c not in GROUP])
    return (
        b.join(a, GROUP)
        .filter(~F.col("a_video_id").eqNullSafe(F.col("b_video_id")))
        .filter(apart(F.greatest("a_value", "b_value"), F.least("a_value", "b_value"), min_gap))
    )
