"""Yearly series from the statistics catalog, tenure trends and change summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import (
    GOOD_WHEN_UP,
    MIN_SERIES_YEARS,
    NATIONAL_DIMENSIONS,
    PORTFOLIO_METRICS,
    RESEARCH_METRICS,
)
from factledger.functions.casts import start_year, year_in
from factledger.functions.numbers import percent_of_max, round_half_even
from factledger.functions.text import person_name_key, short_org, unit_label
from factledger.operators.contains import containing
from factledger.operators.joins import broadcast_if_small
from factledger.operators.ranking import top_rows
from factledger.session import cut_lineage


def series_points(points: DataFrame, min_years: int = MIN_SERIES_YEARS) -> DataFrame:
    """One value per (metric, year) for metrics with enough years.

    The year comes from the period, else from the dimension. The last national
    value of a year wins; without one, the first value does. ``pos`` is the
    catalog order.
    """
    dated = points.withColumn("year", F.coalesce(year_in(F.col("period")), year_in(F.col("dimension_value"))))
    national = F.coalesce(F.col("dimension_value").isin(*NATIONAL_DIMENSIONS), F.lit(False))
    rank = F.struct(national.cast("int"), F.when(national, F.col("pos")).otherwise(-F.col("pos")))
    yearly = (
        dated.filter(F.col("year").isNotNull())
        .groupBy("metric", "year")
        .agg(F.max_by("value", rank).alias("value"))
    )
    enough = yearly.groupBy("metric").agg(F.count("*").alias("years")).filter(F.col("years") >= min_years)
    return yearly.join(enough.select("metric"), "metric", "left_semi")


def series_headers(points: DataFrame, source_count: int = 2, note_chars: int = 240) -> DataFrame:
    """Unit, whole note, its display form of ``note_chars`` characters, and the first ``source_count`` distinct sources."""
    blank = F.lit("")
    heads = points.groupBy("metric").agg(
        F.min_by(F.struct("unit", "notes"), "pos").alias("first"),
        F.max_by(F.struct("notes"), "pos").alias("last"),
    )
    sourced = points.filter(F.coalesce("source_url", blank) != "").select(
        "metric", F.coalesce("source_org", blank).alias("full_org"), F.col("source_url").alias("url"), "pos"
    )
    distinct = sourced.groupBy("metric", "full_org", "url").agg(F.min("pos").alias("pos"))
    two = top_rows(distinct, ["metric"], ["pos"], source_count)
    source = F.struct("pos", short_org(F.col("full_org")).alias("org"), "url")
    sources = two.groupBy("metric").agg(F.sort_array(F.collect_list(source)).alias("s"))
    note = F.coalesce(F.nullif(F.col("last.notes"), blank), F.nullif(F.col("first.notes"), blank), blank)
    return heads.join(sources, "metric", "left").select(
        "metric",
        unit_label(F.coalesce(F.col("first.unit"), blank)).alias("unit"),
        note.alias("note"),
        F.left(note, F.lit(note_chars)).alias("note_display"),
        F.transform("s", lambda x: F.struct(x["org"].alias("org"), x["url"].alias("url"))).alias("sources"),
    )


def build_series(points: DataFrame, min_years: int = MIN_SERIES_YEARS, include: DataFrame | None = None) -> DataFrame:
    """One row per exported series, points sorted by year (years have four digits, so the array is bounded).

    ``include`` (metric, label, category) chooses the metrics and names them.
    """
    if include is not None:
        points = points.join(include.select("metric"), "metric", "left_semi")
        return build_series(points, min_years).join(include.select("metric", "label", "category"), "metric")
    yearly = series_points(points, min_years)
    arrays = yearly.groupBy("metric").agg(F.sort_array(F.collect_list(F.struct("year", "value"))).alias("points"))
    return arrays.join(series_headers(points), "metric")


def series_from_map(table: DataFrame) -> DataFrame:
    """One row per series from a file of MAP<key, STRUCT> (order of keys is kept in ``pos``)."""
    pairs = table.select(F.posexplode(F.map_entries("series")).alias("pos", "entry"))
    return pairs.select("pos", F.col("entry.key").alias("key"), "entry.value.*")


def portfolio_points(series: DataFrame, metrics: Mapping[str, str] | Column = PORTFOLIO_METRICS) -> DataFrame:
    """Catalog points of the portfolio series that belong to a checked topic, tagged ``from_portfolio``.

    ``metrics`` names the metric of each series: a map from its key, or a column that is null for other series.
    """
    if isinstance(metrics, Column):
        named = metrics
    else:
        named = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])[F.col("key")]
    rows = series.withColumn("metric", named).filter(F.col("metric").isNotNull())
    source = F.get(F.col("sources"), 0)
    blank = F.lit("")
    rows = rows.select(
        "metric", "label", "unit", source.alias("source"), F.explode("points").alias("point")
    )
    year = F.col("point.year").cast("string")
    return rows.select(
        "metric",
        F.lit("year").alias("dimension_type"),
        year.alias("dimension_value"),
        F.col("point.value").alias("value"),
        F.coalesce("unit", blank).alias("unit"),
        year.alias("period"),
        F.coalesce("source.org", blank).alias("source_org"),
        F.coalesce("source.url", blank).alias("source_url"),
        F.concat(
            F.coalesce("label", blank),
            F.lit(": "),
            year,
            F.lit(" = "),
            F.col("point.value").cast("string"),
            F.when(F.coalesce(F.col("point.provisional"), F.lit(False)), " (ארעי)").otherwise(""),
        ).alias("confirm_quote"),
        F.lit(True).alias("from_portfolio"),
    )


def research_series(verified: DataFrame) -> DataFrame:
    """Verified research output as portfolio series."""
    blank = F.lit("")
    source = F.struct(F.coalesce("source_org", blank).alias("org"), F.coalesce("source_url", blank).alias("url"))
    return verified.select(
        "key",
        F.coalesce("label", blank).alias("label"),
        F.coalesce("unit", blank).alias("unit"),
        F.coalesce("ministry_match", F.array().cast("array<string>")).alias("match"),
        F.left(F.coalesce("note", blank), F.lit(600)).alias("note"),
        F.array(source).alias("sources"),
        "points",
        F.lit(True).alias("from_research"),
    )


def research_points(verified: DataFrame, metrics: Mapping[str, str] = RESEARCH_METRICS) -> DataFrame:
    """Catalog points of the research series that belong to a checked topic, tagged ``from_research``."""
    names = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    rows = verified.withColumn("metric", names[F.col("key")]).filter(F.col("metric").isNotNull())
    blank = F.lit("")
    rows = rows.select("metric", "label", "unit", "source_org", "source_url", F.explode("points").alias("point"))
    year = F.col("point.year").cast("string")
    quote = F.concat(
        F.left(F.coalesce("label", blank), F.lit(40)), F.lit(": "), year, F.lit(" = "), F.col("point.value").cast("string")
    )
    return rows.select(
        "metric",
        F.lit("year").alias("dimension_type"),
        year.alias("dimension_value"),
        F.col("point.value").alias("value"),
        F.left(F.coalesce("unit", blank), F.lit(24)).alias("unit"),
        year.alias("period"),
        F.coalesce("source_org", blank).alias("source_org"),
        F.coalesce("source_url", blank).alias("source_url"),
        quote.alias("confirm_quote"),
        F.lit(True).alias("from_research"),
    )


def measured_points(verified: DataFrame) -> DataFrame:
    """Catalog points of verified metrics with their own dimensions, tagged ``from_catalog_research``.

    A metric without a name or without points is skipped; the period defaults to
    the dimension.
    """
    blank = F.lit("")
    usable = verified.filter((F.coalesce("metric", blank) != "") & (F.coalesce(F.size("points"), F.lit(0)) > 0))
    rows = usable.select(
        "metric", "dimension_type", "label", "unit", "source_org", "source_url", F.explode("points").alias("point")
    )
    dim = F.col("point.dimension_value").cast("string")
    quote = F.concat(
        F.left(F.coalesce("label", blank), F.lit(50)), F.lit(": "), dim, F.lit(" = "), F.col("point.value").cast("string")
    )
    return rows.select(
        "metric",
        F.coalesce("dimension_type", F.lit("year")).alias("dimension_type"),
        dim.alias("dimension_value"),
        F.col("point.value").alias("value"),
        F.left(F.coalesce("unit", blank), F.lit(30)).alias("unit"),
        F.coalesce(F.col("point.period").cast("string"), dim).alias("period"),
        F.coalesce("source_org", blank).alias("source_org"),
        F.coalesce("source_url", blank).alias("source_url"),
        quote.alias("confirm_quote"),
        F.lit(True).alias("from_catalog_research"),
    )


def yearly_ratio(monthly: Column) -> Column:
    """Yearly figure of a count of monthly salaries, one decimal."""
    return round_half_even(monthly.cast("double") / 12, 1)


def catalog_overview(points: DataFrame) -> DataFrame:
    """Number of points and of distinct metrics."""
    return points.agg(F.count("*").alias("points"), F.countDistinct("metric").alias("metrics"))


def catalog_metrics(points: DataFrame) -> DataFrame:
    """Distinct metrics with their number of points, in name order."""
    return points.groupBy("metric").agg(F.count("*").alias("points")).orderBy("metric")


# --- tenure trends ------------------------------------------------------------------
def match_series(appointments: DataFrame, series: DataFrame) -> DataFrame:
    """First series, in declared order, one of whose keywords occurs in the position or ministry.

    Distinct places are matched with the exploded keywords; the appointments
    meet the few places that matched.
    """
    words = series.select("pos", "key", F.explode("match").alias("word")).filter("word IS NOT NULL")
    named = appointments.select(
        F.explode(F.array(F.coalesce("position", F.lit("")), F.coalesce("ministry", F.lit("")))).alias("place")
    )
    pairs = containing(named, "place", words, "word").join(words, "word")
    first = top_rows(pairs, ["text"], ["pos", "key"]).select("text", F.struct("pos", "key").alias("first"))
    first = cut_lineage(first)
    own = appointments.withColumns(
        {"_place": F.coalesce("position", F.lit("")), "_office": F.coalesce("ministry", F.lit(""))}
    )
    joined = own.join(first.select(F.col("text").alias("_place"), F.col("first").alias("_by_place")), "_place", "left")
    joined = joined.join(first.select(F.col("text").alias("_office"), F.col("first").alias("_by_office")), "_office", "left")
    return joined.select(*appointments.columns, F.least("_by_place", "_by_office")["key"].alias("key"))


def trend_points(points: Column, year: Column) -> Column:
    """Point a tenure starts at: same year, else first later one, else the first point."""
    same = F.get(F.filter(points, lambda p: p["year"] == year), 0)
    later = F.get(F.filter(points, lambda p: p["year"] >= year), 0)
    return F.coalesce(same, later, F.get(points, 0))


def tenure_trends(
    appointments: DataFrame,
    series: DataFrame,
    roster: DataFrame,
    good_when_up: Mapping[str, bool | None] = GOOD_WHEN_UP,
) -> DataFrame:
    """Per person: the first decisive trend of an official series since taking office, else the first neutral one.

    ``appointments`` has (pos, person_id, name, position, ministry, start_date);
    ``series`` has (pos, key, label, unit, match, points).
    """
    matched = match_series(appointments, series).filter(F.col("key").isNotNull())
    long_enough = series.filter(F.size("points") >= 2).select("key", "label", "unit", "points")
    rows = matched.join(broadcast_if_small(long_enough), "key").withColumns(
        {
            "first": trend_points(F.col("points"), start_year(F.col("start_date"))),
            "last": F.element_at("points", -1),
        }
    )
    rows = rows.filter(F.col("first.year") != F.col("last.year"))
    delta = F.col("last.value") - F.col("first.value")
    polarity = {k: v for k, v in good_when_up.items() if v is not None}
    good = F.create_map(*[F.lit(x) for pair in polarity.items() for x in pair])[F.col("key")]
    direction = (
        F.when(good.isNull() | (delta == 0), "neutral").when((delta > 0) == good, "good").otherwise("bad")
    )
    rows = rows.withColumn("direction", direction)

    names = roster.withColumn("_name", person_name_key(F.col("name")))
    names = names.groupBy("_name").agg(F.max_by("person_id", "pos").alias("roster_id"))
    rows = rows.withColumn("_name", person_name_key(F.col("name"))).join(names, "_name", "left")
    person = F.coalesce(F.col("roster_id").cast("string"), F.col("person_id").cast("string"))
    pick = F.struct((F.col("direction") == "neutral").cast("int"), F.col("pos"))
    chosen = F.min_by(
        F.struct(
            "direction",
            "label",
            "unit",
            F.col("first.year").alias("from_year"),
            F.col("first.value").alias("from_value"),
            F.col("last.year").alias("to_year"),
            F.col("last.value").alias("to_value"),
            "ministry",
            "key",
        ),
        pick,
    )
    return rows.groupBy(person.alias("person_id")).agg(chosen.alias("t")).select("person_id", "t.*")


# --- change summaries -------------------------------------------------------------------
def merge_series(base: DataFrame, override: DataFrame) -> DataFrame:
    """Two series sets; the second replaces equal keys."""
    kept = base.join(override.select("key"), "key", "left_anti")
    return kept.unionByName(override, allowMissingColumns=True)


def change_summary(series: DataFrame) -> DataFrame:
    """First and last point, direction, and bar heights of every non-empty series."""
    shown = series.filter(F.size("points") > 0)
    top = F.greatest(F.array_max(F.transform("points", lambda p: p["value"])), F.lit(1.0))
    first, last = F.get("points", 0), F.element_at("points", -1)
    arrow = (
        F.when(last["value"] == first["value"], "").when(last["value"] > first["value"], "▲").otherwise("▼")
    )
    return shown.select(
        "key",
        "label",
        "unit",
        first["year"].alias("first_year"),
        first["value"].alias("first_value"),
        last["year"].alias("last_year"),
        last["value"].alias("last_value"),
        arrow.alias("arrow"),
        F.transform("points", lambda p: percent_of_max(p["value"], top)).alias("bars"),
    )


def filter_series(series: DataFrame, query: str) -> DataFrame:
    """Series whose label, key, synonyms, unit or note holds the query (lower-cased)."""
    q = (query or "").strip().lower()
    blank = F.lit("")
    text = F.lower(
        F.concat_ws(
            " ",
            F.coalesce("label", blank),
            "key",
            F.array_join(F.coalesce("match", F.array().cast("array<string>")), " "),
            F.coalesce("unit", blank),
            F.coalesce("note", blank),
        )
    )
    return series.filter(text.contains(q)) if q else series


def latest_points(series: DataFrame) -> DataFrame:
    """Latest official value and first source of every series."""
    last, source = F.element_at("points", -1), F.get("sources", 0)
    return series.select(
        "key",
        "label",
        "unit",
        F.when(F.size("points") > 0, last["year"]).alias("year"),
        F.when(F.size("points") > 0, last["value"]).alias("value"),
        source["org"].alias("source_org"),
        source["url"].alias("source_url"),
    )
