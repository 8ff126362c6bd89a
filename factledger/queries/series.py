"""Yearly series, tenure trends, change summaries and catalog upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.operators.merge import insert_absent, replace_tagged
from factledger.plans import series as sr
from factledger.queries import register
from factledger.session import cut_lineage

GOOD = {"ring": True, "bolt": False, "gear": None, "anvil": True, "plate": False, "widget": True, "gizmo": False}

DATED = r"""dated AS (SELECT *, CAST(coalesce(nullif(regexp_extract(coalesce(period, ''), '(\d{4})', 1), ''),
      nullif(regexp_extract(dimension_value, '(\d{4})', 1), '')) AS INTEGER) AS year,
      dimension_value = 'national' AS nat FROM data_points),
  yv AS (SELECT metric, year, arg_max(value, CASE WHEN nat THEN pos ELSE -pos END + CASE WHEN nat THEN 0 ELSE -1e18::BIGINT END) AS value
    FROM dated WHERE year IS NOT NULL GROUP BY ALL),
  points AS (SELECT * FROM yv WHERE metric IN (SELECT metric FROM yv GROUP BY metric HAVING count(*) >= 3))"""


@register("series_points", "data_points", f"WITH {DATED} SELECT * FROM points")
def series_points(v):
    """One value per metric and year; national rows win."""
    return sr.series_points(v.data_points())


@register(
    "catalog_series",
    "data_points",
    f"""WITH {DATED}, a AS (SELECT metric, string_agg(year || '=' || value, ';' ORDER BY year) AS points FROM points GROUP BY metric),
    s AS (SELECT metric, source_org, source_url, min(pos) AS pos FROM data_points WHERE source_url IS NOT NULL GROUP BY ALL),
    s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY pos) AS rn FROM s) WHERE rn <= 2),
    s3 AS (SELECT metric, string_agg(split_part(split_part(source_org, ' — ', 1), ' (', 1) || '|' || source_url, ';' ORDER BY pos) AS sources
      FROM s2 GROUP BY metric),
    h AS (SELECT metric, arg_min(unit, pos) AS unit, arg_max(notes, pos) AS note FROM data_points GROUP BY metric)
    SELECT metric, points, CASE unit WHEN 'count' THEN 'מספר מוחלט לשנה' ELSE unit END AS unit, note, left(note, 240) AS note_display, sources
    FROM a JOIN h USING (metric) LEFT JOIN s3 USING (metric)""",
)
def catalog_series(v):
    """Exported series with points, unit, note and two sources."""
    out = sr.build_series(cut_lineage(v.data_points()))  # read five times below
    return out.select(
        "metric",
        F.array_join(F.transform("points", lambda p: F.concat(p["year"], F.lit("="), p["value"])), ";").alias("points"),
        "unit",
        "note",
        "note_display",
        F.array_join(F.transform("sources", lambda s: F.concat(s["org"], F.lit("|"), s["url"])), ";").alias("sources"),
    )


@register(
    "series_export",
    "data_points",
    f"""WITH {DATED}, a AS (SELECT metric, string_agg(year || '=' || value, ';' ORDER BY year) AS points FROM points GROUP BY metric),
      i AS (SELECT DISTINCT 'price_' || lower(p_brand) AS metric, p_brand AS label,
        CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%2' THEN 'low' ELSE 'high' END AS category FROM part WHERE p_brand NOT LIKE '%5')
    SELECT metric, label, category, points FROM a JOIN i USING (metric)""",
)
def series_export(v):
    """Series of the chosen metrics with the caller's label and category."""
    brand = F.col("p_brand")
    include = v.table("part").filter(~brand.endswith("5")).select(
        F.concat(F.lit("price_"), F.lower(brand)).alias("metric"),
        brand.alias("label"),
        F.when(brand.endswith("1") | brand.endswith("2"), "low").otherwise("high").alias("category"),
    )
    out = sr.build_series(cut_lineage(v.data_points()), include=include.distinct())
    text = F.transform("points", lambda p: F.concat(p["year"], F.lit("="), p["value"]))
    return out.select("metric", "label", "category", F.array_join(text, ";").alias("points"))


MATCHED = "m AS (SELECT a.*, string_split(position, ' ')[-1] AS key FROM appointments a)"


@register("series_match", "appointments", f"WITH {MATCHED} SELECT person_id, pos, position, key FROM m")
def series_match(v):
    """The series each appointment belongs to, by keyword."""
    return sr.match_series(v.appointments(), cut_lineage(v.series())).select("person_id", "pos", "position", "key")


@register(
    "tenure_trends",
    "appointments series",
    f"""WITH {MATCHED}, j AS (SELECT m.*, label, unit, points, CAST(left(start_date, 4) AS INTEGER) AS ty FROM m JOIN series s USING (key)
        WHERE len(points) >= 2),
      p AS (SELECT *, coalesce(list_filter(points, lambda x: x.year = ty)[1], list_filter(points, lambda x: x.year >= ty)[1], points[1]) AS f,
        points[-1] AS l FROM j),
      d AS (SELECT *, CASE WHEN key IN ('gear', 'rod') OR l.value = f.value THEN 'neutral'
          WHEN (l.value > f.value) = (key IN ('ring', 'anvil', 'widget')) THEN 'good' ELSE 'bad' END AS direction
        FROM p WHERE f.year <> l.year),
      r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY (direction = 'neutral')::INTEGER, pos) AS rn FROM d)
    SELECT CAST(person_id AS VARCHAR) AS person_id, direction, label, unit, f.year AS from_year, f.value AS from_value,
      l.year AS to_year, l.value AS to_value, ministry, key FROM r WHERE rn = 1""",
)
def tenure_trends(v):
    """The trend of the matching series since each person took office."""
    roster = v.actors().withColumn("pos", F.col("person_id"))
    return sr.tenure_trends(v.appointments(), cut_lineage(v.series()), roster, GOOD)


@register(
    "change_summary",
    "series",
    """SELECT key, label, unit, points[1].year AS first_year, points[1].value AS first_value, points[-1].year AS last_year,
      points[-1].value AS last_value, CASE WHEN points[-1].value = points[1].value THEN ''
        WHEN points[-1].value > points[1].value THEN '▲' ELSE '▼' END AS arrow,
      array_to_string(list_transform(points, lambda p: CAST(floor(p.value / greatest(list_max(list_transform(points, lambda q: q.value)), 1)
        * 100 + 0.5) AS INTEGER)), ',') AS bars FROM series""",
)
def change_summary(v):
    """First and last value, arrow and bar heights of every series."""
    out = sr.change_summary(v.series())
    return out.withColumn("bars", F.array_join(F.col("bars").cast("array<string>"), ","))


@register(
    "series_override",
    "series data_points",
    f"""WITH {DATED}, c AS (SELECT CASE metric WHEN 'price_brand#1' THEN 'gear' ELSE metric END AS key, metric AS label,
        string_agg(year, ',' ORDER BY year) AS years FROM points GROUP BY metric)
    SELECT key, label, array_to_string(list_transform(points, lambda p: p.year), ',') AS years FROM series WHERE key <> 'gear'
    UNION ALL SELECT * FROM c""",
)
def series_override(v):
    """Two series sets merged; the catalog's replaces the portfolio's with the same key."""
    built = sr.build_series(cut_lineage(v.data_points()))
    key = F.when(F.col("metric") == "price_brand#1", "gear").otherwise(F.col("metric"))
    other = built.select(key.alias("key"), F.col("metric").alias("label"), "points")
    base = v.series().select(
        "key", "label", F.transform("points", lambda p: F.struct(p["year"].alias("year"), p["value"].alias("value"))).alias("points")
    )
    merged = sr.merge_series(base, other)
    return merged.select(
        "key", "label", F.array_join(F.transform("points", lambda p: p["year"].cast("string")), ",").alias("years")
    )


@register("series_filter", "series", "SELECT key, label FROM series WHERE contains(lower(label || key || note), 'g')")
def series_filter(v):
    """Series whose text holds the query."""
    return sr.filter_series(v.series(), "G").select("key", "label")


@register(
    "latest_points",
    "series",
    "SELECT key, unit, points[-1].year AS year, points[-1].value AS value, 'https://s.example/' || key AS source_url FROM series",
)
def latest_points(v):
    return sr.latest_points(v.series()).select("key", "unit", "year", "value", "source_url")


# --- catalog upkeep -----------------------------------------------------------------
PORTFOLIO = """pp AS (SELECT CASE key WHEN 'ring' THEN 'price_brand#1' ELSE 'units_' || key END AS metric,
      'year' AS dimension_type, CAST(p.year AS VARCHAR) AS dimension_value, p.value AS value
    FROM (SELECT key, unnest(points) AS p FROM series) WHERE key IN ('ring', 'bolt', 'gear'))"""
PORTFOLIO_METRICS = {"ring": "price_brand#1", "bolt": "units_bolt", "gear": "units_gear"}


@register(
    "portfolio_points",
    "series",
    """SELECT 'units_' || key AS metric, 'year' AS dimension_type, CAST(p.year AS VARCHAR) AS dimension_value, p.value AS value,
      'Sales office' AS source_org, label || ': ' || p.year || ' = ' || p.value || CASE WHEN p.year = 2001 THEN ' (ארעי)' ELSE '' END
        AS confirm_quote FROM (SELECT key, label, unnest(points) AS p FROM series)""",
)
def portfolio_points(v):
    """Series points as catalog rows."""
    out = sr.portfolio_points(v.series(), F.concat(F.lit("units_"), "key"))
    return out.select("metric", "dimension_type", "dimension_value", "value", "source_org", "confirm_quote")


def _stored_points(v):
    """The catalog with its promo rows tagged as an earlier portfolio run."""
    cols = ["metric", "dimension_type", "dimension_value", "value"]
    tag = F.col("dimension_value") == "national"
    return v.data_points().select(*cols, tag.alias("from_portfolio"))


@register(
    "replace_tagged",
    "data_points series",
    f"""WITH {PORTFOLIO} SELECT metric, dimension_type, dimension_value, value, false AS from_portfolio FROM data_points
      WHERE dimension_value <> 'national' UNION ALL SELECT *, true FROM pp""",
)
def replace_tagged_query(v):
    """Drop the tagged rows of earlier runs and append this run's portfolio points."""
    new = sr.portfolio_points(v.series(), PORTFOLIO_METRICS)
    new = new.select("metric", "dimension_type", "dimension_value", "value", "from_portfolio")
    return replace_tagged(_stored_points(v), new, "from_portfolio")


@register(
    "replace_tagged_metrics",
    "data_points series",
    f"""WITH {PORTFOLIO} SELECT metric, dimension_type, dimension_value, value, dimension_value = 'national' AS from_portfolio
      FROM data_points WHERE NOT (dimension_value = 'national' AND metric IN (SELECT metric FROM pp))
      UNION ALL SELECT *, true FROM pp""",
)
def replace_tagged_metrics(v):
    """As above, but only for the metrics of this run."""
    new = sr.portfolio_points(v.series(), PORTFOLIO_METRICS)
    new = new.select("metric", "dimension_type", "dimension_value", "value", "from_portfolio")
    return replace_tagged(_stored_points(v), new, "from_portfolio", within=["metric"])


@register(
    "append_absent",
    "data_points",
    """WITH new AS (SELECT metric, dimension_value, period, value + 1 AS value, pos FROM data_points),
      old AS (SELECT * FROM data_points WHERE unit = 'units')
    SELECT metric, dimension_value, period, value FROM old UNION ALL
    SELECT metric, dimension_value, period, value FROM (SELECT *, row_number() OVER (PARTITION BY metric, dimension_value, period
        ORDER BY pos) AS rn FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.metric = n.metric
        AND o.dimension_value = n.dimension_value AND o.period IS NOT DISTINCT FROM n.period)) WHERE rn = 1""",
)
def append_absent(v):
    """Append the points whose (metric, dimension, period) is not stored; null periods are equal."""
    points = v.data_points().select("metric", "dimension_value", "period", "value", "unit", "pos")
    stored = points.filter(F.col("unit") == "units").select("metric", "dimension_value", "period", "value")
    new = points.withColumn("value", F.col("value") + 1)
    return insert_absent(stored, new, ["metric", "dimension_value", "period"], ["pos"])


def _verified(v):
    """The yearly series as research output."""
    return v.series().select(
        "key",
        "label",
        "unit",
        F.col("match").alias("ministry_match"),
        "note",
        F.lit("Research").alias("source_org"),
        F.concat(F.lit("https://r.example/"), "key").alias("source_url"),
        "points",
    )


@register(
    "research_points",
    "series",
    """SELECT CASE key WHEN 'ring' THEN 'm_ring' ELSE 'm_gear' END AS metric, CAST(p.year AS VARCHAR) AS period, p.value AS value,
      label || ': ' || p.year || ' = ' || p.value AS confirm_quote, 'https://r.example/' || key AS source_url
    FROM (SELECT key, label, unnest(points) AS p FROM series) WHERE key IN ('ring', 'gear')""",
)
def research_points(v):
    """Catalog points of the research series that belong to a checked topic."""
    out = sr.research_points(_verified(v), {"ring": "m_ring", "gear": "m_gear"})
    return out.select("metric", "period", "value", "confirm_quote", "source_url")


@register(
    "research_series",
    "series data_points",
    """SELECT key, label, note, 'https://r.example/' || key AS url, CAST(len(points) AS INTEGER) AS points FROM series""",
)
def research_series(v):
    """Research output as portfolio series."""
    out = sr.research_series(_verified(v))
    return out.select("key", "label", "note", F.get("sources", 0)["url"].alias("url"), F.size("points").alias("points"))


@register(
    "measured_points",
    "yearly",
    """SELECT 'units_' || key AS metric, 'year' AS dimension_type, CAST(year AS VARCHAR) AS dimension_value,
      CASE WHEN year = 2001 THEN 'so far' ELSE CAST(year AS VARCHAR) END AS period, value,
      'Sales of ' || key || ': ' || year || ' = ' || value AS confirm_quote FROM yearly WHERE key <> 'rod'""",
)
def measured_points(v):
    """Verified metrics with their own dimensions; a metric without a name is skipped."""
    point = F.col("points")
    shaped = F.transform(
        point,
        lambda p: F.struct(
            p["year"].alias("dimension_value"), p["value"].alias("value"), F.when(p["provisional"], "so far").alias("period")
        ),
    )
    verified = _verified(v).select(
        F.when(F.col("key") != "rod", F.concat(F.lit("units_"), "key")).alias("metric"),
        F.lit(None).cast("string").alias("dimension_type"),
        "label",
        "unit",
        "source_org",
        "source_url",
        shaped.alias("points"),
    )
    out = sr.measured_points(verified)
    return out.select("metric", "dimension_type", "dimension_value", "period", "value", "confirm_quote")


@register(
    "yearly_ratio",
    "",
    "SELECT o_orderkey AS id, CAST(format('{:.1f}', o_totalprice / 12) AS DOUBLE) AS yearly FROM orders",
)
def yearly_ratio(v):
    """Monthly figures as yearly ratios."""
    return v.table("orders").select(F.col("o_orderkey").alias("id"), sr.yearly_ratio(F.col("o_totalprice")).alias("yearly"))


@register(
    "catalog_overview",
    "data_points",
    "SELECT count(*) AS points, count(DISTINCT metric) AS metrics FROM data_points",
)
def catalog_overview(v):
    return sr.catalog_overview(v.data_points())


@register("catalog_metrics", "data_points", "SELECT metric, count(*) AS points FROM data_points GROUP BY metric")
def catalog_metrics(v):
    return sr.catalog_metrics(v.data_points())
