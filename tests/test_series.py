"""Series, trends and catalog points."""

from pyspark.sql import functions as F

from factledger.plans import series as sr

POINTS = (
    "pos int, metric string, dimension_value string, value double, unit string, period string, source_org string, "
    "source_url string, notes string"
)
SERIES = (
    "pos int, key string, label string, unit string, match array<string>, note string, "
    "sources array<struct<org:string,url:string>>, points array<struct<year:int,value:double,provisional:boolean>>"
)


def test_build_series(spark):
    data = [
        (1, "m", "חיפה", 5.0, "count", 'תשפ"ב (2021)', "למס — ירושלים", "u1", "first"),
        (2, "m", "ארצי", 6.0, "count", "2021", "למס — ירושלים", "u1", ""),
        (3, "m", "national", 7.0, "count", "2021", "בנק (IL)", "u2", ""),
        (4, "m", "2022", 8.0, "count", None, "אחר", "u3", ""),
        (5, "m", "2020", 9.0, "count", "0000", "x", "", None),
        (6, "m", "חיפה", 1.0, "count", "2022", "x", None, ""),
        (7, "short", "a", 1.0, "%", "2020", "x", "u", ""),
        (8, "short", "a", 1.0, "%", "2021", "x", "u", ""),
    ]
    out = sr.build_series(spark.createDataFrame(data, POINTS)).collect()
    assert len(out) == 1
    s = out[0]
    # the last national value wins a year, else the first value
    assert [tuple(p) for p in s.points] == [(2020, 9.0), (2021, 7.0), (2022, 8.0)]
    assert s.unit == "מספר מוחלט לשנה" and s.note == "first"
    assert [tuple(x) for x in s.sources] == [("למס", "u1"), ("בנק", "u2")]


def series(spark):
    return spark.createDataFrame(
        [
            (0, "gdp_growth", "צמיחה", "%", ["אוצר"], "n", [("o", "u")], [(2020, 1.0, None), (2022, 3.0, None), (2023, 5.0, True)]),
            (1, "housing", "דיור", "%", ["שיכון", "אוצר"], None, [], [(2019, 5.0, None), (2023, 9.0, None)]),
            (2, "mobile_price_index", "סלולר", "%", ["תקשורת"], None, [], [(2020, 1.0, None), (2023, 2.0, None)]),
            (3, "health", "בריאות", "", ["בריאות"], None, [], [(2020, 1.0, None)]),
        ],
        SERIES,
    )


APPOINTMENTS = "pos int, person_id bigint, name string, position string, ministry string, start_date string"


def trends(spark, data):
    roster = spark.createDataFrame([(0, 77, 'ישראל "כהן"'), (1, 78, "ישראל כהן")], "pos int, person_id bigint, name string")
    out = sr.tenure_trends(spark.createDataFrame(data, APPOINTMENTS), series(spark), roster)
    return {r.person_id: r for r in out.collect()}


def test_trend_start_point(spark):
    got = trends(
        spark,
        [
            (0, 1, "a", "שר האוצר", "", "2021-06-01"),  # gap year: the next point
            (1, 2, "b", "שר האוצר", "", "2022-01-01"),
            (2, 3, "c", "שר האוצר", "", "2030-01-01"),  # later than all: the first point
            (3, 4, "d", "שר האוצר", "", ""),
            (4, 5, "e", "שר האוצר", "", "2023-01-01"),  # same first and last year
            (5, 6, "f", "שר הבריאות", "", "2020-01-01"),  # one point only
            (6, 7, "g", "", "שיכון", "2019-01-01"),
        ],
    )
    assert {k: (v.key, v.from_year, v.to_year, v.direction) for k, v in got.items()} == {
        "1": ("gdp_growth", 2022, 2023, "good"),
        "2": ("gdp_growth", 2022, 2023, "good"),
        "3": ("gdp_growth", 2020, 2023, "good"),
        "4": ("gdp_growth", 2020, 2023, "good"),
        "7": ("housing", 2019, 2023, "bad"),
    }


def test_first_decisive_else_first_neutral(spark):
    neutral, decisive = ("שר התקשורת", "2020"), ("שר האוצר", "2020")
    got = trends(
        spark,
        [
            (0, 1, "a", neutral[0], "n1", neutral[1]),
            (1, 1, "a", decisive[0], "d", decisive[1]),
            (2, 2, "b", decisive[0], "d", decisive[1]),
            (3, 2, "b", neutral[0], "n1", neutral[1]),
            (4, 3, "c", neutral[0], "n1", neutral[1]),
            (5, 3, "c", neutral[0], "n2", neutral[1]),
        ],
    )
    assert {k: (v.direction, v.ministry) for k, v in got.items()} == {
        "1": ("good", "d"),
        "2": ("good", "d"),
        "3": ("neutral", "n1"),
    }


def test_roster_name_wins_and_last_duplicate_counts(spark):
    got = trends(spark, [(0, 1, "ישראל 'כהן'", "שר האוצר", "", "2020")])
    assert list(got) == ["78"]


def test_change_summary(spark):
    got = {r.key: r for r in sr.change_summary(series(spark)).collect()}
    s = got["gdp_growth"]
    assert (s.first_value, s.last_value, s.arrow, s.bars) == (1.0, 5.0, "▲", [20, 60, 100])
    assert got["health"].arrow == "" and got["health"].bars == [100]


def test_merge_and_filter(spark, rows):
    override = series(spark).filter("key = 'health'").withColumn("label", F.lit("new"))
    merged = sr.merge_series(series(spark), override)
    assert merged.count() == 4 and rows(merged.filter("key = 'health'"), "label") == [("new",)]
    assert rows(sr.filter_series(series(spark), " אוצר "), "key") == [("gdp_growth",), ("housing",)]
    assert sr.filter_series(series(spark), "").count() == 4


def test_portfolio_points(spark, rows):
    out = sr.portfolio_points(series(spark))
    assert rows(out, "metric", "period", "confirm_quote") == [
        ("home_price_index", "2019", "דיור: 2019 = 5.0"),
        ("home_price_index", "2023", "דיור: 2023 = 9.0"),
    ]
    out = sr.portfolio_points(series(spark), {"gdp_growth": "g"})
    assert rows(out, "confirm_quote")[-1] == ("צמיחה: 2023 = 5.0 (ארעי)",)


def test_yearly_ratio(spark):
    df = spark.createDataFrame([(132.3,), (138.6,), (150.4,)], "m double")
    assert [r[0] for r in df.select(sr.yearly_ratio(F.col("m"))).collect()] == [round(x / 12, 1) for x in (132.3, 138.6, 150.4)]


def test_series_map_order(spark):
    df = spark.createDataFrame([({"b": {"points": []}, "a": {"points": []}},)], "series map<string,struct<points:array<int>>>")
    got = sorted((r.pos, r.key) for r in sr.series_from_map(df).collect())
    assert len(got) == 2 and {k for _, k in got} == {"a", "b"}
