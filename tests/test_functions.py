"""Column functions on the awkward values upstream feeds contain."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factledger.functions import casts, numbers, text
from factledger.plans.conflicts import metric_of, percent_in


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_to_int(spark):
    values = ["965", "965.0", "true", "", "abc", " 12\t", "1e3", "1d", "-4.9", None]
    assert apply(spark, values, casts.to_int) == [965, 965, None, None, None, 12, 1000, None, -4, None]


def test_to_bool(spark):
    assert apply(spark, ["True", " y ", "0", "NO", "maybe", None], casts.to_bool) == [True, True, False, False, None, None]


def test_to_date_keeps_the_local_day(spark):
    values = [
        "2023-12-31T00:30:00+02:00",
        "2023-12-31T23:30:00Z",
        "2023-12-31",
        "/Date(1700000000000+0200)/",
        "/Date(-1000)/",
        "20231231",
        "2023-12-31 or so",
        "2023-02-30",
        "garbage",
        None,
    ]
    day = datetime.date
    expected = [day(2023, 12, 31)] * 3 + [day(2023, 11, 14), day(1969, 12, 31), day(2023, 12, 31), day(2023, 12, 31)]
    assert apply(spark, values, casts.to_date) == expected + [None, None, None]


def test_stances(spark):
    values = ["0", "1", "2.0", "3", "4", "5", "בעד", " לא הצביע ", "AYE", "who knows", None]
    expected = ["na", "for", "against", "abstain", "absent", "na", "for", "absent", "for", "na", "na"]
    assert apply(spark, values, casts.stance_of) == expected


def test_vote_result(spark):
    assert apply(spark, ["1", "false", "?", None], casts.vote_result_of) == ["passed", "failed", "unknown", "unknown"]


def test_member_keys_are_padded_but_never_cut(spark):
    values = ["965", "000000965", "1234567890", "abc"]
    assert apply(spark, values, casts.padded_member_key) == ["000000965", "000000965", "1234567890", "abc"]


def test_year_in(spark):
    assert apply(spark, ['תשפ"ו (2025)', "2024/25", "12 345", "0000", None], casts.year_in) == [2025, 2024, None, None, None]


def test_start_year(spark):
    assert apply(spark, ["2022-12-29T00:00:00", "", "0000-01-01", "soon", None], casts.start_year) == [2022] + [None] * 4


def test_strip_is_unicode_aware(spark):
    assert apply(spark, ["\t a\xa0", " ", "", None], text.clean_text) == ["a", None, None, None]


def test_name_keys(spark):
    assert apply(spark, [' ח"כ ׳א׳ ', None], text.person_name_key) == ["חכ א", ""]
    assert apply(spark, ["A-b ג! 3", None], text.alnum_key) == ["abג3", ""]


def test_preview(spark):
    long = "x" * 201
    assert apply(spark, ["a", "y" * 200, long, None], text.preview) == ["a", "y" * 200, "x" * 200 + "...", ""]


def test_short_org(spark):
    assert apply(spark, ["למס — שנתי", "Bank (IL) x", "z" * 70], text.short_org) == ["למס", "Bank", "z" * 60]


def test_links_and_clocks(spark):
    df = spark.createDataFrame(
        [("http://a", 61.9), ("http://a?x=1", 3.2), (None, 1.0), ("", 3725.0)], "u string, s double"
    )
    got = [tuple(r) for r in df.select(text.moment_link(F.col("u"), F.col("s")), text.clock_label(F.col("s"))).collect()]
    assert got == [("http://a?t=61", "01:01"), ("http://a?x=1&t=3", "00:03"), ("#", "00:01"), ("#", "62:05")]


def test_slug(spark):
    df = spark.createDataFrame([(0, 7), (5, 7), (None, 7)], "o bigint, i bigint")
    got = [r[0] for r in df.select(text.person_slug(F.col("o"), F.col("i"))).collect()]
    assert got == ["person-7", "person-5", "person-7"]


def test_unit_label(spark):
    assert apply(spark, ["%", "percent", "tons"], text.unit_label) == ["אחוז (%)", "אחוז (%)", "tons"]


def test_transcript_parts_cover_the_whole_text(spark):
    df = spark.createDataFrame(
        [([("abcdef",), ("gh",), (None,), ("i",)],), ([],), ([("a",), ("b",), ("cdef",)],)], "s array<struct<text:string>>"
    )
    got = [r[0] for r in df.select(text.transcript_parts(F.col("s"), 4)).collect()]
    assert got == [["abcdef", "gh ", "i"], [""], ["a b", "cdef"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=300), st.sampled_from([0, 1, 4]))
def test_rounding_agrees_with_exact_half_even(spark, numerators, digits):
    values = [n / 20000 for n in numerators] + [2.675, 1.005, 0.5, 1.5, -2.5]
    got = apply(spark, values, lambda x: numbers.round_half_even(x, digits), "double")
    assert got == [round(v, digits) for v in values]


def test_percent_of_max(spark):
    got = apply(spark, [0.5, 3.0, 4.0], lambda x: numbers.percent_of_max(x, F.lit(4.0)), "double")
    assert got == [13, 75, 100]


def test_float_text(spark):
    values = [5.0, 0.1, 12345678.9, 1e7, 0.0005]
    assert apply(spark, values, numbers.float_text, "double") == [str(v) for v in values]


def test_percentages(spark):
    values = ["עלה ב-12.5 אחוז וגם 7%", "12.55%", "20 %", "no", "٣%"]
    got = apply(spark, values, percent_in)
    assert got[:4] == [12.5, 55.0, 20.0, None]


def test_metric_order(spark):
    values = ["האבטלה והאינפלציה", "גיוס ואבטלה", "שלום"]
    assert apply(spark, values, metric_of) == ["אבטלה", "גיוס לצה״ל", None]
