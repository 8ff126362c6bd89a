"""Ranking and merge operators, with one group holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from factledger.operators.merge import (
    append_unnamed,
    insert_absent,
    merge_rows,
    not_in,
    replace_groups,
    replace_tagged,
    union_first,
    union_keys,
    with_entry,
)
from factledger.operators.ranking import last_by, numbered, running_total, top_rows

import pytest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=20000):
    """One key holds more than a third of the rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 97).alias("g"), F.hash("id").alias("v"), "id"
    )


def test_numbered_matches_a_window(spark):
    df = skewed(spark)
    got = numbered(df, ["v", "id"], ["g"])
    expected = F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))
    assert got.count() == 20000
    assert got.withColumn("w", expected).filter(F.col("w") != F.col("row_no")).count() == 0


def test_numbered_without_groups_has_no_gaps(spark):
    got = numbered(skewed(spark, 5000), ["v", "id"], start=0)
    assert sorted(r[0] for r in got.select("row_no").collect()) == list(range(5000))


def test_numbered_never_windows_the_rows(spark):
    got = numbered(skewed(spark, 500), ["v", "id"], ["g"])
    text = plan(got)
    assert "row_number" not in text


def test_numbered_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = sorted(map(tuple, numbered(df, ["v"], ["g"]).select("v", "row_no").collect()))
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_top_rows_limits_before_the_shuffle(spark):
    df = skewed(spark)
    text = plan(top_rows(df, ["g"], ["v", "id"], 3))
    exchange = text.index("Exchange")
    assert "WindowGroupLimit" in text[exchange:]  # below the exchange: partial limit
    assert top_rows(df, ["g"], ["v", "id"], 3).groupBy("g").count().filter("count > 3").count() == 0


def test_last_by(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(map(tuple, last_by(df, ["k"], ["o"], ["v"]).collect())) == [(1, "b"), (2, "c")]


def test_merge_rules(spark, rows):
    stored = spark.createDataFrame(
        [(1, "a", "name", "x"), (None, "b", "n2", "y"), (3, "c", "n3", "z")], "k int, v string, nm string, ids string"
    )
    new = spark.createDataFrame(
        [(1, "A", "", "-", 1), (1, None, None, "-", 2), (None, "B", "N2", "-", 1), (4, "D", "", "new", 1)],
        "k int, v string, nm string, ids string, o int",
    )
    got = rows(merge_rows(stored, new, ["k"], ["o"], keep_first=["ids"], keep_present=["nm"]))
    assert got == sorted(
        [(1, None, "name", "x"), (None, "B", "N2", "y"), (3, "c", "n3", "z"), (4, "D", "", "new")], key=repr
    )


def test_merge_is_idempotent(spark, rows):
    stored = spark.createDataFrame([(1, None, 5.0)], "m int, period string, v double")
    new = stored.withColumn("o", F.lit(1))
    once = merge_rows(stored, new, ["m", "period"], ["o"])
    twice = merge_rows(once, new, ["m", "period"], ["o"])
    assert rows(once) == rows(twice) == [(1, None, 5.0)]


def test_not_in_is_null_safe(spark, rows):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "a")], "p int, v string")
    known = spark.createDataFrame([(1, None), (None, "a")], "p int, v string")
    assert rows(not_in(df, known, ["p", "v"])) == [(1, "a")]


def test_insert_absent_keeps_stored_and_first_new(spark, rows):
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new", 1), (2, "b", 2), (2, "a", 1)], "k int, v string, pos int")
    assert rows(insert_absent(stored, new, ["k"], ["pos"])) == [(1, "old"), (2, "a")]


def test_replace_groups(spark, rows):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "A"), (1, "AA")], "p int, v string")
    refreshed = spark.createDataFrame([(1,), (2,)], "p int")
    # 1 replaced, 2 fetched empty, 3 not fetched
    assert rows(replace_groups(stored, new, ["p"], refreshed)) == [(1, "A"), (1, "AA"), (3, "c")]


def test_replace_tagged(spark, rows):
    stored = spark.createDataFrame([("m1", 1, True), ("m2", 2, True), ("m1", 3, None)], "m string, v int, t boolean")
    new = spark.createDataFrame([("m1", 9, True)], "m string, v int, t boolean")
    assert rows(replace_tagged(stored, new, "t"), "m", "v") == [("m1", 3), ("m1", 9)]
    assert rows(replace_tagged(stored, new, "t", within=["m"]), "m", "v") == [("m1", 3), ("m1", 9), ("m2", 2)]


def test_append_unnamed(spark, rows):
    roster = spark.createDataFrame([(1, "נפתלי בנט הצעיר"), (2, "אחר")], "person_id int, name string")
    figures = spark.createDataFrame([(9, "נפתלי בנט"), (8, "חדש"), (7, "אחר")], "person_id int, name string")
    assert rows(append_unnamed(roster, figures), "person_id") == [(1,), (2,), (8,)]


def test_union_keys_and_first(spark, rows):
    a = spark.createDataFrame([("v1", 0), ("v2", 1), (None, 2)], "video_id string, pos int")
    b = spark.createDataFrame([("v2", 0), ("v3", 1)], "video_id string, pos int")
    assert rows(union_first([a, b], "video_id")) == [("v1", 0, 0), ("v2", 1, 0), ("v3", 1, 1)]
    assert rows(union_keys(a.select("video_id"), b.select("video_id")).filter("video_id is not null")) == [
        ("v1",),
        ("v2",),
        ("v3",),
    ]


def test_with_entry(spark):
    df = spark.createDataFrame([({"a": "1", "k": "old"}, "new"), (None, "new"), ({"a": "1"}, None)], "m map<string,string>, v string")
    got = [r[0] for r in df.select(with_entry(F.col("m"), "k", F.col("v"))).collect()]
    assert got == [{"a": "1", "k": "new"}, {"k": "new"}, {"a": "1"}]


def test_broadcast_needs_a_checked_size(spark):
    from factledger.operators.joins import broadcast_if_small

    facts = spark.range(1000).withColumn("k", F.col("id") % 10)
    lookup = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(facts.join(broadcast_if_small(lookup, 10_000), "k"))
        large = plan(facts.join(broadcast_if_small(lookup, 99), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in small and "BroadcastHashJoin" not in large


def test_spread_leaves_wide_inputs_alone(spark):
    from factledger.operators.layout import spread

    cores = spark.sparkContext.defaultParallelism
    narrow, wide = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores)
    assert spread(narrow, "id").rdd.getNumPartitions() == cores
    assert spread(wide, "id") is wide


def test_running_total_spreads_a_group(spark):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 10 == 9).alias("k"), (F.col("id") * 7 % 5000).alias("at"), F.lit(2).alias("n"))
    got = running_total(df, ["k"], ["at"], "n", "upto").collect()
    for k in (True, False):
        own = sorted((r["at"], r["upto"]) for r in got if r["k"] == k)
        assert [u for _, u in own] == [2 * (i + 1) for i in range(len(own))]


def test_containing(spark, rows):
    from factledger.operators.contains import containing

    texts = spark.createDataFrame([("abcdef",), ("xyz",), ("",), (None,), ("abc",)], "t string")
    words = spark.createDataFrame([("abcd",), ("z",), ("",), ("ef",), ("abcx",), (None,)], "w string")
    wanted = [(t, w) for t in ("abcdef", "xyz", "", "abc") for w in ("abcd", "z", "", "ef", "abcx") if w in t]
    assert rows(containing(texts, "t", words, "w")) == sorted(wanted, key=repr)


def containing_cases():
    texts = ["abcabc", "", None, "שלום עולם", "x" * 500, "aab", "ab", "nested words nest", "Straße", "a\nb", "abcabc"]
    words = ["a", "ab", "abc", "", None, "עולם", "nest", "sted w", "xx", "missing", "ß", "\n", "ab", "abcabcabc", "x" * 500]
    wanted = {(t, w) for t in texts for w in words if t is not None and w is not None and w in t}
    return texts, words, sorted(wanted, key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60, 24])
def test_containing_by_automaton(spark, rows, part_bytes):
    from factledger.operators.contains import containing

    texts, words, wanted = containing_cases()
    held = spark.createDataFrame([(t,) for t in texts], "t string")
    asked = spark.createDataFrame([(w,) for w in words], "w string")
    assert rows(containing(held, "t", asked, "w", part_bytes, 700)) == wanted
    assert rows(containing(held.limit(0), "t", asked, "w", part_bytes)) == []
    assert rows(containing(held, "t", asked.limit(0), "w", part_bytes)) == []


def test_containing_is_linear_in_long_texts(spark):
    from factledger.operators.contains import containing

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=100_000)) for _ in range(12)]
    words = sorted({"".join(rng.choices("abcdefgh ", k=rng.randrange(3, 9))) for _ in range(2000)})
    held = spark.createDataFrame([(t,) for t in texts], "t string")
    found = containing(held, "t", spark.createDataFrame([(w,) for w in words], "w string"), "w")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert found.count() == sum(w in t for t in texts for w in words)


def test_sorting_tasks_read_bounded_parts(spark):
    from factledger.operators.merge import merge_rows

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "128MB")
        spark.conf.set(keys[1], "1m")
        rows = spark.createDataFrame([(1, 2)], "a int, at int")
        assert merge_rows(rows.limit(0), rows, ["a"], ["at"]).count() == 1
        assert [spark.conf.get(k) for k in keys] == [f"{16 << 20}b", "1m"]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
