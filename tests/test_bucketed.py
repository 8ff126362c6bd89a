"""Stored tables in buckets: only touched buckets are rewritten, old versions stay readable."""

import os

import pytest

from factledger.operators.merge import merge_rows
from factledger.sources.bucketed import BucketedTable

SCHEMA = "k long, part string, v long, at long"


def files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{table.folder}/data") for f in names if f.endswith(".parquet")}


def versions(table):
    return {b: int(w.split("-")[0]) for b, w in table.bucket_writes().items()}


def rule(stored, new):
    return merge_rows(stored, new, ["k", "part"], ["at"])


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return BucketedTable(spark, str(tmp_path / "t"), schema, ["k", "part"], buckets=16)


def test_merges_rewrite_touched_buckets_only(spark, table, rows):
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    first = [(i, "a" if i % 3 else None, i, 1) for i in range(200)]
    assert table.merge(make(first), rule) == 1
    before, places = files(table), versions(table)
    assert len(places) == 16 and set(places.values()) == {1}

    change = [(5, "a", 500, 2), (6, None, 600, 2), (1000, "new", 1, 2), (5, "a", 501, 3)]
    old_reader = table.read()
    assert table.merge(make(change), rule) == 2
    touched = {b for b, v in versions(table).items() if v == 2}
    assert 1 <= len(touched) <= 3
    assert before <= files(table)
    assert {b: v for b, v in versions(table).items() if b not in touched} == {b: 1 for b in places if b not in touched}

    want = {(k, p): (v, at) for k, p, v, at in first}
    want |= {(5, "a"): (501, 3), (6, None): (600, 2), (1000, "new"): (1, 2)}
    assert rows(table.read()) == sorted(((k, p, v, at) for (k, p), (v, at) in want.items()), key=repr)
    assert rows(old_reader) == rows(table.read(1)) == sorted(first, key=repr)
    assert rows(table.rows_of({"k": 6, "part": None})) == [(6, None, 600, 2)]
    scan = table.rows_of({"k": 6, "part": None})
    assert len({f.split("bucket=")[1].split("/")[0] for f in scan.inputFiles()}) == 1


def test_a_cut_off_merge_leaves_the_last_version(spark, table, rows):
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    table.merge(make([(1, "a", 1, 1)]), rule)

    def fails(stored, new):
        merged = rule(stored, new)
        merged.write.parquet(f"{table.folder}/data/2-lost/bucket=99")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        table.merge(make([(1, "a", 2, 2)]), fails)
    assert table.version() == 1 and rows(table.read()) == [(1, "a", 1, 1)]
    assert table.merge(make([(1, "a", 3, 3)]), rule) == 2
    assert rows(table.read()) == [(1, "a", 3, 3)]


def test_deleting_rules_and_empty_tables(spark, table, rows):
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(table.read()) == [] and table.version() == 0
    assert table.merge(make([]), rule) == 0
    table.merge(make([(i, "a", i, 1) for i in range(10)]), rule)
    gone = lambda stored, new: stored.join(new.select("k"), "k", "left_anti").select(stored.columns)
    table.merge(make([(3, "a", 0, 0)]), gone)
    assert [r[0] for r in rows(table.read())] == [i for i in range(10) if i != 3]


def test_the_second_writer_of_a_version_fails(spark, table):
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    table.merge(make([(1, "a", 1, 1)]), rule)
    other = BucketedTable(spark, table.folder, table.schema, table.keys, 16)
    other.version = lambda: 0
    with pytest.raises(Exception, match="(?i)exists"):
        other.merge(make([(1, "a", 9, 9)]), rule)
    assert [tuple(r) for r in table.read().collect()] == [(1, "a", 1, 1)]
