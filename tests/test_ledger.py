"""The key ledger: exact answers, few files opened, replays and cut-off batches."""

import shutil

from factledger.streaming.ledger import KeyLedger


def keys(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"k {kind}")


def test_few_files_are_opened_over_many_batches(spark, tmp_path, rows):
    ledger = KeyLedger(spark, str(tmp_path / "done"), "k", buckets=4)
    for n in range(50):
        ledger.record(keys(spark, range(n * 40, n * 40 + 40)).coalesce(1), "r1", n)
    batch = keys(spark, [5, 6, 1999, 5000, 5001, 5002])
    opened = ledger.places(batch, "r2", 0)
    # 200 files hold 2,000 keys; three known keys lie in at most three of them, and false alarms are rare
    assert 1 <= len(opened) <= 8
    assert rows(ledger.unseen(batch, "r2", 0)) == [(5000,), (5001,), (5002,)]
    assert len(ledger.places(keys(spark, [9000]), "r2", 0)) <= 4


def test_replays_nulls_and_texts(spark, tmp_path, rows):
    ledger = KeyLedger(spark, str(tmp_path / "done"), "k")
    first = keys(spark, ["a", None, "", "a"], "string")
    assert rows(ledger.unseen(first, "r", 0)) == rows(first)
    ledger.record(first, "r", 0)
    # a replay does not see itself, and leaves what it writes again
    assert rows(ledger.unseen(first, "r", 0)) == rows(first)
    ledger.record(first, "r", 0)
    assert rows(ledger.unseen(keys(spark, ["a", None, "", "b"], "string"), "r", 1)) == [("b",)]
    ledger.record(first.limit(0), "r", 1)
    assert rows(ledger.unseen(keys(spark, ["c", None], "string"), "r", 2)) == [("c",)]


def test_a_cut_off_batch_counts_as_not_processed(spark, tmp_path, rows):
    ledger = KeyLedger(spark, str(tmp_path / "done"), "k")
    ledger.record(keys(spark, [1, 2]), "r", 0)
    ledger.record(keys(spark, [3]), "r", 1)
    shutil.rmtree(tmp_path / "done" / "run=r" / "batch=1")
    assert rows(ledger.unseen(keys(spark, [1, 3, 4]), "r", 2)) == [(3,), (4,)]
