"""Incremental jobs over several arrivals equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from factledger.streaming import jobs

SCHEMA = "video_id string, person_id bigint, pos int, ok boolean"


def land(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_unseen_and_retry(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")

    def run():
        jobs.process_unseen(
            jobs.arriving(spark, str(src), SCHEMA, files_per_batch=1),
            "video_id",
            lambda df: df.select("video_id", "pos"),
            f"{base}/out",
            f"{base}/done",
            f"{base}/cp",
            failed=~F.col("ok"),
            dead_letters=f"{base}/dead",
        )

    land(spark, src, "1", [("a", 1, 0, True), ("b", 1, 1, False)])
    run()
    land(spark, src, "2", [("a", 1, 2, True), ("c", 1, 3, True), ("b", 1, 4, False)])
    run()
    out = spark.read.parquet(f"{base}/out")
    assert rows(out, "video_id", "pos") == [("a", 0), ("c", 3)]
    dead, done = spark.read.parquet(f"{base}/dead"), spark.read.parquet(f"{base}/done")
    assert rows(jobs.retry_keys(dead, done, "video_id").select("video_id").distinct()) == [("b",)]
    land(spark, src, "3", [("b", 1, 5, True)])
    run()
    assert rows(spark.read.parquet(f"{base}/out"), "video_id") == [("a",), ("b",), ("c",)]
    done = spark.read.parquet(f"{base}/done")
    assert jobs.retry_keys(dead, done, "video_id").count() == 0
    assert rows(jobs.rebuild_processed(spark.read.parquet(f"{base}/out"), "video_id")) == [("a",), ("b",), ("c",)]


def test_discover_caps_per_batch_and_loses_nothing(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")

    def run():
        jobs.discover(
            jobs.arriving(spark, str(src), SCHEMA), "video_id", "person_id", ["pos"], 2, f"{base}/q", f"{base}/w", f"{base}/cp"
        )
        return rows(spark.read.parquet(f"{base}/q"), "video_id")

    land(spark, src, "1", [(f"v{i}", 1, i, True) for i in range(5)] + [("v0", 1, 9, True), (None, 1, 0, True), ("x", 2, 0, True)])
    assert run() == [("v0",), ("v1",), ("x",)]
    land(spark, src, "2", [("v0", 1, 0, True), ("new", 1, -1, True)])
    assert run() == [("v0",), ("v1",), ("v2",), ("v3",), ("x",)]  # waiting ones come first
    land(spark, src, "3", [("y", 2, 0, True)])
    every = sorted([("v0",), ("v1",), ("v2",), ("v3",), ("v4",), ("x",), ("new",), ("y",)], key=repr)
    assert run() == every
    assert run() == every
    assert jobs.waiting_items(spark, f"{base}/w", spark.read.parquet(f"{base}/q"), "video_id").count() == 0


def test_waiting_items_drain_without_new_files(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")
    land(spark, src, "1", [(f"v{i}", 1, i, True) for i in range(5)])
    queued = []
    for _ in range(4):
        jobs.discover(
            jobs.arriving(spark, str(src), SCHEMA), "video_id", "person_id", ["pos"], 2, f"{base}/q", f"{base}/w", f"{base}/cp"
        )
        queued.append(spark.read.parquet(f"{base}/q").count())
    assert queued == [2, 4, 5, 5]


def test_a_lost_checkpoint_loses_and_repeats_nothing(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")

    def run(checkpoint):
        jobs.process_unseen(
            jobs.arriving(spark, str(src), SCHEMA, files_per_batch=1),
            "video_id",
            lambda df: df.select("video_id", "pos"),
            f"{base}/out",
            f"{base}/done",
            f"{base}/{checkpoint}",
        )
        done = spark.read.parquet(f"{base}/done")
        return rows(jobs.committed(spark.read.parquet(f"{base}/out"), done), "video_id")

    land(spark, src, "1", [("a", 1, 0, True), ("b", 1, 1, True)])
    assert run("cp1") == [("a",), ("b",)]
    land(spark, src, "2", [("b", 1, 2, True), ("c", 1, 3, True)])
    assert run("cp2") == [("a",), ("b",), ("c",)]


def test_a_good_copy_is_chosen_before_a_failed_one(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")
    land(spark, src, "1", [("a", 1, 0, False), ("a", 1, 1, True), ("b", 1, 0, False), ("b", 1, 1, False)])
    jobs.process_unseen(
        jobs.arriving(spark, str(src), SCHEMA),
        "video_id",
        lambda df: df.select("video_id", "pos"),
        f"{base}/out",
        f"{base}/done",
        f"{base}/cp",
        failed=~F.col("ok"),
        dead_letters=f"{base}/dead",
        order=["pos"],
    )
    assert rows(spark.read.parquet(f"{base}/out"), "video_id", "pos") == [("a", 1)]
    assert rows(spark.read.parquet(f"{base}/dead"), "video_id", "pos") == [("b", 0)]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(3)
    jobs.append_batch(df, out, "ra", 0)
    jobs.append_batch(df, out, "ra", 0)
    jobs.append_batch(df, out, "ra", 1)
    jobs.append_batch(df, out, "rb", 1)
    assert spark.read.parquet(out).count() == 9
    assert jobs.other_batches(spark, out, "ra", 1).count() == 6
    assert jobs.other_batches(spark, str(tmp_path / "none"), "ra", 1) is None


def test_a_broken_table_is_an_error(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        jobs.read_or_none(spark, str(tmp_path)).count()


def test_running_counts(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")

    def partial(df):
        return df.groupBy("person_id").agg(F.count("*").alias("n"))

    for data in ([("a", 1, 0, True), ("b", 2, 0, True)], [("c", 1, 0, True)]):
        land(spark, src, "x", data)
        run = jobs.refresh_counts(jobs.arriving(spark, str(src), SCHEMA), partial, f"{base}/p", f"{base}/cp")
    totals = jobs.running_totals(spark.read.parquet(f"{base}/p"), run, ["person_id"], "n")
    assert rows(totals) == [(1, 2), (2, 1)]
    run = jobs.refresh_counts(jobs.arriving(spark, str(src), SCHEMA), partial, f"{base}/p", f"{base}/cp2")
    assert rows(jobs.running_totals(spark.read.parquet(f"{base}/p"), run, ["person_id"], "n")) == [(1, 2), (2, 1)]


def test_streaming_dedup(spark, tmp_path, rows):
    src, base = tmp_path / "in", str(tmp_path / "state")
    for data in ([("a", 1, 0, True), ("a", 1, 1, True)], [("a", 1, 2, True), ("b", 1, 3, True)]):
        land(spark, src, "x", data)
        seen_at = F.timestamp_seconds(F.col("pos")).alias("seen_at")
        stream = jobs.arriving(spark, str(src), SCHEMA).select("video_id", seen_at)
        jobs.write_stream(jobs.deduplicated(stream, "video_id", "seen_at"), f"{base}/out", f"{base}/cp")
    assert rows(spark.read.parquet(f"{base}/out"), "video_id") == [("a",), ("b",)]


def test_dedup_reaches_back_over_all_events(spark, tmp_path, monkeypatch):
    """A key that comes back after 50 years, in a later batch, is still known."""
    from factledger.bindings import Views
    from factledger.queries import incremental

    path = str(tmp_path / "events.parquet")
    stamps = ["TIMESTAMP'2020-01-01'", "TIMESTAMP'2021-01-01'", "TIMESTAMP'1970-01-01'", "TIMESTAMP'2020-06-01'"]
    users = [1, 2, 3, 1]
    for i, (ts, user) in enumerate(zip(stamps, users, strict=True)):
        row = spark.sql(f"SELECT {i}L AS event_id, {user}L AS user_id, 'a' AS event_type, {ts} AS ts, 1.0D AS value")
        row.coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(incremental.jobs, "arriving", lambda s, p, c, *a: s.readStream.schema(c).option("maxFilesPerTrigger", 1).parquet(p))
    got = sorted(r["item"] for r in incremental.stream_dedup(Views(spark, str(tmp_path))).collect())
    assert got == ["1/a", "2/a", "3/a"]
