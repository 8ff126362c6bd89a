"""Incremental jobs run to the end of a table's files; results equal the batch query."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from factledger.queries import register
from factledger.session import cut_lineage, new_folder
from factledger.streaming import jobs


def _events(v):
    schema = v.table("events").schema
    return jobs.arriving(v.spark, f"{v.dir}/events.parquet*", schema)  # a pattern, so a file and a folder both work


@register(
    "stream_unseen",
    "",
    "SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'error'",
)
def stream_unseen(v):
    """Each input transformed once over two runs; failed ones go to the dead letters."""
    base = new_folder(v.spark, "unseen")

    def shape(df):
        return df.select("event_id", F.upper("event_type").alias("kind"))

    for run in (1, 2):
        jobs.process_unseen(
            _events(v),
            "event_id",
            shape,
            f"{base}/out{run}",
            f"{base}/processed",
            f"{base}/checkpoint",
            failed=F.col("event_type") == "error",
            dead_letters=f"{base}/dead",
        )
    return v.spark.read.parquet(f"{base}/out1").select("event_id", "kind")


@register("stream_retry", "", "SELECT event_id FROM events WHERE event_type = 'error'")
def stream_retry(v):
    """Inputs to retry: dead letters that were not processed since."""
    base = new_folder(v.spark, "retry")
    jobs.process_unseen(
        _events(v),
        "event_id",
        lambda df: df.select("event_id"),
        f"{base}/out",
        f"{base}/processed",
        f"{base}/checkpoint",
        failed=F.col("event_type") == "error",
        dead_letters=f"{base}/dead",
    )
    dead, done = v.spark.read.parquet(f"{base}/dead"), v.spark.read.parquet(f"{base}/processed")
    return jobs.retry_keys(dead, done, "event_id").select("event_id")


@register(
    "stream_restart",
    "",
    """SELECT event_id, upper(event_type) AS kind, 1 AS input FROM events WHERE event_type <> 'error'
    UNION ALL SELECT -event_id - 1, upper(event_type), 2 FROM events WHERE event_type <> 'error'""",
)
def stream_restart(v):
    """A lost checkpoint: the next run meets old and new inputs; nothing is lost and nothing done twice."""
    base = new_folder(v.spark, "restart")
    events = v.table("events")

    def shape(df):
        return df.select("event_id", F.upper("event_type").alias("kind"), "input")

    old = events.withColumn("input", F.lit(1))
    new = old.unionByName(events.withColumns({"event_id": -F.col("event_id") - 1, "input": F.lit(2)}))
    for run, rows in enumerate((old, new)):
        rows.write.parquet(f"{base}/in{run}")
        jobs.process_unseen(
            jobs.arriving(v.spark, f"{base}/in{run}", rows.schema),
            "event_id",
            shape,
            f"{base}/out",
            f"{base}/processed",
            f"{base}/checkpoint{run}",
            failed=F.col("event_type") == "error",
            dead_letters=f"{base}/dead",
        )
    return jobs.committed(v.spark.read.parquet(f"{base}/out"), v.spark.read.parquet(f"{base}/processed"))


@register(
    "stream_discover",
    "",
    """WITH first AS (SELECT user_id, user_id || '/' || event_type AS item, min(event_id) AS event_id FROM events GROUP BY ALL)
    SELECT user_id, item, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1) // 2 AS round FROM first""",
)
def stream_discover(v):
    """New items queued once, two per user and batch; later calls drain what waits."""
    base = new_folder(v.spark, "discover")
    item = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("item")
    done = None
    for number in itertools.count(1):
        found = _events(v).select("user_id", item, "event_id")
        jobs.discover(found, "item", "user_id", ["event_id"], 2, f"{base}/queue", f"{base}/found", f"{base}/checkpoint")
        queue = v.spark.read.parquet(f"{base}/queue")
        new = queue.select("user_id", "item", "event_id") if done is None else queue.join(done, "item", "left_anti")
        new = new.select("user_id", "item", "event_id", F.lit(number).cast("bigint").alias("round"))
        new = cut_lineage(new)
        done = new if done is None else done.unionByName(new)
        if jobs.waiting_items(v.spark, f"{base}/found", queue, "item").isEmpty():
            return done


@register("stream_dedup", "", "SELECT DISTINCT user_id || '/' || event_type AS item FROM events")
def stream_dedup(v):
    """Streaming duplicate removal into a Parquet sink; the state reaches back over the table's whole time."""
    base = new_folder(v.spark, "dedup")
    item = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("item")
    ts, day = F.unix_seconds(F.col("ts").cast("timestamp")), 86_400
    first, last = v.table("events").agg(F.min(ts), F.max(ts)).first()
    first, last = first or 0, last or 0
    # a watermark starts in 1970: time is counted from the table's first event, so that older ones are not late
    items = _events(v).select(item, F.timestamp_seconds(F.coalesce(ts, F.lit(first)) - F.lit(first) + day).alias("ts"))
    jobs.write_stream(jobs.deduplicated(items, "item", "ts", f"{last - first + day} seconds"), f"{base}/out", f"{base}/checkpoint")
    return v.spark.read.schema("item string").parquet(f"{base}/out")


@register("stream_recover", "", "SELECT DISTINCT user_id FROM events")
def stream_recover(v):
    """Processed keys rebuilt from a sink's output."""
    base = new_folder(v.spark, "recover")
    jobs.write_stream(_events(v).select("user_id", "value"), f"{base}/out", f"{base}/checkpoint")
    return jobs.rebuild_processed(v.spark.read.schema("user_id bigint, value double").parquet(f"{base}/out"), "user_id")


@register("stream_counts", "", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(v):
    """Running counts refreshed per batch."""
    base = new_folder(v.spark, "counts")
    keys = ["user_id", "event_type"]

    def partial(df):
        return df.groupBy(*keys).agg(F.count("*").alias("n"))

    run = jobs.refresh_counts(_events(v), partial, f"{base}/partials", f"{base}/checkpoint")
    return jobs.running_totals(v.spark.read.parquet(f"{base}/partials"), run, keys, "n")
