"""Incremental processing with Structured Streaming.

All jobs read a file source, run to the end of what has arrived
(``availableNow``) and keep their progress in a checkpoint under the shared
folder, so a lost executor or a restarted driver continues where it stopped.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.operators.joins import broadcast_if_small
from factledger.operators.merge import not_in
from factledger.operators.ranking import top_rows
from factledger.streaming.ledger import KeyLedger


def arriving(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000, fmt: str = "parquet"
) -> DataFrame:
    """Stream of files; ``files_per_batch`` bounds what one batch takes in."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run a checkpoint belongs to.

    It lives in the checkpoint's folder: a restart finds it again, and a lost
    checkpoint starts a run of another name, whose batches cannot touch what
    earlier runs wrote.
    """
    path = f"{checkpoint}/run_id"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.lit(f"r{uuid.uuid4().hex}").alias("value")).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def run_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, str, int], None]) -> int:
    """Run ``step(batch, run, number)`` for every micro-batch that is available, then stop; gives their number."""
    run = run_id(stream.sparkSession, checkpoint)
    done = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal done
        step(batch, run, number)
        done += 1

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return done


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None while nothing has been written; a table that cannot be read is an error."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def append_batch(df: DataFrame, path: str, run: str, number: int) -> None:
    """Write a batch into its run's own folder; a replayed batch overwrites itself."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")


def other_batches(spark: SparkSession, path: str, run: str, number: int) -> DataFrame | None:
    """Rows of all batches of all runs but this one (a replay must not see itself)."""
    known = read_or_none(spark, path)
    return None if known is None else known.filter(~((F.col("run") == run) & (F.col("batch") == number)))


def unseen(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """``rows`` whose key is not known; the history is scanned for the batch's keys and not shuffled."""
    if known is None:
        return rows
    asked = broadcast_if_small(rows.select(F.col(key).alias("_asked")).distinct())
    seen = known.select(key).join(asked, F.col(key).eqNullSafe(F.col("_asked")), "left_semi").distinct()
    return not_in(rows, seen, [key])


def process_unseen(
    stream: DataFrame,
    key: str,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    processed: str,
    checkpoint: str,
    failed: Column | None = None,
    dead_letters: str | None = None,
    order: Sequence[str] = (),
) -> None:
    """Transform each input once, also over restarts with a new checkpoint.

    Inputs whose key is in the processed table of any run are skipped. Of a key's
    rows in one batch a good one is chosen before a failed one, then by ``order``,
    then by content; the choice is written once and all tables follow from it.
    Rows for which ``failed`` holds go to the dead letters and are not marked, so
    :func:`retry_keys` brings them back. The processed table is written last; what
    a batch without it has left behind is not :func:`committed`. It is a
    :class:`KeyLedger`: a batch opens only the key files that may hold its keys.
    """
    spark = stream.sparkSession
    ledger = KeyLedger(spark, processed, key)

    def step(batch: DataFrame, run: str, number: int) -> None:
        flag = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
        fresh = ledger.unseen(batch, run, number)
        marked = fresh.withColumn("_failed", flag)
        chosen = top_rows(marked, [key], ["_failed", *order, F.xxhash64(*fresh.columns)])
        choices = f"{checkpoint}/choices"
        chosen.write.mode("overwrite").parquet(choices)
        held = spark.read.schema(chosen.schema).parquet(choices)
        done = held.filter(~F.col("_failed")).drop("_failed")
        append_batch(transform(done), out, run, number)
        if dead_letters:
            append_batch(held.filter("_failed").drop("_failed"), dead_letters, run, number)
        ledger.record(done, run, number)

    run_batches(stream, checkpoint, step)


def committed(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of the batches that were finished, without the columns of their place."""
    finished = broadcast_if_small(processed.select("run", "batch").distinct())
    return rows.join(finished, ["run", "batch"], "left_semi").drop("run", "batch")


def retry_keys(dead: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Failed inputs that have not been processed since."""
    return not_in(dead, processed, [key])


def discover(
    stream: DataFrame, key: str, group: str, order: Sequence[str], per_group: int, out: str, found: str, checkpoint: str
) -> None:
    """Queue newly found items once, at most ``per_group`` per group and batch.

    Every item is written to ``found`` when it is first seen. What is found and not
    queued is waiting; older items come first. A call for which nothing new has
    arrived queues from the waiting items, so repeated calls drain them.
    """
    spark = stream.sparkSession

    def queue(run: str, number: int) -> None:
        waiting = waiting_items(spark, found, other_batches(spark, out, run, number), key)
        append_batch(top_rows(waiting, [group], ["_age", *order, key], per_group).drop("_age"), out, run, number)

    def step(batch: DataFrame, run: str, number: int) -> None:
        fresh = unseen(batch.filter(F.col(key).isNotNull()), other_batches(spark, found, run, number), key)
        first = top_rows(fresh, [key], [*order, F.xxhash64(*fresh.columns)])
        append_batch(first.withColumn("_age", F.lit(time.time_ns())), found, run, number)
        queue(run, number)

    if not run_batches(stream, checkpoint, step) and path_exists(spark, found):
        queue(f"r{uuid.uuid4().hex}", 0)


def waiting_items(spark: SparkSession, found: str, queued: DataFrame | None, key: str) -> DataFrame:
    """Items found and not queued yet, with ``_age``, the time they were found."""
    known = spark.read.parquet(found).drop("run", "batch")
    return known if queued is None else not_in(known, queued, [key])


def deduplicated(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Streaming duplicate removal; keys are forgotten ``delay`` after their event time, which bounds the state."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream to Parquet (exactly-once by the sink's log) and stop when caught up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rebuild_processed(outputs: DataFrame, key: str) -> DataFrame:
    """Processed keys recovered from the outputs when the state is lost."""
    return outputs.select(key).filter(F.col(key).isNotNull()).distinct()


def refresh_counts(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> str:
    """Keep running counts: each batch stores its partial counts. Gives the run the partials belong to.

    A batch is aggregated on its own and written to its own folder, so work per
    batch depends on the batch, and a replay replaces its own partial. A run with a
    new checkpoint counts everything anew, so totals are those of one run.
    """

    def step(batch: DataFrame, run: str, number: int) -> None:
        append_batch(partial(batch), out, run, number)

    run_batches(stream, checkpoint, step)
    return run_id(stream.sparkSession, checkpoint)


def running_totals(partials: DataFrame, run: str, keys: Sequence[str], count: str) -> DataFrame:
    """Totals over all partial counts a run has written so far."""
    return partials.filter(F.col("run") == run).groupBy(*keys).agg(F.sum(count).alias(count))
