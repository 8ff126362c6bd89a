"""Mixing sources to target weights by hash thresholds.

Every row has a 60-bit hash of its id and text. The words of a source are summed
by hash bucket (12 bits), the bucket in which the running sum crosses the
source's budget is found, and only that bucket is summed again by the next 12
bits, until the threshold is known to the last bit. Rows below the threshold are
taken, the ones at it when that comes closer to the budget. Budgets nest: a larger
target takes a superset. Nothing is sorted; the only state is one row per source.

A target of ``k + f`` times a source's size takes all rows ``k`` times and the
rows below the threshold of ``f`` once more.

Defined results: a null text has size 0; null sources are one source, the last
one; rows that repeat id and text share a hash and are taken together; sources of
size 0 have target 0; an empty table gives no rows. Columns other than those
named are kept as they are or not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import WORD, stored, whole
from factledger.operators.joins import broadcast_if_small
from factledger.operators.ranking import numbered

BITS = 12
LEVELS = 5


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on the row alone."""
    digest = F.md5(F.concat_ws("#", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(whole(text))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"))


def targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target per source: its weight's part of ``share`` times all words, at most ``most`` times its size.

    Weights go round the sources by code point, null last. What a source cannot
    take raises the level (target per unit of weight) of the others until none
    is above its limit: each round is one aggregate over the sources, of which
    the driver sees two numbers.
    """
    placed = numbered(totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"], name="_place", start=0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    held = stored(
        placed.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size")).drop("_last"), "sources"
    )
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("_weight") * F.lit(level) > F.col("_cap")
        caps, free = held.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not free or (share * total - (caps or 0)) / free <= level:
            break
        level = (share * total - (caps or 0)) / free
    target = F.least(F.col("_weight") * F.lit(level), F.col("_cap").cast("double"))
    return held.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash at which its budget ends: source, ``bound`` and ``at_bound``.

    ``rows`` has source, size and hash, ``budgets`` source and budget (above 0 and
    at most the source's size). Hashes below ``bound`` are taken, ``bound`` itself
    when ``at_bound``.
    """
    state = budgets.select(F.col("source").alias("_of"), "budget", F.lit(0).cast("bigint").alias("bound"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        same = F.col("source").eqNullSafe(F.col("_of")) & (F.shiftright("hash", shift + BITS) == F.col("bound"))
        cells = (
            rows.join(broadcast_if_small(state), same)
            .groupBy("_of", "budget", F.shiftright("hash", shift).alias("cell"))
            .agg(F.sum("size").alias("words"))
        )
        upto = Window.partitionBy("_of").orderBy("cell")
        crossing = cells.withColumn("end", F.sum("words").over(upto)).filter("end >= budget")
        first = crossing.withColumn("no", F.row_number().over(upto)).filter("no = 1")
        left = F.col("budget") - (F.col("end") - F.col("words"))
        state = stored(
            first.select("_of", left.alias("budget"), F.col("cell").alias("bound"), "words"), "thresholds"
        )
    return state.select(F.col("_of").alias("source"), "bound", (2 * F.col("budget") >= F.col("words")).alias("at_bound"))


def mixing_plan(
    rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row per source of ``rows`` (source, size, hash): its size, target, whole copies and threshold."""
    wanted = targets(source_totals(rows), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    held = stored(wanted.withColumn("copies", copies.cast("bigint")), "targets")
    budgets = held.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    bounds = thresholds(rows, budgets.filter("budget > 0")).withColumnRenamed("source", "_of")
    plan = held.join(bounds, F.col("source").eqNullSafe(F.col("_of")), "left")
    return stored(plan.select(*held.columns, "bound", "at_bound"), "mixing-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source and hash) joined with their source's plan; ``_copies`` is how often each is taken."""
    plan = plan.withColumnRenamed("source", "_of")
    below = F.coalesce((F.col("hash") < F.col("bound")) | ((F.col("hash") == F.col("bound")) & F.col("at_bound")), F.lit(False))
    joined = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_of")))
    return joined.withColumn("_copies", (F.col("copies") + below.cast("bigint")).cast("int"))


def measured(docs: DataFrame) -> DataFrame:
    """Slim rows of documents: id, source, size and hash."""
    slim = docs.select("doc_id", "source", word_count("text").alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    return stored(slim, "sizes")


def mix_sizes(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words taken, repeats counted."""
    rows = measured(docs)
    out = with_copies(rows, mixing_plan(rows, weights, share, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents of the mix, with their columns; a document taken twice is there twice."""
    plan = mixing_plan(measured(docs), weights, share, most)
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), "source", row_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    taken = with_copies(keyed, plan).filter("_copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
