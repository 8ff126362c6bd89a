"""Idempotent writes: keyed merges, snapshot replacement and append-if-absent.

A merge is one grouping over the union of stored and new rows, so it needs one
shuffle, treats null keys as equal, and combines rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators.contains import containing
from factledger.operators.ranking import top_rows
from factledger.session import small_tasks


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys``."""
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[k])
    return match


def not_in(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``known`` (null equals null)."""
    known = known.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_known_{k}"))
    return df.join(known, match, "left_anti")


def merge_rows(
    stored: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep_first: Sequence[str] = (),
    keep_present: Sequence[str] = (),
) -> DataFrame:
    """Upsert ``new`` into ``stored``.

    The last row by ``order`` gives the columns, except: ``keep_first`` columns
    are taken from the earliest row (never updated once stored), and
    ``keep_present`` columns keep the latest value that is neither null nor "".
    Stored rows always come before new ones. ``order`` columns are only read
    from ``new``.
    """
    small_tasks(stored.sparkSession)
    columns = [c for c in stored.columns]
    old_order = [F.lit(None).cast(new.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)]
    new_order = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    both = stored.select(*columns, F.lit(0).alias("_new"), *old_order).unionByName(
        new.select(*columns, F.lit(1).alias("_new"), *new_order)
    )
    position = F.struct("_new", *[f"_o{i}" for i in range(len(order))])
    special = set(keys) | set(keep_first) | set(keep_present)
    latest = [c for c in columns if c not in special]
    aggs = []
    if latest:
        aggs.append(F.max_by(F.struct(*latest), position).alias("_latest"))
    if keep_first:
        aggs.append(F.min_by(F.struct(*keep_first), position).alias("_first"))
    for c in keep_present:
        present = F.nullif(F.col(c), F.lit("")) if dict(both.dtypes)[c] == "string" else F.col(c)
        held = F.max_by(F.col(c), F.when(present.isNotNull(), position))
        aggs.append(F.coalesce(held, F.max_by(F.col(c), position)).alias(c))
    grouped = both.groupBy(*keys).agg(*aggs)
    parts = [*keys, *keep_present]
    out = grouped.select(
        *parts, *(["_latest.*"] if latest else []), *(["_first.*"] if keep_first else [])
    )
    return out.select(*columns)


def insert_absent(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Stored rows plus the first new row of every key not stored yet.

    Copies of one key are reduced to their first row before the anti-join.
    """
    fresh = not_in(top_rows(new, keys, order), stored, keys)
    return stored.unionByName(fresh.select(*stored.columns))


def replace_groups(stored: DataFrame, new: DataFrame, keys: Sequence[str], refreshed: DataFrame) -> DataFrame:
    """Replace the rows of every refreshed group by the new snapshot.

    A group fetched successfully with no rows is emptied; a group whose fetch
    failed is not in ``refreshed`` and keeps its rows.
    """
    kept = not_in(stored, refreshed, keys)
    current = new.join(refreshed.select(*keys).distinct(), list(keys), "left_semi")
    return kept.unionByName(current.select(*stored.columns))


def replace_tagged(
    stored: DataFrame,
    new: DataFrame,
    tag: str,
    within: Sequence[str] = (),
    scope: DataFrame | None = None,
) -> DataFrame:
    """Drop the rows an earlier run tagged, then append this run's rows.

    With ``within`` only the tagged rows whose ``within`` values occur in
    ``scope`` (this run's rows unless given) are dropped.
    """
    tagged = F.coalesce(F.col(tag), F.lit(False))
    if within:
        touched = (new if scope is None else scope).select(*within).distinct()
        kept = stored.filter(~tagged).unionByName(not_in(stored.filter(tagged), touched, within))
    else:
        kept = stored.filter(~tagged)
    return kept.unionByName(new, allowMissingColumns=True)


def append_unnamed(roster: DataFrame, figures: DataFrame, name: str = "name") -> DataFrame:
    """Append figures whose name is not contained in any roster name."""
    named = figures.filter(F.col(name) != "")
    present = containing(roster, name, named, name).select(F.col("word").alias(name)).distinct()
    return roster.unionByName(not_in(figures, present, [name]), allowMissingColumns=True)


def union_keys(*frames: DataFrame) -> DataFrame:
    """Distinct union of key sets (processed lists, blocklists)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def union_first(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of several result lists; the earliest list (and row) wins per key.

    Every frame carries ``pos``, its own row order. Rows without a key are dropped.
    """
    tagged = [f.withColumn("_list", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for frame in tagged[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    present = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return top_rows(out.filter(present), [key], ["_list", "pos"]).withColumnRenamed("_list", "query_no")


def with_entry(ids: Column, key: str, value: Column) -> Column:
    """Set one key of an id map and keep the rest; a null value changes nothing."""
    base = F.coalesce(ids, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, _: k != F.lit(key))
    return F.when(value.isNull(), base).otherwise(
        F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))
    )
