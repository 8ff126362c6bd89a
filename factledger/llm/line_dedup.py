"""Reversible line deduplication.

A line's key is the line without ASCII white space at both ends and with A-Z in
lower case; keys of ``MIN_CHARS`` code points and more count. A :class:`LineIndex`
has two parts, both tables under the shared folder:

* ``refs``: exact reference counts, one row per key, document and change. Inserting
  documents appends their lines as positive counts, deleting them appends the same
  counts negated, so every insertion can be taken back.
* ``filters``: one cuckoo filter per shard of the key space. It holds the keys that
  ``min_docs`` documents share at the moment. Keys that come to be shared are
  inserted, keys that are no longer shared are deleted from it.

Cleaning asks the filters first: the documents' lines are dealt once to their shards'
filters, and only rows that pass go on to the exact counts, which decide. Nearly all
lines of a corpus pass none, and a false positive of a filter never drops a line.
Counts are combined before they are shuffled, and a shard's rows are spread over
several tasks by document, so a line that every document has is in no single task.

Defined results: a null or empty text is one empty line; rows with one id are one
document (null ids too); of a shared key, the document with the largest id keeps
all its lines; a text of any length counts each of its keys once; an empty table cleans to an empty table. Columns other than id and
text pass through; the result adds one column, ``cleaned``, in place of any such column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.common import SPACE, row_bytes, small_batches, stored
from factledger.operators.joins import broadcast_if_small

MIN_CHARS = 40
MIN_DOCS = 5
SHARDS = 256
SPREAD = 16  # tasks that share the rows of a shard
SLOTS = 4
KICKS = 500
STRIP = SPACE.encode()

REFS = "shard int, key binary, doc_id bigint, lines bigint"
FILTERS = "shard int, buckets bigint, cells binary"
KEYS = "array<struct<key: binary, lines: int>>"
CLEANED = "struct<text: string, n_lines: long, n_dropped: long>"


def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key, or None for a key that is too short."""
    key = line.strip(STRIP).lower()
    if len(key) < MIN_CHARS:
        return None
    if len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS:
        return None
    return blake2b(key, digest_size=16).digest()


def _keys(texts: pd.Series) -> pd.Series:
    def held(text: str | None) -> list[dict]:
        counts: dict[bytes, int] = {}
        for line in row_bytes(text).split(b"\n"):
            key = line_key(line)
            if key is not None:
                counts[key] = counts.get(key, 0) + 1
        return [{"key": k, "lines": n} for k, n in counts.items()]

    return texts.map(held)


def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """``text`` is null where nothing is dropped."""
    out = []
    for text, drop in zip(texts, drops, strict=True):
        lines = row_bytes(text).split(b"\n")
        if drop is None or not len(drop):
            out.append((None, len(lines), 0))
            continue
        gone = {bytes(k) for k in drop}
        kept = [line for line in lines if line_key(line) not in gone]
        out.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def references(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The counted lines of documents: one row per document and key."""
    small_batches(docs.sparkSession)
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.pandas_udf(_keys, KEYS)("text")).alias("line"))
    return held.select(
        shard_of(F.col("line.key"), shards).alias("shard"),
        "line.key",
        "doc_id",
        F.col("line.lines").cast("bigint").alias("lines"),
    )


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints, each in one of two buckets of four cells."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        flat = np.zeros(buckets * SLOTS, np.uint16) if cells is None else np.frombuffer(cells, np.uint16).copy()
        self.cells = flat.reshape(buckets, SLOTS)

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        """Room for ``keys`` at a load of at most 0.8."""
        return Cuckoo(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS))))))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of every key; each bucket follows from the other and the fingerprint."""
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), -1)
        mark = (words[:, 0] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (words[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self.turn(mark)

    def turn(self, mark: np.ndarray) -> np.ndarray:
        spread = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (spread & np.uint64(self.buckets - 1)).astype(np.int64)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, a, b = self.places(keys)
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """False when a key found no cell; the filter is then to be built anew, larger."""
        for mark, a, b in zip(*self.places(keys), strict=True) if keys else ():
            at = a if (self.cells[a] == 0).any() else b
            for kick in range(KICKS):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = mark
                    break
                slot = kick % SLOTS
                mark, self.cells[at, slot] = self.cells[at, slot], mark
                at = at ^ int(self.turn(np.asarray([mark], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Take out keys that were inserted before."""
        for mark, a, b in zip(*self.places(keys), strict=True) if keys else ():
            for at in (a, b):
                found = np.flatnonzero(self.cells[at] == mark)
                if len(found):
                    self.cells[at, found[0]] = 0
                    break

    def row(self, shard: int) -> dict:
        return {"shard": shard, "buckets": self.buckets, "cells": self.cells.tobytes()}


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard from all its shared keys."""
    keys, room = [bytes(k) for k in rows["key"]], len(rows)
    while not (held := Cuckoo.sized(room)).insert(keys):
        room *= 2
    return pd.DataFrame([held.row(int(rows["shard"].iloc[0]))])


def _updated(old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard after its changes; no buckets when it overflowed."""
    shard = int((old if len(old) else changes)["shard"].iloc[0])
    gone = [bytes(k) for k in changes["key"][~changes["shared"]]] if len(changes) else []
    come = [bytes(k) for k in changes["key"][changes["shared"]]] if len(changes) else []
    held = Cuckoo(int(old["buckets"].iloc[0]), old["cells"].iloc[0]) if len(old) else Cuckoo.sized(len(come))
    held.delete(gone)
    if not held.insert(come):
        return pd.DataFrame([{"shard": shard, "buckets": 0, "cells": b""}])
    return pd.DataFrame([held.row(shard)])


def _passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose key their shard's filter holds; in every part of a shard the filter's row comes first."""
    place, held = None, None
    for batch in batches:
        for here, rows in batch.groupby(["shard", "part"], sort=False):
            top = rows["key"].isna()
            if top.any():
                place, row = here, rows[top].iloc[0]
                held = Cuckoo(int(row["buckets"]), row["cells"])
            rows = rows[~top]
            if place == here and held is not None and len(rows):
                found = held.holds([bytes(k) for k in rows["key"]])
                if found.any():
                    yield rows.loc[found, ["key", "doc_id"]]


def shared_keys(refs: DataFrame, min_docs: int) -> DataFrame:
    """Exact: keys that ``min_docs`` documents hold, with the largest id among these."""
    held = refs.groupBy("shard", "key", "doc_id").agg(F.sum("lines").alias("lines")).filter("lines > 0")
    counted = held.groupBy("shard", "key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("docs") >= min_docs)


@dataclass(frozen=True)
class LineIndex:
    """Reference counts and filters of the documents inserted so far; every change gives a new index."""

    refs: DataFrame
    shared: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    shards: int = SHARDS
    spread: int = SPREAD

    @staticmethod
    def empty(spark: SparkSession, min_docs: int = MIN_DOCS, shards: int = SHARDS, spread: int = SPREAD) -> LineIndex:
        none = spark.createDataFrame([], REFS)
        return LineIndex(none, shared_keys(none, min_docs), spark.createDataFrame([], FILTERS), min_docs, shards, spread)

    def _changed(self, change: DataFrame) -> LineIndex:
        """Append reference counts; only keys whose counts changed are counted again."""
        refs = self.refs.unionByName(change)
        # written, so that a join with the counts meets two plain shuffles, of which Spark splits a hot key's side
        touched = stored(change.select("key").distinct(), "touched-lines")
        # the change's own keys are all touched; only earlier rows are looked for
        earlier = self.refs.join(touched, "key", "left_semi")
        now = stored(shared_keys(earlier.unionByName(change), self.min_docs), "touched-shared")
        before = self.shared.join(touched, "key", "left_semi")
        shared = stored(self.shared.join(touched, "key", "left_anti").unionByName(now), "shared-lines")
        come = now.join(before, "key", "left_anti").select("shard", "key", F.lit(True).alias("shared"))
        gone = before.join(now, "key", "left_anti").select("shard", "key", F.lit(False).alias("shared"))
        by_shard = self.filters.groupBy("shard").cogroup(come.unionByName(gone).groupBy("shard"))
        updated = stored(by_shard.applyInPandas(_updated, FILTERS), "line-filters")
        full = updated.filter("buckets = 0").select("shard")
        again = shared.select("shard", "key").join(full, "shard", "left_semi").groupBy("shard")
        filters = stored(
            updated.filter("buckets > 0").unionByName(again.applyInPandas(_built, FILTERS)), "line-filters"
        )
        return replace(self, refs=refs, shared=shared, filters=filters)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(stored(references(docs, self.shards), "line-refs"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take all lines of the given documents (doc_id) out of the counts."""
        ids = doc_ids.select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
        held = self.refs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        lines = held.groupBy("shard", "key", "doc_id").agg((-F.sum("lines")).alias("lines")).filter("lines <> 0")
        return self._changed(stored(lines, "line-refs"))

    def passing(self, refs: DataFrame) -> DataFrame:
        """The rows (key, doc_id) of ``refs`` whose key the filters hold, false positives included.

        A shard's rows are dealt to ``spread`` tasks by document and key, each with a copy of the
        shard's filter, so a line that very many documents hold is not in one task.
        """
        part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(self.spread)).cast("int")
        tops = self.filters.select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))).alias("part"),
            F.lit(None).cast("binary").alias("key"),
            F.lit(None).cast("bigint").alias("doc_id"),
            "buckets",
            "cells",
        )
        rows = refs.select(
            "shard", part.alias("part"), "key", "doc_id", F.lit(0).cast("bigint").alias("buckets"), F.lit(None).cast("binary").alias("cells")
        )
        dealt = tops.unionByName(rows).repartition("shard", "part")
        dealt = dealt.sortWithinPartitions("shard", "part", F.col("key").asc_nulls_first())
        return dealt.mapInPandas(_passing, "key binary, doc_id bigint")

    def drops(self, refs: DataFrame) -> DataFrame:
        """Per document of ``refs`` the keys it loses: what passes the filters meets the exact counts."""
        exact = broadcast_if_small(self.shared.select("key", "keeper"))
        lost = self.passing(refs).join(exact, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    def clean(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``docs`` with ``cleaned`` (text, n_lines, n_dropped). ``refs``: the documents' counted lines, if at hand."""
        lost = self.drops(references(docs, self.shards) if refs is None else refs)
        lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("drop").alias("_lost_keys"))
        joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")), "left")
        result = joined.withColumn("_kept", F.pandas_udf(_without, CLEANED)("text", "_lost_keys"))
        cleaned = F.struct(
            F.coalesce("_kept.text", "text", F.lit("")).alias("text"), "_kept.n_lines", "_kept.n_dropped"
        ).alias("cleaned")
        return result.select(*[c for c in docs.columns if c != "cleaned"], cleaned)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> DataFrame:
    """Index all documents, then clean them: ``docs`` with ``cleaned`` (text, n_lines, n_dropped)."""
    index = LineIndex.empty(docs.sparkSession, min_docs, shards).insert(docs)
    return index.clean(docs, index.refs)
