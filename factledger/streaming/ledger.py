"""A ledger of processed keys that a batch can ask without scanning all history.

Keys lie in hash buckets per batch (``run=/batch=/bucket=``). Next to the keys of each
(batch, bucket) stands a small filter: BITS bits a key with PROBES of them set. A batch
reads the filters of its own buckets, which are a few bytes per key, and opens only the
key files whose filter lets one of its keys pass; those are compared exactly, so a
filter's false alarm costs a read and changes nothing. Filters are written before keys,
and the keys last, so a batch that was cut off has no keys: it counts as not processed.

Every task handles the filters of one bucket; the driver sees the places of the key
files to open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators.joins import broadcast_if_small
from factledger.operators.merge import not_in

BITS, PROBES = 16, 4
PLACES = "run string, batch int, bucket int"
FILTERS = "bucket int, size bigint, marks binary"


def _probes(key: Column) -> Column:
    """PROBES hashes of a key; a null key is a key like any other."""
    return F.array(*[F.xxhash64(key, key.isNull(), F.lit(i)) for i in range(PROBES)])


def _hit(marks: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    at = (hashes.view(np.uint64) % np.uint64(size)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter_of(rows: pd.DataFrame) -> pd.DataFrame:
    hashes = np.stack(rows["probes"].to_numpy())
    size = max(64, -(-BITS * len(hashes) // 8) * 8)
    marks = np.zeros(size, bool)
    marks[(hashes.view(np.uint64) % np.uint64(size)).astype(np.int64)] = True
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "size": [size], "marks": [np.packbits(marks, bitorder="little").tobytes()]})


def _passing(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Places whose filter lets one of the asked keys of the bucket pass."""
    out = []
    if len(asked):
        hashes = np.stack(asked["probes"].to_numpy())
        for place in filters.itertuples():
            if _hit(np.frombuffer(place.marks, np.uint8), hashes, place.size).all(axis=1).any():
                out.append((place.run, place.batch, place.bucket))
    return pd.DataFrame(out, columns=["run", "batch", "bucket"])


class KeyLedger:
    """Keys under ``path``, filters under ``path`` + ``_filters``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.filters = f"{path}_filters"

    def _dealt(self, rows: DataFrame) -> DataFrame:
        key = F.col(self.key)
        return rows.withColumn("bucket", F.pmod(F.xxhash64(key, key.isNull()), F.lit(self.buckets)).cast("int"))

    def record(self, keys: DataFrame, run: str, number: int) -> None:
        """Add a batch's keys; a replayed batch overwrites itself."""
        place = f"run={run}/batch={number}"
        dealt = self._dealt(keys.select(self.key).distinct())
        filters = dealt.select("bucket", _probes(F.col(self.key)).alias("probes")).groupBy("bucket").applyInPandas(_filter_of, FILTERS)
        filters.repartitionByRange("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.filters}/{place}")
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{place}")

    def places(self, rows: DataFrame, run: str | None = None, number: int | None = None) -> list[tuple[str, int, int]]:
        """(run, batch, bucket) of the key files that may hold keys of ``rows``, but for those of the named batch."""
        from factledger.streaming.jobs import path_exists

        if not path_exists(self.spark, self.filters):
            return []
        asked = self._dealt(rows.select(self.key).distinct()).select("bucket", _probes(F.col(self.key)).alias("probes"))
        schema = "size bigint, marks binary, run string, batch int, bucket int"
        held = self.spark.read.schema(schema).parquet(self.filters)
        if run is not None:
            held = held.filter(~((F.col("run") == run) & (F.col("batch") == number)))
        met = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(_passing, PLACES)
        found = [(r["run"], r["batch"], r["bucket"]) for r in met.collect()]
        # filters without keys belong to a batch that was cut off
        return [p for p in found if path_exists(self.spark, f"{self._batch(p)}/_SUCCESS")]

    def _batch(self, place: tuple[str, int, int]) -> str:
        return f"{self.path}/run={place[0]}/batch={place[1]}"

    def unseen(self, rows: DataFrame, run: str, number: int) -> DataFrame:
        """``rows`` whose key no other batch has recorded."""
        opened = [f"{self._batch(p)}/bucket={p[2]}" for p in self.places(rows, run, number)]
        if not opened:
            return rows
        known = self.spark.read.schema(rows.select(self.key).schema).parquet(*opened)
        asked = broadcast_if_small(rows.select(F.col(self.key).alias("_asked")).distinct())
        seen = known.join(asked, F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi").distinct()
        return not_in(rows, seen, [self.key])
