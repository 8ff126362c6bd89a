"""A stored table in hash buckets of its key, changed by copy-on-write.

Rows lie in ``data/<write>/bucket=B``, one write per merge; a manifest per version says
which write holds each bucket. A merge reads and rewrites only the buckets that the new
rows' keys fall into, and publishes a new manifest; files are never changed, so readers
of an older version go on undisturbed, and a merge that is cut off leaves the last
published version as it was. Equal keys, null parts included, fall into one bucket.

The driver sees bucket numbers only, ``buckets`` of them at most. One writer at a time
is assumed; of two that publish the same version, the second fails and changes nothing,
since every write has a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.session import cut_lineage
from factledger.streaming.jobs import path_exists

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """``rule(stored, new)`` of :meth:`merge` gives the rows that take the place of ``stored``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, list(keys), buckets

    def _bucket(self) -> Column:
        # nulls are skipped by the hash, so a marker keeps (null, x) and (x, null) apart
        marks = [F.col(k).isNull() for k in self.keys]
        return F.pmod(F.xxhash64(*self.keys, *marks), F.lit(self.buckets)).cast("int")

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest/version={version}"

    def version(self) -> int:
        """The newest published version; 0 for a table without rows or merges."""
        newest = 0
        while path_exists(self.spark, f"{self._manifest(newest + 1)}/_SUCCESS"):
            newest += 1
        return newest

    def bucket_writes(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> the write that holds it; a write's name starts with the version it was made for."""
        at = self.version() if version is None else version
        if at == 0:
            return {}
        rows = self.spark.read.schema("bucket int, written string").parquet(self._manifest(at)).collect()
        return {r["bucket"]: r["written"] for r in rows}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless given; with ``buckets`` only theirs."""
        held = self.bucket_writes(version)
        wanted = sorted(b for b in held if buckets is None or b in set(buckets))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/{held[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows_of(self, key: dict[str, object]) -> DataFrame:
        """The rows of one key, read from its bucket alone."""
        probe = self.spark.range(1).select(*[F.lit(key[k]).cast(self.schema[k].dataType).alias(k) for k in self.keys])
        bucket = probe.select(self._bucket().alias("b")).first()["b"]
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.lit(key[k]))
        return self.read(buckets=[bucket]).filter(same)

    def merge(self, new: DataFrame, rule: Rule) -> int:
        """Apply ``rule`` to the touched buckets and publish the next version; gives its number."""
        at = self.version()
        staged = cut_lineage(new)
        touched = [r["bucket"] for r in staged.select(self._bucket().alias("bucket")).distinct().collect()]
        if not touched:
            return at
        held = self.bucket_writes(at)
        merged = rule(self.read(at, touched), staged).select(*self.schema.fieldNames())
        write = f"{at + 1}-{uuid.uuid4().hex}"
        target = f"{self.folder}/data/{write}"
        dealt = merged.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket")
        dealt.write.partitionBy("bucket").parquet(target)
        written = {b: write for b in touched if path_exists(self.spark, f"{target}/bucket={b}")}
        rows = [(b, v) for b, v in sorted({**{b: v for b, v in held.items() if b not in touched}, **written}.items())]
        self.spark.createDataFrame(rows, "bucket int, written string").coalesce(1).write.mode("error").parquet(self._manifest(at + 1))
        return at + 1
