"""Substring search through a stored posting table of character grams.

``write_postings`` stores the texts in hash blocks, and one row per block and distinct
gram of two and three characters with the numbers of the block's texts that hold it (a
large block has a few such rows), in hash buckets of the gram, sorted, next to a table
of the grams' counts. The lists are made where a block's texts are read, so texts and
lists are shuffled, never one row per text and gram. A search reads the counts of its own grams, opens the buckets of
the rarest few, keeps the texts that hold all of these, and reads only their blocks; the
texts are then checked for the whole substring, so the result is that of a full scan. A
gram that most texts hold is spread over many files, and is only read when nothing
rarer is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.operators.joins import broadcast_if_small
from factledger.session import new_folder

SIZES = (2, 3)
SCHEMAS = {"postings": "block int, gram string, texts array<int>, bucket int", "counts": "gram string, texts bigint, bucket int"}
LISTS = "block int, gram string, texts array<int>"
#: Characters whose grams are held at once.
SLICE_CHARS = 1 << 20
#: Blocks whose lists of a bucket share a file.
FILE_BLOCKS = 1024
#: A character takes 21 bits of a gram's number, plus one so that none is 0.
BITS = 21


def gram_bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def _numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of two and three characters as numbers, each with the place of its text, in the texts' order per size."""
    lengths = [len(t) for t in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    of = np.repeat(np.arange(len(texts)), lengths)
    pairs = chars[:-1] | chars[1:] << BITS
    triples = pairs[:-1] | chars[2:] << (2 * BITS)
    two, three = of[:-1] == of[1:], of[:-2] == of[2:]
    return np.concatenate([pairs[two], triples[three]]), np.concatenate([of[:-1][two], of[:-2][three]])


def distinct_grams(texts: list[str], size: int = SLICE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct grams, sorted by gram and text; one text longer than ``size`` is gone through in pieces."""
    if len(texts) == 1 and len(texts[0]) > size:
        pieces = [texts[0][at : at + size + max(SIZES) - 1] for at in range(0, len(texts[0]), size)]
        found = np.unique(np.concatenate([np.unique(_numbers([p])[0]) for p in pieces]))
        return found, np.zeros(len(found), dtype=np.int64)
    found, of = _numbers(texts)
    order = np.argsort(found, kind="stable")
    found, of = found[order], of[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def gram_texts(found: np.ndarray) -> list[str]:
    """The characters of sorted gram numbers."""
    mask = (1 << BITS) - 1
    two = found[found >> (2 * BITS) == 0]
    three = found[found >> (2 * BITS) != 0]

    def spelt(numbers: np.ndarray, size: int) -> list[str]:
        chars = np.stack([(numbers >> (BITS * i) & mask) - 1 for i in range(size)], axis=1)
        text = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + size] for i in range(0, len(text), size)]

    # three characters have the greater numbers
    return spelt(two, 2) + spelt(three, 3)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and gram the numbers of the texts with it, for about ``SLICE_CHARS`` characters of texts at a time."""
    for batch in batches:
        held = batch.to_pandas().dropna(subset=["text"])
        at = held["text"].str.len().cumsum() // SLICE_CHARS
        for (block, _), some in held.groupby(["block", at]):
            texts, numbers = some["text"].tolist(), some["text_no"].to_numpy()
            # a long text by itself
            long = [i for i, t in enumerate(texts) if len(t) > SLICE_CHARS]
            short = [i for i, t in enumerate(texts) if len(t) <= SLICE_CHARS]
            for group in [short, *[[i] for i in long]]:
                found, of = distinct_grams([texts[i] for i in group]) if group else ([], [])
                if not len(found):
                    continue
                starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                listed = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(found)), pa.int32()), pa.array(numbers[np.array(group)[of]], pa.int32())
                )
                gram = pa.array(gram_texts(found[starts]), pa.string())
                names = ["block", "gram", "texts"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block), pa.int32()), gram, listed], names)


def query_grams(query: str) -> list[str]:
    """The grams that every text with the query holds: its triples, or the query itself when it has two characters."""
    size = min(max(SIZES), len(query))
    if size < min(SIZES):
        return []
    return sorted({query[i : i + size] for i in range(len(query) - size + 1)})


@dataclass(frozen=True)
class Postings:
    spark: SparkSession
    folder: str
    buckets: int
    texts: StructType

    def table(self, name: str) -> DataFrame:
        schema = self.texts if name == "texts" else SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def write_postings(texts: DataFrame, text: str = "text", buckets: int = 64, folder: str | None = None) -> Postings:
    """Store ``texts`` with their postings; ``buckets`` grows with the table so that one stays a few files."""
    spark = texts.sparkSession
    numbered = texts.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    # a block lies in one partition, and a text's number is its place there
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")
    numbered = numbered.repartition("block").sortWithinPartitions("block").withColumn("text_no", place)
    index = Postings(spark, folder or new_folder(spark, "postings"), buckets, numbered.schema)
    numbered.write.partitionBy("block").parquet(f"{index.folder}/texts")
    # from the stored texts, so that numbers and postings cannot part
    rows = index.table("texts").select("block", "text_no", F.col(text).alias("text")).mapInArrow(_lists, LISTS)
    rows = rows.withColumn("bucket", gram_bucket(F.col("gram"), buckets))
    # lists of a common gram lie in several files
    spread = rows.repartition("bucket", F.floor(F.col("block") / FILE_BLOCKS)).sortWithinPartitions("bucket", "gram", "block")
    spread.write.partitionBy("bucket").parquet(f"{index.folder}/postings")
    counts = index.table("postings").groupBy("bucket", "gram").agg(F.sum(F.size("texts")).alias("texts"))
    counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{index.folder}/counts")
    return index


def _of(index: Postings, name: str, asked: list[str]) -> DataFrame:
    """The rows of some grams: the partitions of their buckets, and the grams pushed to the files."""
    opened = sorted({zlib.crc32(g.encode()) % index.buckets for g in asked})
    return index.table(name).filter(F.col("bucket").isin(opened) & F.col("gram").isin(asked))


def candidates(index: Postings, query: str, rarest: int = 3) -> DataFrame:
    """The stored texts that hold the rarest grams of the query: all hits and few others.

    A query of one character or none cannot be narrowed: all texts. The driver sees one
    count per gram of the query and the block numbers to open.
    """
    texts = index.table("texts")
    asked = query_grams(query)
    if not asked:
        return texts.drop("text_no", "block")
    counts = {r["gram"]: r["texts"] for r in _of(index, "counts", asked).collect()}
    if len(counts) < len(asked):
        return texts.limit(0).drop("text_no", "block")
    chosen = sorted(asked, key=lambda g: (counts[g], g))[:rarest]
    listed = _of(index, "postings", chosen).select("block", F.explode("texts").alias("text_no"))
    held = listed.groupBy("block", "text_no").agg(F.count("*").alias("n"))
    held = held.filter(F.col("n") == len(chosen)).select("block", "text_no")
    blocks = [r["block"] for r in held.select("block").distinct().collect()]
    opened = texts.filter(F.col("block").isin(blocks))
    return opened.join(broadcast_if_small(held), ["block", "text_no"], "left_semi").drop("text_no", "block")
