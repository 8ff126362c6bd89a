"""Harmonic packing of documents into token sequences.

A document's token ids (and one end id) are cut into full sequences and a rest.
Class ``k`` holds the pieces longer than ``capacity / (k + 1)`` and not longer
than ``capacity / k``: ``k`` of them always fit one sequence, so every worker
fills the sequences of its classes by counting, without looking at lengths or at
other workers. A rest of a low class would leave much of its share empty; it is
cut at ``capacity // (k + 1)``, which fills class ``k + 1`` exactly, and what
remains is shorter than ``capacity / (k * (k + 1))``. From class ``SPLIT_BELOW``
on, rests stay whole: they waste less than one part in nine of a sequence. Above
``CLASSES``, classes go on up to ``capacity`` in steps of an eighth, with the same bound.

Each worker's last sequence of a class may lack pieces. These leftovers, fewer
than ``k`` per worker and class, are grouped once more by class over all workers,
and what then still lacks company, fewer pieces than the sum of the classes at any
corpus size, is placed first-fit. Workers are hash buckets of (document, start), so
a document of any length, or an id that many rows share, is spread over them.

Defined results: a null or empty text is the end id alone; repeated rows are packed
as often as they occur; an empty table gives no pieces; an added token of the tokenizer's
file (such as an end mark) written out in a text is that one token, as the file has it; a
text of any length is cut into as many pieces as it fills. Only the id and the text
column are read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import small_batches, stored

CAPACITY = 1024
CLASSES = 64
SPLIT_BELOW = 8
WORKERS = 256
END = 0
CACHED = 600_000
MARKS_KEPT = 10_000
#: Bytes of text that one Arrow batch brings to a worker.
BATCH_BYTES = 4 << 20
MARKS = ".,;:!?#*$%&|"
SLICE_CHARS = 1 << 20
#: A space before another white space: the parts around it are not independent.
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_UNSAFE = [" " + blank for blank in _BLANKS]


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, with the ids of words of letters kept.

    From ``CACHED`` kept words on, only those go on that the last texts had again, so that a
    worker's memory does not follow the corpus. What ends in marks is put together from its
    word, and other parts hardly come again, so both go after the texts they are in.

    The tokenizer splits text before each space that precedes a word, and between
    letters and a run of punctuation, and never merges across such a split. So a text
    is looked up word by word, and a new word of letters goes to the tokenizer's
    merges at once. Whatever else there is, added tokens among it, goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = [*_UNSAFE, "\0", *added]
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(others)}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def word(self, word: str) -> bytes:
        """Ids of a word of letters, with the space before it if any."""
        seen = word.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.merge(seen)]).tobytes()

    def fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts that are not known; words of letters are known from here on."""
        out, rest, known = {}, [], self.known
        for part in new:
            core = part.rstrip(MARKS)
            if core.removeprefix(" ").isalpha():
                if core not in known:
                    known[core] = self.word(core)
                mark = part[len(core) :]
                if mark:
                    if mark not in self.marks:
                        if len(self.marks) >= MARKS_KEPT:
                            self.marks.clear()
                        self.marks[mark] = self.encode([mark])[0]
                    out[part] = known[core] + self.marks[mark]
            else:
                rest.append(part)
        for i in range(0, len(rest), 1024):
            out.update(zip(rest[i : i + 1024], self.encode(rest[i : i + 1024]), strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | None] = []
        used: set[str] = set()
        for text in texts:
            if text.endswith(" ") or any(mark in text for mark in self.whole):
                parts.append(None)
                continue
            parts.append(text.replace(" ", "\0 ").split("\0"))
            used.update(parts[-1])
        known = self.known
        new = used.difference(known)
        fresh = self.fresh(new)
        known.update(fresh)
        whole = iter(self.encode([t for t, p in zip(texts, parts, strict=True) if p is None]))
        out = [next(whole) if p is None else b"".join(map(known.__getitem__, p)) for p in parts]
        for part in fresh:
            del known[part]
        if len(known) >= CACHED:
            again = used - new
            self.known = {word: known[word] for word in again} if len(again) < CACHED else {}
        return out


_tokenizers: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One tokenizer per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        exact = capacity // (k + 1)
        if k < SPLIT_BELOW and rest != capacity // k:
            out.append(exact)
            rest -= exact
        else:
            out.append(rest)
            rest = 0
    return out


def piece_rows(texts: list[bytes], capacity: int = CAPACITY) -> tuple[pa.Array, ...]:
    """Of the pieces of all texts: which text, start, ids and the text's number of ids."""
    row, start, ids, total = [], [], [], []
    for r, held in enumerate(texts):
        n, at = len(held) // 4, 0
        for length in cuts(n, capacity):
            row.append(r)
            start.append(at)
            ids.append(held[4 * at : 4 * (at + length)])
            total.append(n)
            at += length
    return pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of a batch, about ``SLICE_CHARS`` characters at a time (a longer text is a slice of its own)."""
    held, chars, first = [], 0, 0
    doc_ids, texts = batch.column("doc_id"), batch.column("text")
    for at in range(batch.num_rows):
        held.append(texts[at].as_py() or "")
        chars += len(held[-1])
        if chars >= SLICE_CHARS or at == batch.num_rows - 1:
            yield doc_ids.slice(first, len(held)), held
            held, chars, first = [], 0, at + 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens.

    A worker gives the pieces of one slice away before it takes the next.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    tail = np.asarray([end], "<u4").tobytes()
    rows = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens_of(tokenizer)
        for batch in batches:
            for doc_ids, texts in slices(batch):
                row, *columns = piece_rows([ids + tail for ids in encode(texts)], capacity)
                yield pa.RecordBatch.from_arrays([doc_ids.take(row), *columns], ["doc_id", "start", "ids", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(cut, f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint")
    length = (F.octet_length("ids") / 4).cast("bigint")
    return found.select("doc_id", "start", length.alias("length"), "ids", "doc_tokens")


def _sequences(rows: DataFrame, group: list[str], order: list[str], base: Column) -> DataFrame:
    """Fill sequences of ``_class`` pieces inside ``group``; ``_lacks`` marks the pieces of unfinished ones."""
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    ranked = ranked.withColumn("_bin", F.floor(F.col("_at") / F.col("_class")))
    inside = Window.partitionBy(*group, "_bin").orderBy("_at")
    whole = Window.partitionBy(*group, "_bin")
    return (
        ranked.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
        .withColumn("_lacks", F.count("*").over(whole) < F.col("_class"))
        .withColumn("sequence_id", base + F.col("_bin"))
        .drop("_at", "_bin")
    )


def _first_fit(capacity: int, base: int):
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        """The last leftovers, longest first, each into the first sequence with room."""
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        spots = []
        for n in rows["length"]:
            at = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            spots.append((base + at, used[at]))
            used[at] += int(n)
        rows["sequence_id"], rows["offset"] = zip(*spots, strict=True)
        return rows

    return place


def coarse(capacity: int = CAPACITY) -> list[int]:
    """Classes of short pieces above ``CLASSES``, each at most an eighth above the one before."""
    out, k = [], CLASSES + CLASSES // 8
    while k <= capacity:
        out.append(k)
        k += k // 8
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, workers: int = WORKERS) -> DataFrame:
    """``rows`` (doc_id, start, length and any others) with ``sequence_id`` and ``offset``."""
    columns = rows.columns
    fit = F.floor(F.lit(capacity) / F.col("length"))
    k = F.greatest(F.least(fit, F.lit(CLASSES)), *[F.when(fit >= c, F.lit(c)) for c in coarse(capacity)], F.lit(1)).cast("bigint")
    worker = F.pmod(F.xxhash64("doc_id", "start"), F.lit(workers))
    classed = rows.withColumn("_class", k).withColumn("_worker", worker)
    order = [c for c in columns if c not in ("length",)]
    # the bits of an id from the top: round, class, worker, number
    first = _sequences(
        classed, ["_class", "_worker"], order, F.shiftleft(F.col("_class") * F.lit(workers) + F.col("_worker"), 40)
    )
    first = stored(first, "packed")
    again = _sequences(
        first.filter("_lacks").drop("sequence_id", "offset", "_lacks"), ["_class"], order, F.shiftleft("_class", 40) + F.lit(1 << 62)
    )
    again = stored(again, "packed-leftovers")
    last = again.filter("_lacks").drop("sequence_id", "offset", "_lacks")
    schema = again.drop("_lacks").schema
    rest = last.groupBy().applyInPandas(_first_fit(capacity, (1 << 62) + (1 << 61)), schema)
    done = first.filter("NOT _lacks").unionByName(again.filter("NOT _lacks")).drop("_lacks").unionByName(rest)
    return done.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, workers: int = WORKERS) -> DataFrame:
    """Pieces of all documents with their place; the ids themselves stay behind as a checksum."""
    held = pieces(docs, tokenizer, capacity)
    slim = held.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(slim, capacity, workers)
