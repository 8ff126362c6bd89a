"""Language model: a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z in lower case) and one end per document. The
root gives every token its smoothed share of all training tokens. A deeper state is
a context of up to ``depth`` words, its parent the context without the oldest word.
A context is a candidate when it makes up ``context_share`` of the tokens; it stays
when its next-token counts diverge from its parent's distribution by more than
``penalty`` nats per counted successor, or when a longer context that ends in it
stays. A state's distribution discounts its counts and hands the rest to its parent,
so every state sums to one. A token is scored at the state of the longest suffix of
the words before it.

Floors are counts, the same at any corpus size: a context needs ``MIN_CONTEXT``, a
successor ``MIN_ENTRY`` occurrences. All words, contexts and successors are Spark
tables under 64-bit digests: texts are stored as pieces, some hundred thousand tokens
with the digests of the piece's distinct words and a place among them per token; the
digest of several words is the exclusive or of theirs, turned by their age. Per
depth, (context, next word) pairs are counted by bucket of their digest and met with
their context's total and with the probability one level up by joins; a pair whose
suffix is too rare to be counted is too rare itself and is not sent.

Scoring is a sum of looked-up figures: a word adds its logarithm at the root, a
state that stays adds the logarithm of what it leaves to its parent, and a successor
that the state has counted adds the difference to its true probability. The most
frequent ``CACHED`` keys are sent to the workers. All others are asked for by
bucket, one key length after another: a task sends each of its keys once, with the
texts that hold it, to the figures of the key's bucket, and only sums per text come
back; the number of buckets follows the tokens. Bitmaps of fixed size, of the figures
and of the states that stay, spare keys that have no figure the way there. All this
only saves work: no bound of it changes a result. Stored tables and shuffles go as
soon as all that reads them is stored.

``learn`` gives the same model in memory, for small corpora.

Defined results: a null or empty text is one end token; unseen tokens have count 0;
repeated rows count, and are scored, as often as they occur; without training rows
every token has probability one; an empty table gives no rows. Only the id and the
text column are read.
"""

from __future__ import annotations

import gc
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.llm.common import fold, release, row_bytes, small_batches, stored

END = ""
ADD = 0.1
WORD_SHARE = 1e-8
MIN_CONTEXT = 16
MIN_ENTRY = 2
DEPTH = 3
DISCOUNT = 0.75
PENALTY = 2.0
FLUSH = 1 << 21
PIECE = 1 << 19
BATCH_BYTES = 4 << 20  # that one Arrow batch brings to a worker, or takes from it
ENCODED = "struct<codes: binary, rare: array<string>, n_tokens: long>"
CACHED = 500_000
COMMON = 20_000  # keys that a join sends to all tasks
BITS = 26
CHUNK = 18
TURN = 11
BUCKET = 1 << 21  # tokens per bucket of pairs or of look-ups of one length, on average
PACKED = "bucket int, keys binary, contexts binary, suffixes binary, times binary"
PACKED_COLUMNS = [c.split()[0] for c in PACKED.split(", ")]
ASKED = "bucket int, texts binary, known binary, base binary, score binary, keys binary, times binary, rows binary"
ASKED_COLUMNS = [c.split()[0] for c in ASKED.split(", ")]
PIECES = "row bigint, held_out boolean, n_tokens bigint, rows binary, lengths binary, words binary, codes binary"


def tokens(text: str | None) -> list[str]:
    return [*(w.decode("utf-8", "surrogatepass") for w in row_bytes(text).lower().split()), END]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token counts, combined over what a task reads."""
    held: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            held.update(tokens(text))
            if len(held) >= 500_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
    if held:
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})


def word_counts(texts: DataFrame) -> DataFrame:
    """Tokens of all ``texts`` with their counts."""
    return texts.select("text").mapInPandas(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_codes: dict[str, dict[str, int]] = {}  # of one vocabulary, kept between the batches of a worker


def _encoder(words: Broadcast):
    name = uuid.uuid4().hex

    def encode(texts: pd.Series) -> pd.DataFrame:
        """Codes of the frequent words (all others have the last code), and the other words."""
        if name not in _codes:
            _codes.clear()
            _codes[name] = {w: i for i, w in enumerate(words.value)}
        codes, last, out = _codes[name], len(_codes[name]), []
        for text in texts:
            found = tokens(text)
            row = np.fromiter((codes.get(w, last) for w in found), np.uint32, len(found))
            out.append((row.tobytes(), [found[i] for i in np.flatnonzero(row == last)], len(found)))
        return pd.DataFrame(out, columns=["codes", "rare", "n_tokens"])

    return F.pandas_udf(encode, ENCODED)


@dataclass
class Level:
    """The contexts of one length. A context's number is its place among the sorted ``keys``."""

    keys: np.ndarray  # parent's number * words + oldest word
    words: np.ndarray  # one row per context, oldest word first
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # context * (words + 1) + next
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # discounted share of each entry
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # share left to the parent
    passed: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    stays: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of every wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class SuffixTree:
    """The root's counts of the frequent words, and the contexts by length."""

    words: list[str]
    n: np.ndarray
    train_tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    @property
    def whole(self) -> float:
        return self.train_tokens + ADD * (self.distinct + 1)

    def root(self) -> np.ndarray:
        """Probabilities of the frequent words; 1 for the others, whose counts are elsewhere."""
        return np.append((self.n + ADD) / self.whole, 1.0)

    def walk(self, codes: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
        """Per depth the state before every token, -1 where there is none. ``place`` is the token's place in its text."""
        state = np.zeros(len(codes), np.int64)
        for depth, level in enumerate(self.levels, 1):
            older = np.full(len(codes), len(self.words), np.int64)
            older[depth:] = codes[: max(0, len(codes) - depth)]
            going = np.flatnonzero((state >= 0) & (place >= depth) & (older < len(self.words)))
            found = np.full(len(codes), -1, np.int64)
            found[going] = _find(level.keys, (state[going] * len(self.words) + older[going]).astype(np.uint64))
            state = found
            yield state

    def deeper(self, level: Level, state: np.ndarray, nexts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities one level deeper, where the state stays."""
        here = np.flatnonzero(state >= 0)
        here = here[level.stays[state[here]]]
        s, w = state[here], nexts[here]
        at = _find(level.entries, (s * (len(self.words) + 1) + w).astype(np.uint64))
        own = np.where(at >= 0, level.parts[np.maximum(at, 0)], 0.0) if len(level.parts) else np.zeros(len(s))
        out = p.copy()
        out[here] = own + level.rest[s] * p[here]
        return out

    def ancestors(self, depth: int, contexts: np.ndarray) -> list[np.ndarray]:
        """Numbers of the contexts' suffixes, from length 1 up to ``depth``."""
        out = [contexts]
        for level in reversed(self.levels[1:depth]):
            out.append((level.keys[out[-1]] // np.uint64(len(self.words))).astype(np.int64))
        return out[::-1]

    def test(self, penalty: float) -> None:
        """Mark the contexts that stay: the divergence test, then all suffixes of those that passed."""
        for depth, level in enumerate(self.levels, 1):
            level.stays = np.ones(len(level.keys), bool)
            size = np.uint64(len(self.words) + 1)
            context, nexts = (level.entries // size).astype(np.int64), (level.entries % size).astype(np.int64)
            p = self.root()[nexts]
            for upper, state in zip(self.levels[: depth - 1], self.ancestors(depth, context), strict=False):
                p = self.deeper(upper, state, nexts, p)
            gain = level.counts * np.log(level.counts / level.totals[context] / p)
            gains = np.bincount(context, gain - penalty, len(level.keys)) if len(context) else np.zeros(len(level.keys))
            level.passed = gains > 0
        for depth in range(len(self.levels), 0, -1):
            level = self.levels[depth - 1]
            level.stays = level.passed.copy()
            if depth < len(self.levels):
                longer = self.levels[depth]
                level.stays[(longer.keys[longer.stays] // np.uint64(len(self.words))).astype(np.int64)] = True


def _joined(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of several texts after another, each token's place in its text, and the texts' starts."""
    parts = [np.frombuffer(r, np.uint32) for r in rows]
    lengths = np.asarray([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return codes, np.arange(len(codes)) - np.repeat(starts, lengths), starts


def _pairs(tree: Broadcast):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of (state of the deepest level, next token), combined over what a task reads."""
        model, held, size = tree.value, [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"key": keys, "n": n})

        for batch in batches:
            codes, place, _ = _joined(batch["codes"])
            *_, state = model.walk(codes, place)
            here = state >= 0
            held.append(state[here] * (len(model.words) + 1) + codes[here])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return count


def _grow(tree: SuffixTree, level: Level, encoded: DataFrame, context_min: float, entry_min: float) -> Level:
    """Count what follows the contexts of a new level; gives the candidates of the next one."""
    spark, size = encoded.sparkSession, len(tree.words) + 1
    tree.levels.append(level)
    sent = spark.sparkContext.broadcast(tree)
    pairs = encoded.select("codes").mapInPandas(_pairs(sent), "key bigint, n bigint")
    counted = stored(pairs.groupBy("key").agg(F.sum("n").alias("n")), "successors")
    totals = counted.groupBy(F.floor(F.col("key") / size).alias("s")).agg(F.sum("n").alias("n")).toPandas()
    kept = counted.filter((F.col("n") >= entry_min) & (F.col("key") % size < size - 1)).toPandas().sort_values("key")
    level.totals = np.ones(len(level.keys))
    level.totals[totals["s"].to_numpy(np.int64)] = totals["n"].to_numpy(float)
    level.entries, level.counts = kept["key"].to_numpy(np.uint64), kept["n"].to_numpy(float)
    context = (level.entries // np.uint64(size)).astype(np.int64)
    level.parts = (level.counts - DISCOUNT) / level.totals[context]
    level.rest = 1.0 - np.bincount(context, level.parts, len(level.keys))
    nexts = (level.entries % np.uint64(size)).astype(np.int64)
    far = np.flatnonzero((level.counts >= context_min) & (nexts != tree.words.index(END) if END in tree.words else True))
    numbers = {tuple(w): i for i, w in enumerate(level.words.tolist())}
    words = [[*level.words[c].tolist(), int(w)] for c, w in zip(context[far], nexts[far], strict=True)]
    rows = sorted((numbers[tuple(w[1:])] * len(tree.words) + w[0], w) for w in words if tuple(w[1:]) in numbers)
    return Level(np.asarray([k for k, _ in rows], np.uint64), np.asarray([w for _, w in rows], np.int64))


def learn(
    counts: DataFrame,
    encoded: DataFrame,
    words: list[str],
    n: np.ndarray,
    totals: tuple[int, int],
    depth: int = DEPTH,
    context_min: int = MIN_CONTEXT,
    entry_min: int = MIN_ENTRY,
    penalty: float = PENALTY,
) -> SuffixTree:
    """Grow the tree in memory from the encoded training texts."""
    tree = SuffixTree(words, n, *totals)
    first = np.asarray([i for i, w in enumerate(words) if n[i] >= context_min and w != END], np.int64)
    level = Level(first.astype(np.uint64), first[:, None])
    while len(level.keys) and len(tree.levels) < depth:
        level = _grow(tree, level, encoded, context_min, entry_min)
    tree.test(penalty)
    return tree


def _tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, all of them as numbers of the distinct ones, and 64-bit digests of those."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = split.flatten(), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)
    lengths = np.bincount(owner.filter(there).to_numpy(), minlength=len(texts)) + 1
    coded = words.filter(there).dictionary_encode()
    found = np.array([*coded.dictionary.cast(pa.binary()).to_pylist(), END.encode()], object)
    numbers = np.full(lengths.sum(), len(found) - 1, np.int32)
    inner = np.ones(len(numbers), bool)
    inner[np.cumsum(lengths) - 1] = False
    numbers[inner] = coded.indices.to_numpy()
    return lengths, numbers, pd.util.hash_array(found, categorize=False).view(np.int64)


def _piece(parts: list[tuple]) -> tuple[bytes, ...]:
    """Texts as (row, length, numbers, words) in one row: distinct digests by frequency, and per token its place among them."""
    rows, lengths, numbers, words = zip(*parts, strict=True)
    at = np.cumsum([0, *map(len, words)])
    words, same = np.unique(np.concatenate(words), return_inverse=True)
    numbers = same[np.concatenate([n + start for n, start in zip(numbers, at, strict=False)])]
    times = np.bincount(numbers, minlength=len(words))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    words = words[order[: np.count_nonzero(times)]]
    steps = np.diff(words, prepend=np.int64(0))  # words of one frequency are in the order of their digests
    return tuple(map(_planes, (np.concatenate(rows), np.concatenate(lengths), steps, rank[numbers])))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text without its tokens, and per fold rows of the digests of about ``PIECE`` tokens of texts."""
    kinds = pa.schema([("rows", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])
    held: dict[bool, list[tuple]] = {False: [], True: []}
    doc_id = None

    def flush(out: bool) -> Iterator[pa.RecordBatch]:
        packed = [pa.array([v], pa.binary()) for v in _piece(held[out])]
        held[out].clear()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, doc_id), pa.nulls(1, pa.int64()), pa.array([out]), pa.nulls(1, pa.int64()), *packed], ["doc_id", "row", "held_out", "n_tokens", *kinds.names]
        )

    for batch in batches:
        doc_id = batch.column("doc_id").type
        lengths, numbers, words = _tokenized(batch.column("text"))
        none = [pa.nulls(batch.num_rows, kind) for kind in kinds.types]
        texts = [batch.column(c) for c in ("doc_id", "row", "held_out")]
        yield pa.RecordBatch.from_arrays([*texts, pa.array(lengths, pa.int64()), *none], ["doc_id", "row", "held_out", "n_tokens", *kinds.names])
        row, held_out = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "held_out"))
        owner = np.repeat(held_out, lengths)
        for out in (False, True):
            if (held_out == out).any():
                held[out].append((row[held_out == out], lengths[held_out == out], numbers[owner == out], words))
                if sum(len(p[2]) for p in held[out]) >= PIECE:
                    yield from flush(out)
    for out in (False, True):
        if held[out]:
            yield from flush(out)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of pieces: row, and the digests of the tokens."""
    for batch in batches:
        for rows, lengths, words, codes in batch[["rows", "lengths", "words", "codes"]].itertuples(index=False):
            lengths = _numbers(lengths)
            tokens = np.cumsum(_numbers(words))[_numbers(codes)].tobytes()
            ends = 8 * np.cumsum(lengths)
            yield pd.DataFrame({"row": _numbers(rows), "codes": [tokens[end - 8 * n : end] for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)]})


def _append(contexts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Digests of contexts with one more word."""
    old = contexts.view(np.uint64)
    return ((old << np.uint64(TURN)) | (old >> np.uint64(64 - TURN))).view(np.int64) ^ nexts


def _texts(rows: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of several texts after another, each token's place in its text, and the texts' starts."""
    lengths = rows.str.len().to_numpy(np.int64) // 8
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer(b"".join(rows), np.int64)
    return codes, np.arange(len(codes)) - np.repeat(starts, lengths), starts


def _last(codes: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Digests of the last one, two, up to ``length`` tokens at every token; a text's first tokens have fewer."""
    keys = codes
    for k in range(length):
        if k:
            keys = np.concatenate([codes[:1], _append(keys[:-1], codes[1:])])
        yield keys


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct slots of a task's keys, one row per chunk of slots."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[tuple]:
        slots = np.unique(np.concatenate(held)).astype(np.int64)
        held.clear()
        chunks = slots >> CHUNK
        for own in np.split(slots, np.flatnonzero(np.diff(chunks)) + 1):
            yield int(own[0] >> CHUNK), _planes(np.diff(own & ((1 << CHUNK) - 1), prepend=np.int64(0)))

    for batch in batches:
        held.append((batch["key"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BITS)).astype(np.uint32))
        if sum(map(len, held)) >= FLUSH:
            yield from _frames(flush(), ["chunk", "steps"])
    if sum(map(len, held)):
        yield from _frames(flush(), ["chunk", "steps"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit per slot that a ``key`` falls on."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << CHUNK, bool)
        for steps in rows["steps"]:
            bits[np.cumsum(_numbers(steps))] = True
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = keys.select("key").mapInPandas(_slots, "chunk bigint, steps binary").groupBy("chunk").applyInPandas(build, "chunk bigint, bits binary")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (CHUNK - 3)
    for row in parts.collect():  # 8 MB, whatever the input
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = keys.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of what is stored: it follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in order, about ``PIECE`` tokens at a time (a longer text is a piece of its own)."""
    for batch in batches:
        piece = np.cumsum(batch["codes"].str.len().to_numpy(np.int64)) // (8 * PIECE)
        for _, rows in batch.groupby(piece):
            yield rows


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as all their first bytes, all their second bytes and so on: high bytes that agree compress away."""
    return np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows in order, about ``BATCH_BYTES`` at a time (a larger row goes alone)."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in order, and where in that order each distinct key starts."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def _per_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, *values
    order, first = _runs(keys)
    return keys[order[first]], *(np.add.reduceat(v[order].astype(float), first) for v in values)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per bucket that has keys the places of its keys, in order."""
    home = (keys % buckets).astype(np.min_scalar_type(buckets))
    dealt = np.argsort(home, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(home, minlength=buckets)))
    del home
    for bucket in np.flatnonzero(np.diff(cuts)):
        yield int(bucket), dealt[cuts[bucket] : cuts[bucket + 1]]


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of tokens, combined over what a task reads."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pd.DataFrame]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        step = BATCH_BYTES // 16
        for at in range(0, len(key), step):
            yield pd.DataFrame({"key": key[at : at + step], "n": n[at : at + step]})

    for batch in batches:
        held.append(_texts(batch["codes"])[0])
        if sum(map(len, held)) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _counter(depth: int, candidates: Broadcast, buckets: int, repeated: Broadcast | None = None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of (context of ``depth`` words, next token), combined over what a task reads, one row per bucket of keys.

        A pair is no more frequent than its suffix, so one whose suffix is not ``repeated`` need not be counted.
        """
        held: list[tuple] = []

        def flush() -> Iterator[tuple]:
            columns = [list(c) for c in zip(*held, strict=True)]
            held.clear()
            key, context, suffix = (np.concatenate(columns.pop(0)) for _ in range(3))
            # counted bucket by bucket, so that sorting needs no second copy of what is held
            for bucket, rows in _dealt(key, buckets):
                alike, first = _runs(key[rows])
                n = np.diff(np.append(first, len(rows)))
                rows = rows[alike[first]]
                order = np.argsort(context[rows])
                rows = rows[order]
                steps = np.diff(context[rows], prepend=np.int64(0))
                yield (bucket, _planes(key[rows]) if depth > 1 else None, *map(_planes, (steps, suffix[rows], n[order])))

        for batch in _cut(batches):
            codes, place, _ = _texts(batch["codes"])
            *_, keys = _last(codes, depth)
            here = np.flatnonzero(place >= depth)
            here = here[_marked(candidates.value, keys[here - 1])]
            if repeated is not None:
                here = here[_marked(repeated.value, keys[here])]
            held.append((_append(keys[here - 1], codes[here]), keys[here - 1], keys[here]))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from _frames(flush(), PACKED_COLUMNS)
        if held:
            yield from _frames(flush(), PACKED_COLUMNS)

    return count


def _pair_sums(least: int):
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        """The pairs of one bucket that occur ``least`` times."""
        context = np.concatenate([np.cumsum(_numbers(c)) for c in rows["contexts"]])
        suffix, times = (np.concatenate([_numbers(c) for c in rows[name]]) for name in ("suffixes", "times"))
        if rows["keys"].isna().any():  # after one word the suffix is the next word, so the key need not travel
            key = _append(context, suffix)
        else:
            key = np.concatenate([_numbers(k) for k in rows["keys"]])
        order, first = _runs(key)
        n = np.add.reduceat(times[order], first)
        often = n >= least
        at = order[first[often]]
        return pd.DataFrame({"key": key[at], "context": context[at], "suffix": suffix[at], "n": n[often]})

    return add


def _counted(encoded: DataFrame, depth: int, candidates: Broadcast, buckets: int, least: int, repeated: Broadcast | None) -> DataFrame:
    """Counts of ``depth`` + 1 tokens in a row, from ``least`` on: key, context (without the newest), suffix (without the oldest), n."""
    count = _counter(depth, candidates, buckets, repeated)
    packed = encoded.mapInPandas(lambda batches: count(_unpacked(batches)), PACKED)
    return packed.groupBy("bucket").applyInPandas(_pair_sums(least), "key bigint, context bigint, suffix bigint, n bigint")


def _floor(table: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    seen, out = 0, None
    for row in table.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        seen += row["rows"]
        if seen > most:
            break
        out = row["least"]
    return (1 << 62) if out is None else out


def _meet(rows: DataFrame, table: DataFrame, on: str, least: float) -> DataFrame:
    """Join with a table of one row per ``on``; its common keys (``_n`` from ``least`` on) are sent to the rows."""
    columns = rows.columns
    sent = F.broadcast(table.filter(F.col("_n") >= least))
    tried = rows.join(sent, on, "left")
    others = tried.filter("_n IS NULL").select(*columns).join(table.filter(F.col("_n") < least), on)
    return tried.filter("_n IS NOT NULL").unionByName(others).drop("_n")


def _figures(encoded: DataFrame, words: DataFrame, whole: float, buckets: int, depth: int, share: float, context_min: int, entry_min: int, penalty: float) -> tuple[list[DataFrame], DataFrame | None]:
    """The learned model: per length rows of key, n, base and score (a key may have several), to be added up over the last so many tokens at every token.

    Then the keys of the states that stay: a longer key has a figure only as one of them, or where its context is one.
    """
    sc = encoded.sparkSession.sparkContext
    root = (F.col("n") + ADD) / F.lit(whole)
    known = F.log10(root) - F.lit(float(np.log10(ADD / whole)))
    figures = {1: words.select("key", "n", known.alias("base"), known.alias("score"))}
    shorter = words.select("key", "n", root.alias("p"))  # probabilities one level up
    contexts = words.select("key", "n", F.lit(None).cast("bigint").alias("suffix")).filter(F.col("n") >= context_min)
    found = []
    repeated = None
    for level in range(1, depth + 1):
        if contexts.isEmpty():
            break
        sent = sc.broadcast(_bitmap(contexts))
        pairs = stored(_counted(encoded, level, sent, buckets, entry_min, repeated), "pairs", compression="zstd")
        above = shorter.select(F.col("key").alias("suffix"), F.col("n").alias("_n"), "p")
        met = _meet(pairs, above, "suffix", max(share, _floor(shorter, COMMON)))
        n = F.col("n").cast("double")
        sums = met.groupBy(F.col("context").alias("key")).agg(
            F.sum(n - DISCOUNT).alias("own"),
            F.sum("n").alias("followed"),
            F.count("*").alias("successors"),
            F.sum(n * (F.log(n) - F.log("p"))).alias("gain"),
        )
        gain = F.col("gain") - F.col("followed") * F.log(F.col("n")) - penalty * F.col("successors")
        states = contexts.join(sums, "key").select("key", "n", "suffix", (1 - F.col("own") / F.col("n")).alias("rest"), (gain > 0).alias("passed"))
        states = stored(states, "states", compression="zstd")
        if level > 1:
            release(contexts)
        above = states.select(F.col("key").alias("context"), F.col("n").alias("_n"), F.col("n").alias("total"), "rest")
        p = (n - DISCOUNT) / F.col("total") + F.col("rest") * F.col("p")
        more = F.log10(p / F.col("p")) - F.log10("rest")
        entries = _meet(met, above, "context", max(share, _floor(states, COMMON)))
        entries = stored(entries.select("key", "context", "n", p.alias("p"), more.alias("more")), "successors", compression="zstd")
        found.append((states, entries))
        _free(encoded.sparkSession)
        shorter = entries.select("key", "n", "p")
        if level < depth:
            contexts = stored(pairs.select("key", "n", "suffix").filter(F.col("n") >= context_min), "contexts", compression="zstd")
            repeated = sc.broadcast(_bitmap(pairs))
        release(pairs)
    longer = kept_states = None
    for level, (states, entries) in reversed([*enumerate(found, 1)]):
        stays = states.filter("passed").select("key")
        if longer is not None:
            stays = stays.unionByName(longer).distinct()
        staying = stored(states.join(stays, "key", "left_semi"), "staying", compression="zstd")
        longer = staying.select(F.col("suffix").alias("key"))
        kept_states = staying.select("key") if kept_states is None else kept_states.unionByName(staying.select("key"))
        none = F.lit(0.0).alias("base")
        own = staying.select("key", "n", none, F.log10("rest").alias("score"))
        figures[level] = figures[level].unionByName(own) if level in figures else own
        above = staying.select(F.col("key").alias("context"), F.col("n").alias("_n"))
        kept = _meet(entries, above, "context", max(share, _floor(staying, COMMON)))
        kept = stored(kept.select("key", "n", F.col("more").alias("score")), "staying-successors", compression="zstd")
        release(states, entries)
        after = kept.select("key", "n", none, "score")
        figures[level + 1] = figures[level + 1].unionByName(after) if level + 1 in figures else after
    return [figures[length] for length in sorted(figures)], kept_states


def _asker(cached: Broadcast, marks: Broadcast, states: Broadcast, length: int, buckets: int):
    """A key of more than one token has a figure only as a state that stays, or after one."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per text the sums of the cached figures, and per bucket the keys of ``length`` tokens that may have others, with the texts that hold them."""
        keys, base, score = cached.value
        places = pd.Index(keys)
        texts: list[tuple] = []
        wanted: list[tuple] = []

        def flush() -> Iterator[tuple]:
            sums = [np.concatenate(c) for c in zip(*texts, strict=True)]
            key, row = (np.concatenate(c) for c in zip(*wanted, strict=True))
            texts.clear()
            wanted.clear()
            yield (int(sums[0][0] % buckets), *map(_planes, sums[:2]), *(c.tobytes() for c in sums[2:]), None, None, None)
            for bucket, own in _dealt(key, buckets):
                order, first = _runs(key[own])
                own = own[order]
                times = np.diff(np.append(first, len(own)))
                yield (bucket, None, None, None, None, _planes(np.diff(key[own[first]], prepend=np.int64(0))), _planes(times), _planes(row[own]))

        for batch in _cut(batches):
            codes, place, starts = _texts(batch["codes"])
            row = batch["row"].to_numpy(np.int64)
            owner = np.repeat(row, np.diff(np.append(starts, len(codes))))
            sums = np.zeros((3, len(codes)))
            *_, context, key = [codes, *_last(codes, length)]
            here = np.flatnonzero(place >= length - 1)
            here = here[_marked(marks.value, key[here])]
            if length > 1:
                here = here[_marked(states.value, context[here - 1]) | _marked(states.value, key[here])]
            at = places.get_indexer(key[here])
            hit, miss = here[at >= 0], here[at < 0]
            at = at[at >= 0]
            sums[:, hit] = base[at] > 0, base[at], score[at]
            wanted.append((key[miss], owner[miss]))
            known, own_base, own_score = np.add.reduceat(sums, starts, axis=1) if len(codes) else np.zeros((3, 0))
            texts.append((row, known.astype(np.int64), own_base, own_score))
            if sum(len(k) for k, _ in wanted) >= FLUSH:
                yield from _frames(flush(), ASKED_COLUMNS)
        if texts:
            yield from _frames(flush(), ASKED_COLUMNS)

    return ask


def _figure_packer(buckets: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Figures by bucket of their key, combined over what a task reads."""
        held: list[tuple] = []

        def flush() -> Iterator[tuple]:
            key, base, score = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            for bucket, own in _dealt(key, buckets):
                own = own[np.argsort(key[own])]
                yield (bucket, None, None, base[own].tobytes(), score[own].tobytes(), _planes(np.diff(key[own], prepend=np.int64(0))), None, None)

        for batch in batches:
            held.append((batch["key"].to_numpy(np.int64), batch["base"].to_numpy(float), batch["score"].to_numpy(float)))
            if sum(len(h[0]) for h in held) >= FLUSH:
                yield from _frames(flush(), ASKED_COLUMNS)
        if sum(len(h[0]) for h in held):
            yield from _frames(flush(), ASKED_COLUMNS)

    return pack


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums per text over one bucket: of the keys that the texts ask for, and of what the texts brought."""
    figures = rows[rows["keys"].notna() & rows["rows"].isna()]
    key = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_numbers(k)) for k in figures["keys"])])
    own = [np.frombuffer(b"".join(figures[c])) for c in ("base", "score")]
    keys, known, base, score = _per_key(key, (own[0] > 0).astype(float), *own)
    found = []
    for texts, n, own_base, own_score in rows.loc[rows["texts"].notna(), ["texts", "known", "base", "score"]].itertuples(index=False):
        found.append((_numbers(texts), _numbers(n), np.frombuffer(own_base), np.frombuffer(own_score)))
    for steps, times, asking in rows.loc[rows["rows"].notna(), ["keys", "times", "rows"]].itertuples(index=False):
        at = np.repeat(_find(keys, np.cumsum(_numbers(steps))), _numbers(times))
        row, at = _numbers(asking)[at >= 0], at[at >= 0]
        if len(row):
            found.append(_per_key(row, known[at], base[at], score[at]))
    if not found:
        return pd.DataFrame({"row": [], "known": [], "base": [], "score": []})
    row, *sums = _per_key(*(np.concatenate(c) for c in zip(*found, strict=True)))
    return pd.DataFrame({"row": row, "known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})


def score_documents(
    docs: DataFrame,
    folds: int = 10,
    depth: int = DEPTH,
    word_share: float = WORD_SHARE,
    context_min: int = MIN_CONTEXT,
    entry_min: int = MIN_ENTRY,
    penalty: float = PENALTY,
) -> DataFrame:
    """Learn from all rows but the held-out fold, and score all rows.

    Keys are sent to the workers from ``word_share`` of the training tokens on, at most ``CACHED``.
    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark, BATCH_BYTES)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text").withColumn("row", F.monotonically_increasing_id())
    kinds = StructType([rows.schema["doc_id"], *StructType.fromDDL(PIECES)])
    encoded = stored(rows.mapInArrow(_encode, kinds), "encoded", compression="zstd")
    pieces = encoded.filter("codes IS NOT NULL").select("held_out", "rows", "lengths", "words", "codes")
    training = pieces.filter("NOT held_out")
    tallies = training.mapInPandas(lambda batches: _tally(_unpacked(batches)), "key bigint, n bigint")
    words = stored(tallies.groupBy("key").agg(F.sum("n").alias("n")), "word-counts", compression="zstd")
    distinct, total = words.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    whole, share = total + ADD * (distinct + 1), word_share * total
    _free(spark)

    buckets = 1 + total // BUCKET
    figures, states = _figures(training, words, whole, buckets, depth, share, context_min, entry_min, penalty)
    model = figures[0]
    for more in figures[1:]:
        model = model.unionByName(more)
    least = max(share, _floor(model, CACHED))
    top = model.filter(F.col("n") >= least).groupBy("key").agg(F.sum("base").alias("base"), F.sum("score").alias("score"))
    top = top.toPandas().sort_values("key")
    cached = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("key", "base", "score")))
    kept = spark.sparkContext.broadcast(None if states is None else _bitmap(states))
    texts = encoded.filter("codes IS NULL").select("row", "doc_id", "held_out", "n_tokens")
    _free(spark)

    # one length after another, so that only the look-ups of one lie on disk
    for length, table in enumerate(figures, 1):
        marks = spark.sparkContext.broadcast(_bitmap(table))
        ask = _asker(cached, marks, kept, length, buckets)
        asked = pieces.mapInPandas(lambda batches, ask=ask: ask(_unpacked(batches)), ASKED)
        others = table.filter(F.col("n") < least).select("key", "base", "score").mapInPandas(_figure_packer(buckets), ASKED)
        answers = asked.unionByName(others).groupBy("bucket").applyInPandas(_answered, "row bigint, known bigint, base double, score double")
        answers = stored(answers.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "score")]), "sums", compression="zstd")
        texts = texts.unionByName(answers, allowMissingColumns=True)
        _free(spark)
    summed = texts.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("known", "base", "score")]
    )
    unseen = F.col("n_tokens") * F.lit(float(np.log10(ADD / whole)))
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + unseen).alias("base_score"),
        (F.col("score") + unseen).alias("score"),
    )
