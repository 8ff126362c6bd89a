"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes when it lies in a string of ``threshold`` bytes that also starts at
another place of the corpus. Whether two places start equal strings is decided on
ranks, as in a suffix array built by prefix doubling: places hold the rank of their
first L bytes; Spark groups and sorts the pairs (rank, name of the bytes at offset L),
numbers the pairs that occur at several places, and these numbers are the ranks of
the longer prefixes. A place whose pair occurs once is unique and goes out of all
further rounds. Rounds end past the threshold.

Writing a row for every byte would multiply the corpus, so rounds start on blocks of
neighbouring places (``position_blocks``): equal windows always stand at the same
place of two blocks. With a threshold of 200 a block has 73 places and the rounds are

1. 64 bytes: one name per block, counted; names found once never become rows;
2. 128 bytes, the core that all windows of the block share: pairs of two names of 64;
3. 272 bytes, the hull of the block: where the pair (rank of the core, hull) repeats,
   all 73 windows repeat, and the block is decided;
4. blocks with a repeated core and no repeated hull, and one block of each repeated
   hull beside them, are cut into parts of 9 places, with cores of 192 and hulls of
   208 bytes, and the round is run again;
5. parts still open are cut into single places: pairs of (rank, 200 bytes).

Ranks are running numbers over sorted pairs. A place is (text, offset): pairs count
as repeated when they occur in two texts or at two offsets, which minima and maxima
tell with map-side combining, so a passage in a third of all documents is one row per
task. Texts are named by 128 bits of sha256: equal texts answer as one, and a text
that several rows hold goes whole.

Names are 64-bit polynomial hashes compared only beside an equal rank (the first
pair has 128 bits). A bitmap of the names that round 1 found repeated, ``max_bits`` at
most, is sent to the tasks; when the corpus fills it, more blocks become rows, and
the result is the same. Lookups meet the rows in merge joins at every size.

Defined results: a null text is empty; empty texts and texts shorter than the
threshold lose nothing; very long texts are read in pieces that overlap by a window,
so memory per task is bounded by the longest text itself; rows that repeat a text all
lose it whole when it is long enough; null or repeated ids only label the rows;
matches may overlap, also within one text; an empty table gives no rows. Only the id
and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.bitmaps import bits_for, build, marked
from factledger.llm.common import small_batches, stored
from factledger.llm.position_blocks import Blocks, Names, Piece, Shape, blocks, pieces
from factledger.operators.joins import SMALL_BYTES, table_bytes
from factledger.operators.ranking import numbered

MAX_BITS = 28
#: Bytes of text that one Arrow batch brings to a worker.
BATCH_BYTES = 4 << 20
#: Open blocks that are cut into parts at a time.
PART_ROWS = 1024
ROWS = "t1 bigint, t2 bigint, front bigint, low int, high int, n0 bigint, n1 bigint, hull bigint"
EDGES = "t1 bigint, t2 bigint, front bigint, low int, high int, rank bigint, settled boolean, edge binary, has_left int, has_right int"
PARTS = "t1 bigint, t2 bigint, front bigint, low int, high int, rank bigint, part int, name bigint, hull bigint, settled boolean, edge binary"
PLACES = "t1 bigint, t2 bigint, front bigint, rank bigint, step int, edge binary, settled boolean"
SPANS = "t1 bigint, t2 bigint, spans array<struct<lo: bigint, hi: bigint>>"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, body in bytes, and the text's name t1, t2."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body"), F.sha2(body, 256).alias("_sha"))
    lane = lambda at: F.conv(F.substring("_sha", at, 16), 16, -10).cast("bigint")
    return rows.select("doc_id", "body", lane(1).alias("t1"), lane(17).alias("t2"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return offsets, np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)


def _scan(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[Piece, Names, Blocks]]:
    offsets, data = _bytes(batch.column("body"))
    for piece in pieces(offsets, data, shape):
        names = Names(piece.data)
        yield piece, names, blocks(piece, names, shape)


def _signed(names: np.ndarray) -> pa.Array:
    return pa.array(names.view(np.int64), pa.int64())


def _first_names(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names, found in _scan(batch, shape):
                yield pa.RecordBatch.from_arrays([_signed(names.of(found.front, (shape.core + 1) // 2))], ["name"])

    return run


def repeated_names(names: DataFrame, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """A bitmap over the names that occur more than once, and its number of bits as a power of two."""
    found = stored(names.groupBy("name").count().filter("count > 1").select("name"), "repeated-names")
    bits = bits_for(16 * found.count(), max_bits)
    return build(found.select(F.shiftrightunsigned("name", 64 - bits).alias("slot")), 1 << bits), bits


def _hulls(names: Names, first: np.ndarray, last: np.ndarray, begin: np.ndarray, length: int) -> pa.Array:
    """Names of the hulls that lie inside their text, else 0."""
    inside = (begin >= first) & (begin + length <= last)
    out = np.zeros(len(begin), np.uint64)
    out[inside] = np.maximum(names.of(begin[inside], length), np.uint64(1))
    return _signed(out)


def _block_rows(shape: Shape, bitmap: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (shape.core + 1) // 2
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            for piece, names, found in _scan(batch, shape):
                first = names.of(found.front, half)
                keep = np.flatnonzero(marked(bitmap.value, (first >> np.uint64(64 - bits)).astype(np.int64)))
                text, front = found.text[keep], found.front[keep]
                row = piece.row[text]
                begin = front - shape.block + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t1[row]),
                        pa.array(t2[row]),
                        pa.array(front + piece.shift[text]),
                        pa.array(found.low[keep], pa.int32()),
                        pa.array(found.high[keep], pa.int32()),
                        _signed(first[keep]),
                        _signed(names.of(front + half, shape.core - half)),
                        _hulls(names, piece.first[text], piece.last[text], begin, shape.hull),
                    ],
                    ["t1", "t2", "front", "low", "high", "n0", "n1", "hull"],
                )

    return run


def _places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The span of places of each key: least and greatest text and offset, combined before the shuffle."""
    bounds = [F.min("t1").alias("t_min"), F.max("t1").alias("t_max"), F.min("front").alias("f_min"), F.max("front").alias("f_max")]
    return rows.groupBy(*keys).agg(*bounds, F.bool_or(~F.col("settled")).alias("live"))


def _several() -> Column:
    """The key is found at two different places."""
    return (F.col("t_min") != F.col("t_max")) | (F.col("f_min") != F.col("f_max"))


def rerank(rows: DataFrame, core: list[str], label: str) -> DataFrame:
    """One round: ``rows`` of a repeated core, with its new rank and what the hull decides.

    The pairs ``core`` that occur at several places are sorted and numbered: rank. ``done``
    says that the row's hull repeats too, ``lead`` that the row lies in the first text of
    such a hull, ``open`` that some row of the rank is to be decided. Cores are judged on the
    groups of hulls, which are fewer than the rows.
    """
    groups = stored(_places(rows, [*core, "hull"]).withColumn("done", (F.col("hull") != 0) & _several()), f"{label}-hulls")
    bounds = [F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), F.min("f_min").alias("f_min"), F.max("f_max").alias("f_max")]
    cores = groups.groupBy(*core).agg(*bounds, F.bool_or(F.col("live") & ~F.col("done")).alias("open")).filter(_several())
    ranks = numbered(cores.select(*core, "open"), core, name="new_rank")
    found = groups.select(*core, "hull", "done", F.col("t_min").alias("first")).join(ranks.hint("merge"), core)
    # a merge join at every size; adaptive execution splits a partition with a hot pair
    keyed = rows.join(stored(found, f"{label}-ranks").hint("merge"), [*core, "hull"])
    lead = F.col("done") & (F.col("first") == F.col("t1"))
    return stored(keyed.withColumn("lead", lead).drop("first", *core).withColumnRenamed("new_rank", "rank"), label)


def _open(decided: DataFrame) -> DataFrame:
    """Undecided rows, and one row of each repeated hull that stands beside them under one core, as settled."""
    kept = decided.filter("open AND (NOT done OR lead)")
    return kept.withColumn("settled", F.col("done") | F.col("settled")).drop("done", "lead", "open", "hull")


def _holders(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts whose name may be among the rows': a bitmap decides, so most others are not shuffled."""
    bits = bits_for(16 * rows.count(), MAX_BITS)
    slots = rows.select(F.shiftrightunsigned("t1", 64 - bits).alias("slot"))
    sent = texts.sparkSession.sparkContext.broadcast(build(slots, 1 << bits))

    @F.pandas_udf("boolean")
    def may_hold(slot: pd.Series) -> pd.Series:
        return pd.Series(marked(sent.value, slot.to_numpy(np.int64)))

    return texts.withColumn("may_hold", may_hold(F.shiftrightunsigned("t1", 64 - bits)))


def _edges(texts: DataFrame, open_: DataFrame, firsts: DataFrame, shape: Shape) -> DataFrame:
    """Open blocks with the bytes on both sides of their core; of equal texts the first row is read."""
    fields = ["front", "low", "high", "rank", "settled"]
    lists = open_.groupBy("t1", "t2").agg(F.collect_set(F.struct(*fields)).alias("held"))
    lists = stored(lists.join(firsts, ["t1", "t2"]).withColumnRenamed("doc_id", "first_id"), "open-places")
    few = _holders(lists, texts).filter("may_hold").drop("may_hold")
    joined = few.join(lists.hint("merge"), ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return joined.select("t1", "t2", "body", "held").mapInArrow(_edge_rows(shape), EDGES)


def _edge_rows(shape: Shape):
    side = shape.block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes(batch.column("body"))
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for r in range(batch.num_rows):
                held = batch.column("held")[r].values
                n = int(offsets[r + 1] - offsets[r])
                padded = np.zeros(n + 2 * side, np.uint8)
                padded[side : side + n] = data[offsets[r] : offsets[r + 1]]
                front = held.field("front").to_numpy()
                near = np.arange(side)
                at = np.concatenate([near, near + side + shape.core])[None, :] + front[:, None]
                edge = padded[at].tobytes()
                width = pa.binary(2 * side) if side else pa.binary()
                cut = pa.Array.from_buffers(width, len(front), [None, pa.py_buffer(edge)]) if side else pa.array([b""] * len(front))
                count = lambda v: pa.array(np.clip(v, 0, side), pa.int32())
                columns = [pa.array(np.full(len(front), t1[r])), pa.array(np.full(len(front), t2[r]))]
                columns += [held.field(c) for c in ("front", "low", "high", "rank", "settled")]
                columns += [cut.cast(pa.binary()), count(front), count(n - front - shape.core)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in EDGES.split(", ")])

    return run


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row, and which number of ``low..high`` (both included) for every number of every row."""
    counts = high - low + 1
    which = np.repeat(np.arange(len(low)), counts)
    return which, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]


def _part_rows(shape: Shape):
    """Parts of open blocks: the rank of the block's core and the names of the edge bytes that the part's core
    and hull add to it, and the part's own edges."""
    side, width = shape.block - 1, shape.part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PART_ROWS) for whole in batches for at in range(0, whole.num_rows, PART_ROWS)):
            offsets, data = _bytes(batch.column("edge"))
            edge = data[offsets[0] : offsets[-1]]
            names = Names(edge)
            low, high, front = (batch.column(c).to_numpy() for c in ("low", "high", "front"))
            left, right = (batch.column(c).to_numpy().astype(np.int64) for c in ("has_left", "has_right"))
            which, part = _runs(low.astype(np.int64) // width, high.astype(np.int64) // width)
            begin = part * width
            size = np.minimum(begin + width, shape.block) - begin
            base = which * 2 * side
            # the core of the part: ``begin`` bytes on the left of the block's core, the rest on its right
            core_at, core_size = base + side - begin, side - size + 1
            hull_at, hull_size = core_at - size + 1, side + size - 1
            inside = (begin + size - 1 <= left[which]) & (side - begin <= right[which])
            hull = np.zeros(len(which), np.uint64)
            hull[inside] = np.maximum(names.of(hull_at[inside], hull_size[inside]), np.uint64(1))
            padded = np.concatenate([np.zeros(width, np.uint8), edge, np.zeros(width, np.uint8)])
            near = np.arange(width - 1)
            ends = core_at + core_size
            take = np.concatenate([core_at[:, None] - (width - 1) + near, ends[:, None] + near], axis=1) + width
            own = padded[take].tobytes()
            room = 2 * (width - 1)
            cut = pa.Array.from_buffers(pa.binary(room), len(which), [None, pa.py_buffer(own)]).cast(pa.binary()) if room else pa.array([b""] * len(which))
            pick = pa.array(which)
            columns = [batch.column("t1").take(pick), batch.column("t2").take(pick), pa.array(front[which] - begin)]
            columns += [pa.array(np.maximum(low[which] - begin, 0), pa.int32()), pa.array(np.minimum(high[which] - begin, size - 1), pa.int32())]
            columns += [batch.column("rank").take(pick), pa.array(part, pa.int32()), _signed(names.of(core_at, core_size)), _signed(hull)]
            columns += [batch.column("settled").take(pick), cut]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PARTS.split(", ")])

    return run


def _place_rows(parts: DataFrame, shape: Shape) -> DataFrame:
    """Single places of open parts: the rank of the part's core and the bytes that the window adds to it."""
    steps = parts.withColumn("step", F.explode(F.sequence("low", "high")))
    size = F.least(F.lit(shape.part), shape.block - F.col("part") * shape.part)
    # edge bytes: part - 1 before the core, part - 1 behind it
    added = F.substring("edge", (shape.part - F.col("step")).cast("int"), (size - 1).cast("int"))
    return steps.select("t1", "t2", (F.col("front") - F.col("step")).alias("front"), "rank", "step", added.alias("edge"), "settled")


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the intervals cover; intervals that touch are one run."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    begins = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, np.int64)
    return lo[begins], hi[np.append(begins[1:], len(lo)) - 1] if len(lo) else hi


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            lo, hi = merged(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("lo", "hi")))
            out.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(out, kind)], ["t1", "t2", "spans"])


def _read_once(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The texts without later copies, where the list of copied texts is small enough for every task; else all.

    Copies give the same places, so they cost time and change nothing.
    """
    copied = groups.filter("copies > 1").select("t1", "t2", F.col("doc_id").alias("_first"), F.lit(True).alias("_copied"))
    if table_bytes(copied) > SMALL_BYTES:
        return texts
    marked = texts.join(F.broadcast(copied), ["t1", "t2"], "left")
    return marked.filter(F.col("_copied").isNull() | F.col("doc_id").eqNullSafe(F.col("_first"))).drop("_first", "_copied")


def repeated_spans(texts: DataFrame, groups: DataFrame, shape: Shape) -> DataFrame:
    """t1, t2 and the maximal runs of bytes that repeated windows cover, for each text with any."""
    spark = texts.sparkSession
    firsts = groups.drop("copies")
    once = _read_once(texts, groups)
    bitmap, bits = repeated_names(once.select("body").mapInArrow(_first_names(shape), "name bigint"))
    sent = spark.sparkContext.broadcast(bitmap)
    rows = stored(once.drop("doc_id").mapInArrow(_block_rows(shape, sent, bits), ROWS), "blocks")
    decided = rerank(rows.withColumn("settled", F.lit(False)), ["n0", "n1"], "block-ranks")

    edges = stored(_edges(texts, _open(decided), firsts, shape), "open-blocks")
    parts = edges.mapInArrow(_part_rows(shape), PARTS).withColumnRenamed("rank", "above")
    parts = stored(parts.withColumn("part_no", F.col("part")), "parts")
    decided_parts = rerank(parts, ["above", "part", "name"], "part-ranks")

    places = _place_rows(_open(decided_parts.withColumn("part", F.col("part_no"))), shape)
    keys = ["rank", "step", "edge"]
    again = stored(_places(places, keys).filter(_several()).select(*keys), "places")
    last = places.filter("NOT settled").join(again.hint("merge"), keys, "left_semi")

    size = F.least(F.lit(shape.part), shape.block - F.col("part_no") * shape.part)
    covered = (
        decided.filter("done")
        .select("t1", "t2", (F.col("front") - (shape.block - 1)).alias("lo"), (F.col("front") + shape.threshold).alias("hi"))
        .unionByName(
            decided_parts.filter("done AND NOT settled").select(
                "t1", "t2", (F.col("front") - size + 1).alias("lo"), (F.col("front") + shape.threshold).alias("hi")
            )
        )
        .unionByName(last.select("t1", "t2", F.col("front").alias("lo"), (F.col("front") + shape.threshold).alias("hi")))
    )
    lists = covered.groupBy("t1", "t2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return lists.mapInArrow(_merge_spans, SPANS)


def _cut(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes(batch.column("body"))
            out: list[tuple[int, int, int, str]] = []
            for r, (copied, spans) in enumerate(zip(batch.column("copied").to_pylist(), batch.column("spans"), strict=True)):
                body = data[offsets[r] : offsets[r + 1]]
                n = len(body)
                if copied and n >= threshold:
                    lo, hi = np.array([0]), np.array([n])
                elif spans.is_valid:
                    lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
                else:
                    lo = hi = np.zeros(0, np.int64)
                digest, at = hashlib.sha256(), 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(body[at:a].tobytes())
                    at = b
                digest.update(body[at:].tobytes())
                out.append((n, int((hi - lo).sum()), len(lo), digest.hexdigest()))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            long = lambda v: pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), long(n), long(removed), long(spans), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, threshold: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per document."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    shape = Shape(threshold)
    texts = _texts(docs)
    grouped = texts.select("t1", "t2", "doc_id").groupBy("t1", "t2")
    groups = stored(grouped.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "text-names")
    spans = repeated_spans(texts, groups, shape)
    copies = groups.filter("copies > 1").select("t1", "t2", F.lit(True).alias("copied"))
    found = stored(spans.join(copies, ["t1", "t2"], "full").withColumn("copied", F.coalesce("copied", F.lit(False))), "found-spans")
    slim = F.when(~F.col("copied"), F.col("spans")).alias("spans")
    found = found.select("t1", "t2", "copied", slim)
    marked_texts = _holders(found, texts)
    kind = "array<struct<lo: bigint, hi: bigint>>"
    others = marked_texts.filter("NOT may_hold").select("doc_id", "body", F.lit(False).alias("copied"), F.lit(None).cast(kind).alias("spans"))
    holding = marked_texts.filter("may_hold").join(found.hint("merge"), ["t1", "t2"], "left")
    holding = holding.select("doc_id", "body", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    return holding.unionByName(others).mapInArrow(_cut(threshold), RESULT)
