"""The prefix trie of conversations.

A node is a distinct sequence of first turns. Every turn becomes two 64-bit hashes of
its depth, role and text; a prefix is named by the exclusive or of its turns' hashes
and its depth, so names are running aggregates, and a conversation of any length is
spread over tasks (range partitions of conversation and turn).

Count-min screening: prefix names are counted into the cells of LANES hash rows.
Where one of a prefix's cells holds one count, its estimate is one, and since the
sketch never underestimates, the prefix proves a singleton: its node, a tail of one
conversation, is emitted where the row is, without a shuffle. Only prefixes whose
every cell was hit twice, possibly shared, are shuffled and grouped by their whole
name. The tasks get one bit per cell (hit twice or not), at most LANES * 2**max_bits
bits; a crowded sketch sends more prefixes to the grouping and changes no result.

Sums over subtrees need no walk: a node belongs to its smallest member, so every
conversation owns a chain of nodes, and what a chain holds is added to all nodes that
the conversation is a member of, less the part of the owner's chain above the node.
The list of ends of a node is digested in order from sorted chunks, as a stream, since
SHA-256 has no other way; one chunk holds up to CHUNK_IDS ids.

Defined results: rows without a conversation id belong to none and are left out; a
null role or text is empty; null turns come first, and rows of one turn follow their
digests; repeated rows are turns of their own; texts are read whole; a conversation
whose donor is absent starts with none of its turns; ids are divided as by truncation,
so negative ids have a negative remainder; an empty table gives no rows. Only conv_id,
turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.bitmaps import bits_for, build, marked
from factledger.llm.common import WORD, stored, whole
from factledger.operators.joins import broadcast_if_small
from factledger.operators.ranking import running_total
from factledger.session import cut_lineage

LANES = 3
MAX_BITS = 26
CHUNK_IDS = 1 << 16
NAME = ["depth", "p1", "p2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, two halves of the turn's digest and its words; texts go no further."""
    role, text = whole("role"), whole("text")
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        sha.alias("_sha"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    half = lambda at: F.conv(F.substring("_sha", at, 16), 16, -10).cast("bigint")
    named = rows.filter("conv IS NOT NULL").select("conv", "turn", half(1).alias("h1"), half(17).alias("h2"), "words")
    # the row's own number only spreads repeated rows over range partitions
    return stored(named.withColumn("row", F.monotonically_increasing_id()), "turns")


def _tags(depth: Column, h1: Column, h2: Column) -> list[Column]:
    """Two hashes of a turn at its depth."""
    return [F.xxhash64(depth, h1, h2), F.xxhash64(h2, F.lit(1), depth, h1)]


def prefixes(conversations: DataFrame, group: int, heads: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv, depth, size (all turns), p1, p2, its parent's q1, q2, words.

    A rebuilt conversation starts with the first ``crc32(id) % heads`` turns of the
    conversation ``id - id % group``. Conversations without turns have one row of depth 0.
    """
    order = ["turn", "h1", "h2", "row"]
    placed = _turns(conversations).repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    placed = cut_lineage(placed.select("conv", "h1", "h2", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = stored(placed.groupBy("conv", "part").agg(F.count("*").alias("here"), F.min("at").alias("first_at")), "turn-parts")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns(
        {"before": F.coalesce(F.sum("here").over(earlier), F.lit(0)), "total": F.sum("here").over(Window.partitionBy("conv"))}
    )

    # the first turns of donors: at most heads - 1 a conversation
    position = F.col("at") - F.col("first_at") + F.col("before") + 1
    donors = held.filter(f"conv % {group} = 0 AND before < {heads - 1}")
    openings = (
        placed.filter(f"conv % {group} = 0")
        .join(donors, ["conv", "part"])
        .withColumn("position", position)
        .filter(F.col("position") < heads)
        .groupBy(F.col("conv").alias("donor"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "h1", "h2", "words"))).alias("opening"))
    )
    conv = F.col("conv")
    own = F.when(conv % group == 0, F.lit(0)).otherwise(F.crc32(conv.cast("string").cast("binary")) % heads).cast("int")
    known = held.groupBy("conv").agg(F.max("total").alias("total")).withColumns({"skip": own, "donor": conv - conv % group})
    turn = "struct<position: bigint, h1: bigint, h2: bigint, words: bigint>"
    given = F.coalesce(F.col("opening"), F.array().cast(f"array<{turn}>"))
    known = known.join(openings, "donor", "left").withColumn("opening", F.slice(given, F.lit(1), F.col("skip")))
    size = F.size("opening") + F.greatest(F.col("total") - F.col("skip"), F.lit(0))
    known = known.select("conv", "skip", "total", "opening", size.cast("bigint").alias("size"), F.size("opening").alias("given"))

    def tag(lane: int) -> Column:
        return F.transform("opening", lambda t: _tags(t.position, t.h1, t.h2)[lane])

    def folded(tags: Column) -> Column:
        return F.aggregate(tags, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))

    known = stored(known.withColumns({"g1": tag(0), "g2": tag(1)}), "conversations")

    # own turns: names run inside (conversation, part); parts of one conversation are joined below
    starts = held.join(
        known.select("conv", "skip", "size", "given", folded(F.col("g1")).alias("x1"), folded(F.col("g2")).alias("x2")), "conv"
    )
    rows = placed.join(starts, ["conv", "part"]).withColumn("position", position)
    depth = (F.col("position") - F.col("skip") + F.col("given")).cast("bigint")
    rows = rows.filter("position > skip").withColumn("depth", depth)
    rows = rows.withColumns(dict(zip(("g1", "g2"), _tags(F.col("depth"), F.col("h1"), F.col("h2")), strict=True)))
    so_far = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = {f"p{i}": F.bit_xor(f"g{i}").over(so_far).bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    rows = stored(rows.withColumns(run).select("conv", "part", "depth", "size", "g1", "g2", "p1", "p2", "words"), "own-turns")
    # only a conversation that lies across range partitions needs its parts' names: at most two rows a partition
    spread = held.filter("total > here")
    parts = rows.join(F.broadcast(spread.select("conv", "part")), ["conv", "part"], "left_semi")
    parts = parts.groupBy("conv", "part").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    parts = parts.select("conv", "part", *[F.bit_xor(f"g{i}").over(earlier).alias(f"s{i}") for i in (1, 2)])
    joined = rows.join(F.broadcast(parts), ["conv", "part"], "left")
    for i in (1, 2):
        joined = joined.withColumn(f"p{i}", F.col(f"p{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0).cast("bigint"))))
    parents = [F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"q{i}") for i in (1, 2)]
    mine = joined.select("conv", "depth", "size", "p1", "p2", *parents, "words")

    opened = known.filter("given > 0").select("conv", "size", "opening", "g1", "g2", F.posexplode("opening").alias("i", "t"))
    upto = [folded(F.slice(f"g{i}", F.lit(1), F.col("i") + 1)) for i in (1, 2)]
    above = [folded(F.slice(f"g{i}", F.lit(1), F.col("i"))) for i in (1, 2)]
    theirs = opened.select(
        "conv", (F.col("i") + 1).cast("bigint").alias("depth"), "size", upto[0].alias("p1"), upto[1].alias("p2"),
        above[0].alias("q1"), above[1].alias("q2"), F.col("t.words").alias("words"),
    )
    zero = F.lit(0).cast("bigint")
    roots = known.select(
        "conv", zero.alias("depth"), "size", zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("bigint").alias("q1"),
        F.lit(None).cast("bigint").alias("q2"), zero.alias("words"),
    )
    return mine.unionByName(theirs).unionByName(roots)


def _cells(p1: Column, p2: Column, depth: Column, bits: int) -> Column:
    """The prefix's cell in every lane, all lanes in one row of cells."""
    lanes = [F.shiftrightunsigned(F.xxhash64(F.lit(i), p1, p2, depth), 64 - bits) + F.lit(i << bits) for i in range(LANES)]
    return F.array(*lanes)


def screen(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with ``shared`` (the prefix may be shared) and ``under_shared`` (its parent may be); roots are shared."""
    spark = rows.sparkSession
    named = rows.filter("depth > 0")
    bits = bits_for(4 * named.count(), max_bits)
    cells = named.select(F.explode(_cells(F.col("p1"), F.col("p2"), F.col("depth"), bits)).alias("slot"))
    twice = cells.groupBy("slot").count().filter("count > 1").select("slot")
    sent = spark.sparkContext.broadcast(build(twice, LANES << bits))

    @F.pandas_udf("boolean")
    def hit_twice(cells: pd.Series) -> pd.Series:
        flat = np.concatenate(cells.to_numpy()) if len(cells) else np.zeros(0, np.int64)
        return pd.Series(marked(sent.value, flat).reshape(-1, LANES).all(axis=1))

    own = hit_twice(_cells(F.col("p1"), F.col("p2"), F.col("depth"), bits))
    parent = hit_twice(_cells(F.coalesce("q1", F.lit(0)), F.coalesce("q2", F.lit(0)), F.col("depth") - 1, bits))
    marks = rows.withColumns({"shared": own, "under_shared": parent})
    return marks.withColumns({"shared": F.col("shared") | (F.col("depth") == 0), "under_shared": F.col("under_shared") | (F.col("depth") == 1)})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, sorted, as comma-joined text."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_IDS):
            part = batch.slice(at, CHUNK_IDS)
            key = np.stack([part.column(c).to_numpy() for c in NAME])
            conv = part.column("conv").to_numpy()
            begins = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(conv) else []
            ends = np.append(begins[1:], len(conv)) if len(conv) else []
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(begins, ends, strict=True)]
            first = part.take(pa.array(begins, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(first.column(c) for c in NAME), first.column("conv"), pa.array(text, pa.string())], [*NAME, "conv", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its chunks, which come in order."""
    now, digest, out = None, None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in NAME), strict=True))
        for key, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if digest:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(out) > 1 << 14:
            yield _digest_batch(out)
            out = []
    if digest:
        out.append((*now, digest.hexdigest()))
    yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NAME, "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each possibly shared node."""
    ending = rows.filter("depth = size").select(*NAME, "conv")
    sorted_ = ending.repartitionByRange(*NAME, "conv").sortWithinPartitions(*NAME, "conv")
    chunks = stored(sorted_.mapInArrow(_chunks, "depth bigint, p1 bigint, p2 bigint, conv bigint, ids string"), "ends")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "conv").mapInArrow(
        _digests, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string"
    )


def build_trie(conversations: DataFrame, group: int = 20, heads: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 per node."""
    rows = stored(prefixes(conversations, group, heads), "prefixes")
    screened = stored(screen(rows, max_bits), "screened")
    shared, tails = screened.filter("shared"), screened.filter("NOT shared")

    groups = shared.groupBy(*NAME).agg(
        F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2")
    )
    groups = stored(groups.withColumn("value", (F.col("n") - 1) * F.col("words")), "trie-groups")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    tops = tails.filter("under_shared")
    below = groups.filter("depth > 0").select(*parent).unionByName(tops.select(*parent))
    children = below.groupBy(*NAME).agg(F.count("*").alias("n_children"))
    nodes = stored(groups.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # what each conversation's chain brings to the nodes it is a member of
    none = F.lit(0).cast("bigint")
    chains = (
        nodes.select(F.col("rep").alias("conv"), F.col("value").alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaves"))
        .unionByName(tails.filter("depth = size").select("conv", none.alias("saved"), F.lit(1).cast("bigint").alias("leaves")))
        .groupBy("conv")
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    chains = stored(chains, "chains")
    brought = shared.select(*NAME, "conv").join(broadcast_if_small(chains), "conv")
    sums = brought.groupBy(*NAME).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    running = running_total(nodes, ["rep"], ["depth"], "value", "upto")
    owned = running.join(sums, NAME)

    names = stored(nodes.select(*[F.col(c).alias(f"_{c}") for c in NAME], F.col("rep").alias("parent_rep")), "trie-names")
    is_parent = (F.col("depth") - 1 == F.col("_depth")) & (F.col("q1") == F.col("_p1")) & (F.col("q2") == F.col("_p2"))
    sent = broadcast_if_small(names)
    exact = owned.join(sent, is_parent, "left").join(_ends(shared), NAME, "left")
    out = exact.select(
        F.col("rep").alias("conv_id"),
        "depth",
        # a parent outside the groups is a tail of the same conversation
        F.when(F.col("depth") > 0, F.coalesce("parent_rep", "rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("upto") - F.col("value"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    last = F.col("depth") == F.col("size")

    def tail(df: DataFrame, parent_conv: Column) -> DataFrame:
        return df.select(
            F.col("conv").alias("conv_id"),
            "depth",
            parent_conv.alias("parent_conv_id"),
            F.lit(1).cast("bigint").alias("n_convs"),
            (~last).cast("bigint").alias("n_children"),
            F.lit(1).cast("bigint").alias("n_leaves"),
            none.alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"),
        )

    topped = tops.join(sent, is_parent, "left")
    return out.unionByName(tail(topped, F.coalesce("parent_rep", "conv"))).unionByName(
        tail(tails.filter("NOT under_shared"), F.col("conv"))
    )

