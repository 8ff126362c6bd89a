"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct shingles of five words (A-Z in lower case). One
permutation scatters the shingles, a second one, circularly shifted by 0, 1, 2, ...,
gives the coordinates of the signature: two permutations instead of hundreds. Bands
of eight coordinates make the buckets; with 48 bands a pair at the threshold of 0.85
is missed with a chance below 3 in 10 million, a closer pair far less often.

What shares a bucket is confirmed on the shingles of the whole texts, without
writing out the pairs of a bucket:

1. Documents with equal sets are one class. Classes get numbers of their own, so an id
   whose rows hold different texts is in several classes, which are linked at once.
2. Every class is compared with the lowest class of its buckets, then, where a
   bucket still holds several components, with its best linked class. Each round is
   at most one comparison per class, however large the bucket.
3. Buckets that then still hold several components are compared completely, but for
   pairs inside one component: the classes outside the bucket's largest component
   against all, block by block, and set sizes alone rule out most pairs of strangers.
   So no link between different components is lost.

Components take the smallest id of their documents. Defined results: a null text, or one without a word,
has an empty set and is linked with nothing; a text of fewer than five words is one
shingle; rows that share an id are one document, whose links are those of all its
texts (a row without a word stays alone even then); rows with a null id are grouped
through the ids of equal texts and are linked with nothing else; an empty table gives
no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import row_bytes, small_batches, stored
from factledger.operators.joins import broadcast_if_small

SHINGLE = 5
BANDS = 48
ROWS = 8
THRESHOLD = 85  # per hundred
STAR_ROUNDS = 2
BLOCK = 256
CHUNK = 1 << 16
SIGNATURE = "struct<n_shingles: long, digest: binary, bands: array<bigint>>"
LINK = "a bigint, b bigint"

_POWER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The document's set as sorted 64-bit hashes."""
    words = row_bytes(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _POWER + hashed[i : i + len(out)]
    return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes of non-empty sets, one row per set."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    # the first permutation of the 32-bit universe
    at = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = at ^ (at >> np.uint32(16))
    at *= np.uint32(0x7FEB352D)
    at ^= at >> np.uint32(15)
    moved, shifted = np.empty_like(at), np.empty_like(at)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        held = np.full(len(sets), band + 1, np.uint64)
        for row in range(rows):
            # the second permutation, shifted by one more place for every coordinate
            np.subtract(at, np.uint32(band * rows + row), out=moved)
            moved *= np.uint32(0x846CA68B)
            np.right_shift(moved, np.uint32(15), out=shifted)
            moved ^= shifted
            moved *= np.uint32(0x9E3779B1)
            held = held * _POWER + np.minimum.reduceat(moved, starts)
        out[:, band] = _mix(held)
    return out.view(np.int64)


def _signed(texts: pd.Series) -> pd.DataFrame:
    out: list[tuple] = []
    sets: list[np.ndarray] = []
    places: list[int] = []

    def flush() -> None:
        for place, bands in zip(places, signatures(sets) if sets else (), strict=True):
            out[place] = (*out[place][:2], bands)
        sets.clear()
        places.clear()

    held = 0
    for text in texts:
        found = shingles(text)
        out.append((len(found), blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None, None))
        if len(found):
            sets.append(found)
            places.append(len(out) - 1)
            held += len(found)
        if held >= CHUNK:
            flush()
            held = 0
    flush()
    return pd.DataFrame(out, columns=["n_shingles", "digest", "bands"])


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * intersection >= threshold * union."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    joined = np.concatenate([a, b])
    joined.sort()
    both = int((joined[1:] == joined[:-1]).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirm(threshold: int):
    def confirm(ids: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        """Whether two texts are linked; rows of one hub mostly follow each other, so its set is kept."""
        out, last, hub = [], None, None
        for number, a, b in zip(ids, first, second, strict=True):
            if number != last:
                last, hub = number, shingles(a)
            out.append(similar(hub, shingles(b), threshold))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(confirm, "boolean")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are linked. ``texts``: one (id, text) per class."""
    of_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(of_b, "b").join(of_a, "a")
    return joined.filter(_confirm(threshold)("a", "text_a", "text_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """The smallest reachable node of every node that has a link: node, component.

    Labels go along the links and then jump to their label's label, so that long
    chains halve in every round. Each round is written, and ends when no label changes.
    """
    edges = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "edges",
    )
    labels = stored(
        edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "component"), "other")
        low = near.groupBy("node").agg(F.min("component").alias("low"))
        step = labels.join(low, "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = stored(
            step.join(target, "component").select("node", F.least("component", "next").alias("component"), "was"), "labels"
        )
        if jumped.filter("component <> was").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")


def _compared(threshold: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the outsiders of one block and the members of another, other than inside a component."""
        sets = {}
        bands = np.stack([np.asarray(b) for b in rows["bands"]])
        ids, comps = rows["id"].to_numpy(), rows["component"].to_numpy().copy()
        asks, bucket, outside = rows["asks"].to_numpy(), rows["bucket"].iloc[0], rows["outside"].to_numpy()
        texts, sizes = rows["text"].to_numpy(), rows["n_shingles"].to_numpy()
        members = np.flatnonzero(~asks)
        out = []
        for i in np.flatnonzero(asks):
            band = int(next(iter(np.flatnonzero(bands[i] == bucket)), 0))
            met = (bands[members, :band] == bands[i, :band]).any(axis=1)
            twice = outside[members] & (ids[members] <= ids[i])
            near = 100 * np.minimum(sizes[members], sizes[i]) >= threshold * np.maximum(sizes[members], sizes[i])
            for j in members[~met & ~twice & near & (comps[members] != comps[i])]:
                if comps[j] == comps[i]:
                    continue
                for k in (i, j):
                    if ids[k] not in sets:
                        sets[ids[k]] = shingles(texts[k])
                if similar(sets[ids[i]], sets[ids[j]], threshold):
                    out.append((ids[i], ids[j]))
                    comps[comps == comps[j]] = comps[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return compare


def _with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold several components, with theirs."""
    if labels is None:
        held = members.withColumn("component", F.col("id"))
    else:
        held = members.join(labels.withColumnRenamed("node", "id"), "id", "left")
        held = held.withColumn("component", F.coalesce("component", "id"))
    held = stored(held, "bucket-members")
    mixed = held.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return held.join(mixed.filter("_low < _high").select("bucket"), "bucket", "left_semi")


def _star_pairs(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Per class one pair with a hub of its buckets: the lowest class at first, the best linked one later."""
    if links is None:
        degrees = members.withColumn("degree", F.lit(0).cast("bigint"))
    else:
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
        degrees = members.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left")
        degrees = degrees.withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = F.struct((-F.col("degree")).alias("order"), F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    hubs = degrees.groupBy("bucket").agg(F.min(place).alias("best"))
    met = members.join(hubs, "bucket").filter(F.col("component") != F.col("best.hub_component"))
    best = met.groupBy("id").agg(F.min("best").alias("best"))
    return best.select(F.col("best.hub").alias("a"), F.col("id").alias("b"))


def _rest(members: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int, block: int) -> DataFrame:
    """All remaining links between components inside one bucket."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    held = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", (-F.col("component")).alias("back"))).alias("top"), F.sum("n").alias("members")
    )
    held = held.select(
        "bucket",
        (-F.col("top.back")).alias("main"),
        F.ceil(F.col("members") / block).alias("member_blocks"),
        F.ceil((F.col("members") - F.col("top.n")) / block).alias("outside_blocks"),
    )
    rows = members.join(held, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    spot = F.xxhash64("id")
    columns = ["bucket", "id", "component", "outside"]
    asking = rows.filter("outside").select(
        *columns,
        F.lit(True).alias("asks"),
        F.pmod(spot, "outside_blocks").alias("ask_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("member_blocks") - 1)).alias("member_block"),
    )
    asked = rows.select(
        *columns,
        F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outside_blocks") - 1)).alias("ask_block"),
        F.pmod(spot, "member_blocks").alias("member_block"),
    )
    placed = asking.unionByName(asked).join(classes.select("id", "bands", "n_shingles"), "id").join(texts, "id")
    groups = placed.groupBy("bucket", "ask_block", "member_block")
    return groups.applyInPandas(_compared(threshold), LINK).distinct()


def _same_document(signed: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one id: each with the lowest of them."""
    held = signed.join(repeated, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
    held = stored(held.select("doc_id", "id").distinct(), "classes-of-ids")
    lowest = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return held.join(lowest, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _class_texts(rows: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """One (id, text) per class of ``wanted`` (id, doc_id, digest); rows of an id with several are told apart by digest."""
    wanted = broadcast_if_small(wanted)
    single = rows.join(repeated, "doc_id", "left_anti").join(wanted, "doc_id").select("id", "text")
    digest = F.pandas_udf(_signed, SIGNATURE)("text")["digest"]
    several = rows.join(repeated, "doc_id", "left_semi").withColumn("digest", digest).join(wanted, ["doc_id", "digest"])
    return single.unionByName(several.select("id", "text")).groupBy("id").agg(F.first("text").alias("text"))


def near_duplicates(
    docs: DataFrame, threshold: int = THRESHOLD, star_rounds: int = STAR_ROUNDS, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = rows.select("doc_id", F.pandas_udf(_signed, SIGNATURE)("text").alias("s")).select("doc_id", "s.*")
    signed = stored(signed, "signatures")

    repeated = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = broadcast_if_small(stored(repeated.select("doc_id"), "repeated-ids"))
    grouped = signed.filter("digest IS NOT NULL").groupBy("digest", "n_shingles")
    classes = grouped.agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).filter("doc_id IS NOT NULL")
    # written, so a class keeps its number
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "set-classes")
    band_rows = classes.select(F.explode("bands").alias("bucket"), "id")
    full = band_rows.groupBy("bucket").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high")
    members = stored(band_rows.join(full.select("bucket"), "bucket", "left_semi").distinct(), "buckets")

    links, labels = None, None
    if not repeated.isEmpty():
        links = stored(_same_document(signed, classes, repeated), "links")
        if not links.isEmpty():
            labels = components(links)
    if not members.isEmpty():
        found = members.select("id").distinct()
        wanted = stored(classes.join(found, "id", "left_semi").select("id", "doc_id", "digest"), "bucket-classes")
        texts = stored(_class_texts(rows, wanted, repeated), "bucket-texts")
        tried = None
        for _ in range(star_rounds):
            open_ = _with_components(members, labels)
            pairs = _star_pairs(open_, links)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stored(pairs, "star-pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = stored(confirmed(pairs, texts, threshold), "links")
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        rest = stored(_rest(_with_components(members, labels), classes, texts, threshold, block), "links")
        if not rest.isEmpty():
            labels = components(links.unionByName(rest))

    of_class = classes.select("digest", "id", F.col("doc_id").alias("lowest"))
    if labels is None:
        of_class = of_class.withColumnRenamed("lowest", "component_id")
    else:
        linked = labels.join(of_class.select(F.col("id").alias("node"), "lowest"), "node")
        smallest = linked.groupBy("component").agg(F.min("lowest").alias("component_id"))
        linked = linked.join(smallest, "component").select(F.col("node").alias("id"), "component_id")
        of_class = of_class.join(linked, "id", "left").withColumn("component_id", F.coalesce("component_id", "lowest"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class.select("digest", "component_id"), "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
