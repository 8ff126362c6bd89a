import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factledger.llm import position_blocks, repeated_spans
from factledger.llm.position_blocks import Names, Shape, blocks, pieces


def brute(rows, threshold):
    bodies = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for at, (_, b) in enumerate(bodies):
        for s in range(len(b) - threshold + 1):
            seen.setdefault(b[s : s + threshold], []).append((at, s))
    gone = [np.zeros(len(b), bool) for _, b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for at, s in places:
                gone[at][s : s + threshold] = True
    out = []
    for (i, b), g in zip(bodies, gone, strict=True):
        spans = int((np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def planted(seed, threshold, n=60):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdefghij é", k=k))
    passages = [letters(rng.randrange(threshold // 2, threshold * 3)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                cut = rng.randrange(len(p))
                p = p[:cut] + rng.choice(["", "x", "yz"]) + p[cut + rng.randrange(3) :]
            parts += [letters(rng.randrange(0, threshold)), p]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 200), (2, 200), (3, 20), (4, 37), (5, 64), (6, 8)])
def test_matches_brute_force(make_docs, rows, seed, threshold):
    data = planted(seed, threshold)
    assert rows(repeated_spans.remove_repeats(make_docs(data), threshold)) == brute(data, threshold)


def test_odd_rows(make_docs, odd_rows, rows):
    data = odd_rows + [(60, "a" * 900), (61, "a" * 199), (62, "a" * 200), (63, "ab" * 150), (64, "€" * 400), (65, "z" * 201)]
    assert rows(repeated_spans.remove_repeats(make_docs(data))) == brute(data, 200)


def test_empty_short_and_clashing_names(make_docs, rows):
    assert rows(repeated_spans.remove_repeats(make_docs([]))) == []
    short = [(1, "a b"), (2, None), (3, ""), (None, "a b")]
    assert rows(repeated_spans.remove_repeats(make_docs(short))) == brute(short, 200)
    data = planted(7, 40, 30)
    clash = make_docs(data).withColumns({c: F.lit(1) for c in ("body", "t1", "t2", "front", "rank", "name", "done", "spans")})
    assert rows(repeated_spans.remove_repeats(clash, 40)) == brute(data, 40)


def test_long_texts_in_pieces(make_docs, rows, monkeypatch):
    monkeypatch.setattr(position_blocks, "PIECE", 700)
    data = planted(8, 50, 25)
    long_ = "".join(t for _, t in data)
    data += [(100, long_), (101, long_[1000:6000] + "end"), (102, "q" * 3000)]
    shape = Shape(50)
    bodies = [t.encode() for _, t in data]
    offsets = np.cumsum([0, *map(len, bodies)])
    starts = []
    for piece in pieces(offsets, np.frombuffer(b"".join(bodies), np.uint8), shape):
        found = blocks(piece, Names(piece.data), shape)
        for t, f, lo, hi in zip(found.text, found.front, found.low, found.high, strict=True):
            starts += [(int(piece.row[t]), int(f - i + piece.shift[t])) for i in range(lo, hi + 1)]
    assert sorted(starts) == [(r, s) for r, b in enumerate(bodies) for s in range(len(b) - 49)]
    assert rows(repeated_spans.remove_repeats(make_docs(data), 50)) == brute(data, 50)


def test_a_full_bitmap_changes_nothing(make_docs, rows, monkeypatch):
    data = planted(9, 60)
    monkeypatch.setattr(repeated_spans, "build", lambda slots, size: np.full(size >> 3, 255, np.uint8))
    assert rows(repeated_spans.remove_repeats(make_docs(data), 60)) == brute(data, 60)


def test_equal_windows_stand_at_the_same_place_of_their_blocks():
    rng = np.random.default_rng(1)
    shape = Shape(200)
    shared = rng.integers(97, 101, 260, dtype=np.uint8)
    bodies = [np.concatenate([rng.integers(97, 101, n, dtype=np.uint8), shared, rng.integers(97, 101, n, dtype=np.uint8)]) for n in (0, 500, 77)]
    offsets = np.cumsum([0, *map(len, bodies)])
    place = {}
    for piece in pieces(offsets, np.concatenate(bodies), shape):
        found = blocks(piece, Names(piece.data), shape)
        for t, f, lo, hi in zip(found.text, found.front, found.low, found.high, strict=True):
            for i in range(lo, hi + 1):
                place[int(piece.row[t]), int(f - i + piece.shift[t])] = (int(f) - (int(f) - i), i)
    for s in range(61):
        assert len({place[0, s][1], place[1, 500 + s][1], place[2, 77 + s][1]}) == 1


def test_open_blocks_are_cut_into_parts_some_at_a_time(monkeypatch):
    shape, n = Shape(200), 30
    side, rng = shape.block - 1, np.random.default_rng(6)
    number = lambda v: pa.array(np.full(n, v, np.int32))
    long = lambda: pa.array(rng.integers(0, 1 << 40, n))
    edge = pa.array([rng.bytes(2 * side) for _ in range(n)], pa.binary())
    columns = [long(), long(), long(), number(3), number(side - 5), long(), pa.array([False] * n), edge, number(side), number(side)]
    batch = pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in repeated_spans.EDGES.split(", ")])
    together = pa.Table.from_batches(repeated_spans._part_rows(shape)(iter([batch])))
    monkeypatch.setattr(repeated_spans, "PART_ROWS", 7)
    found = list(repeated_spans._part_rows(shape)(iter([batch, batch.slice(0, 0)])))
    assert len(found) == 5 and pa.Table.from_batches(found).to_pylist() == together.to_pylist()
