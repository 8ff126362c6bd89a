import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm import conversation_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            signed = [int.from_bytes(mark[i : i + 8], "big", signed=True) for i in (0, 8)]
            own.setdefault(c, []).append(((turn is not None, turn or 0, *signed), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        donor = c - (c % 20 if c >= 0 else -(-c % 20))
        h = 0 if donor == c else zlib.crc32(str(c).encode()) % 4
        whole = own.get(donor, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if q) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c, n in sorted(who) if n == len(path))
        parent = min(members[path[:-1]])[0] if path else None
        out.append((min(who)[0], len(path), parent, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, deep=6):
    rng = random.Random(seed)
    said = ["hello there", "how are you", "a b c", "", None, "long answer " * 9]
    rows = []
    for c in rng.sample(range(-30, 200), n):
        for t in range(rng.randrange(1, deep)):
            rows.append((c, t, ["user", "assistant", None][t % 2 + (rng.random() < 0.05)], rng.choice(said[: 2 + c % 5])))
    return rows


@pytest.fixture
def make(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, ROWS).repartition(parts)


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 120), (3, 15)])
def test_matches_brute_force(make, rows, seed, n):
    data = made(seed, n)
    assert rows(trie.build_trie(make(data)).select(COLUMNS)) == brute(data)


def test_odd_rows(make, rows):
    data = made(4, 40) + [(None, 1, "user", "x"), (300, None, None, None), (300, None, "user", "first"), (300, 1, "user", "same")]
    data += [(300, 1, "user", "same"), (301, 5, "user", "tie b"), (301, 5, "user", "tie a"), (340, 0, "user", "w " * 20000), (341, 0, "user", "w " * 20000)]
    data += [(320, t, "user", f"turn {t}") for t in range(60)] + [(c, t, "user", f"turn {t}") for c in (321, 322) for t in range(58)]
    assert rows(trie.build_trie(make(data)).select(COLUMNS)) == brute(data)


def test_empty_and_clashing_names(make, rows):
    assert rows(trie.build_trie(make([]))) == []
    data = made(5, 20)
    clash = make(data).withColumns({c: F.lit("1") for c in ("conv", "depth", "h1", "words", "p1", "part", "at", "row")})
    assert rows(trie.build_trie(clash).select(COLUMNS)) == brute(data)


def test_a_crowded_sketch_changes_nothing(make, rows, monkeypatch):
    data = made(6, 50)
    monkeypatch.setattr(trie, "build", lambda slots, size: np.full(size >> 3, 255, np.uint8))
    assert rows(trie.build_trie(make(data)).select(COLUMNS)) == brute(data)


def test_half_wrong_sketch_changes_nothing(make, rows, monkeypatch):
    data = made(7, 80)
    real = trie.build
    monkeypatch.setattr(trie, "build", lambda slots, size: real(slots, size) | np.resize(np.array([170, 15, 255, 0], np.uint8), size >> 3))
    assert rows(trie.build_trie(make(data)).select(COLUMNS)) == brute(data)


def test_only_possibly_shared_prefixes_are_grouped(make):
    data = [(c, t, "user", "open" if t == 0 else f"{c} {t}") for c in range(0, 2000, 20) for t in range(6)]
    screened = trie.screen(trie.prefixes(make(data), 20, 4))
    assert screened.filter("depth > 1 AND shared").count() < 10
    assert screened.filter("depth = 1 AND NOT shared").count() == 0


def test_one_conversation_over_many_partitions(spark, make, rows):
    data = [(40, t, "user", f"t{t}") for t in range(300)] + [(41, t, "user", f"t{t}") for t in range(250)] + made(8, 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(trie.build_trie(make(data, 5)).select(COLUMNS)) == brute(data)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
