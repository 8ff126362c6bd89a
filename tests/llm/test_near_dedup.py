import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm.near_dedup import components, near_duplicates, shingles, signatures

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.setdefault(i, []).append(
            frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
        )
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, held in sets.items() for s in held if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            if top(i) != top(j) and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return sorted((i, len(sets[i][0]), top(i), top(i) == i) for i, *_ in rows)


def mutated(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(40)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """Clusters whose smallest document is itself a copy, chains, exact copies, shared passages, strangers."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    draw = lambda n: rng.choices(vocabulary, k=n)
    texts = []
    for _ in range(3):
        base = draw(110)
        texts += [mutated(rng, base, rng.randint(0, 6)) for _ in range(60)] + [" ".join(base)] * 3
    chain = draw(400)
    for _ in range(8):
        texts.append(" ".join(chain))
        for at in rng.sample(range(400), 5):
            chain[at] = rng.choice(vocabulary)
    passage = draw(60)
    texts += [" ".join(passage + draw(rng.randint(20, 200))) for _ in range(40)]
    texts += [" ".join(draw(rng.randint(1, 300))) for _ in range(60)]
    texts += ["one two", "One TWO", "one two three", None, "", " \n", "Same Five Words Right Here", "same five words right here"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_matches_brute_force(make_docs, corpus, rows):
    assert rows(near_duplicates(make_docs(corpus))) == sorted(brute(corpus), key=repr)


def test_complete_without_star_rounds(make_docs, corpus, rows):
    """The block comparison alone, with small blocks, finds every link too."""
    assert rows(near_duplicates(make_docs(corpus), star_rounds=1, block=8)) == sorted(brute(corpus), key=repr)


def test_odd_rows(make_docs, odd_rows):
    got = near_duplicates(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    known = [r for r in odd_rows if r[0] is not None]
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute(known)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {20, None}


def test_rows_of_one_id_keep_all_their_links(make_docs, rows):
    """An id with several texts joins the groups of all of them, in any order of rows."""
    first, second = ([f"{c}{i}" for i in range(60)] for c in "pq")
    a, b = " ".join(first), " ".join(second)
    near = lambda words, end: " ".join([*words[:-1], end])
    every = [(1, a), (5, near(first, "x")), (5, b), (3, near(second, "y")), (7, b), (9, "alone here"), (9, "alone there"), (8, "alone there")]
    for held in (every, every[::-1]):
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(make_docs(held)).collect()}
        assert got == {(1, 1, True), (3, 1, False), (5, 1, False), (7, 1, False), (8, 8, True), (9, 8, False)}
        sizes = sorted(r["n_shingles"] for r in near_duplicates(make_docs(held), star_rounds=1, block=2).collect())
        assert sizes == [1, 1, 1, 56, 56, 56, 56, 56]


def test_empty_and_clashing_names(make_docs, corpus, rows):
    assert near_duplicates(make_docs([])).count() == 0
    clash = make_docs(corpus[:60]).withColumns({c: F.lit(1) for c in ("bands", "digest", "id", "component", "bucket")})
    assert rows(near_duplicates(clash)) == sorted(brute(corpus[:60]), key=repr)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 50), (100, 60), (60, 70)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((50, 60, 70, 100), 50)}


def test_coordinates_collide_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    hits = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:450]), np.sort(pool[150:600])  # two thirds of either are shared: 300 of 600
        one, two = signatures([a, b], bands=128, rows=1)
        hits.append((one == two).mean())
    assert abs(np.mean(hits) - 0.5) < 0.02 and 0.02 < np.std(hits) < 0.07


def test_shingles_of_a_long_text():
    text = " ".join(f"x{i % 997}" for i in range(200_000))
    assert len(shingles(text)) == 997
