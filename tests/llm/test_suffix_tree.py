import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factledger.llm import suffix_tree
from factledger.llm.suffix_tree import score_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def corpus():
    """Words that follow the two before them, so that contexts carry information."""
    rng = random.Random(8)
    follow = {}
    out = []
    for i in range(400):
        words = ["a", "b"]
        for _ in range(rng.randint(0, 60)):
            key = tuple(words[-2:])
            choices = follow.setdefault(key, rng.choices([f"V{k}" for k in range(12)], k=2))
            words.append(rng.choice(choices) if rng.random() < 0.9 else f"rare{rng.randrange(3000)}")
        out.append((i, " ".join(words)))
    return out + [(400, None), (401, ""), (402, " \n"), (403, "never seen Words"), out[5], (None, "a b")]


def base(rows):
    counts = Counter(t for i, text, *_ in rows if not held(i) for t in toks(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, *_ in rows:
        found = toks(text)
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        out.append((i, held(i), len(found), sum(counts[t] > 0 for t in found), n, score))
    return sorted(out, key=repr)


def same(got, wanted):
    got = sorted((tuple(r)[:6] for r in got), key=repr)
    assert len(got) == len(wanted)
    by = lambda r: (repr(r[:5]), r[5])
    for a, b in zip(sorted(got, key=by), sorted(wanted, key=by), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-8)


@pytest.mark.parametrize("word_share", [1e-6, 0.01, 2.0])
def test_base_figures_whatever_is_frequent(make_docs, corpus, word_share):
    same(score_documents(make_docs(corpus), word_share=word_share).collect(), base(corpus))


def test_odd_rows(make_docs, odd_rows):
    same(score_documents(make_docs(odd_rows)).collect(), base(odd_rows))


def test_contexts_predict_held_out_texts(make_docs, corpus):
    rows = [r for r in score_documents(make_docs(corpus)).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    flat = [r for r in score_documents(make_docs(corpus), depth=0).collect() if r["held_out"]]
    assert gain > 0.25 and all(r["score"] == pytest.approx(r["base_score"]) for r in flat)


def trained(spark, corpus, **settings):
    docs = spark.createDataFrame([(i, t) for i, t in corpus], "doc_id long, text string")
    counts = suffix_tree.word_counts(docs)
    top = counts.orderBy(F.desc("n"), "word").toPandas()
    words = top["word"].tolist()
    sent = spark.sparkContext.broadcast(words)
    encoded = docs.select(suffix_tree._encoder(sent)("text").alias("e")).select("e.*")
    return suffix_tree.learn(counts, encoded, words, top["n"].to_numpy(float), (int(top["n"].sum()), len(words)), **settings)


def test_counts_and_distributions(spark, corpus):
    tree = trained(spark, corpus)
    assert len(tree.levels) == 3 and any(level.stays.any() for level in tree.levels)
    texts = [[tree.words.index(t) for t in toks(text)] for _, text in corpus]
    for depth, level in enumerate(tree.levels, 1):
        for number in range(0, len(level.keys), 7):
            context = level.words[number].tolist()
            after = Counter(t[i] for t in texts for i in range(depth, len(t)) if t[i - depth : i] == context)
            assert sum(after.values()) == level.totals[number] >= suffix_tree.MIN_CONTEXT
            mine = level.entries // np.uint64(len(tree.words) + 1) == number
            found = dict(zip((level.entries[mine] % np.uint64(len(tree.words) + 1)).tolist(), level.counts[mine], strict=True))
            assert found == {w: n for w, n in after.items() if n >= suffix_tree.MIN_ENTRY}
    # every state's distribution over all words and the unseen one sums to one
    n = len(tree.words)
    p = tree.root()[:n]
    unseen = 0.1 / tree.whole
    assert p.sum() + unseen == pytest.approx(1)
    for level in tree.levels[:1]:
        for number in np.flatnonzero(level.stays)[:5]:
            q = tree.deeper(level, np.full(n, number), np.arange(n), p)
            assert q.sum() + level.rest[number] * unseen == pytest.approx(1)


def test_suffixes_of_a_state_are_states(spark, corpus):
    tree = trained(spark, corpus)
    for above, level in zip(tree.levels, tree.levels[1:], strict=False):
        parents = (level.keys[level.stays] // np.uint64(len(tree.words))).astype(int)
        assert above.stays[parents].all()
    none = trained(spark, corpus, penalty=1e9)
    assert not any(level.stays.any() for level in none.levels)


def test_empty_and_clashing_names(make_docs, corpus):
    assert score_documents(make_docs([])).count() == 0
    clash = make_docs(corpus).withColumns({c: F.lit(1) for c in ("codes", "rare", "word", "row", "held_out", "n")})
    same(score_documents(clash).collect(), base(corpus))


@pytest.mark.parametrize("word_share", [1e-8, 0.01, 2.0])
def test_scores_of_the_tables_are_those_of_the_tree(spark, make_docs, corpus, word_share):
    learned = [r for r in corpus if not held(r[0])]
    tree = trained(spark, learned)
    numbers = {w: i for i, w in enumerate(tree.words)}
    unseen = 0.1 / tree.whole
    wanted = []
    for i, text in corpus:
        found = toks(text)
        codes = np.array([numbers.get(t, len(numbers)) for t in found])
        p = np.where(codes < len(numbers), tree.root()[codes], unseen)
        for level, state in zip(tree.levels, tree.walk(codes, np.arange(len(codes))), strict=True):
            p = tree.deeper(level, state, codes, p)
        wanted.append((repr(i), float(np.log10(p).sum())))
    got = [(repr(r["doc_id"]), r["score"]) for r in score_documents(make_docs(corpus), word_share=word_share).collect()]
    assert [k for k, _ in sorted(got)] == [k for k, _ in sorted(wanted)]
    assert [s for _, s in sorted(got)] == pytest.approx([s for _, s in sorted(wanted)], abs=1e-7)


def test_counts_are_floors_at_any_corpus_size(make_docs):
    """A pair that 40 of 2.4 million tokens make up is learned: floors do not grow with the corpus."""
    filler = " ".join(f"w{k}" for k in range(3000))
    train = [i for i in range(1200) if not held(i)]
    rows = [(i, filler) for i in train[:800]] + [(i, "alpha omega") for i in train[800:840]]
    rows += [(i, "alpha omega") for i in range(1200) if held(i)][:1]
    (r,) = [r for r in score_documents(make_docs(rows)).collect() if r["held_out"]]
    assert r["score"] > r["base_score"] + 3


def test_many_buckets_give_the_same_scores(make_docs, corpus, monkeypatch):
    rows = lambda: sorted((repr(r["doc_id"]), r["n_known"], round(r["score"], 6)) for r in score_documents(make_docs(corpus), word_share=2.0).collect())
    one = rows()
    monkeypatch.setattr(suffix_tree, "BUCKET", 700)
    assert rows() == one


def test_a_counting_worker_gives_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", 1 << 12)
    codes = np.random.default_rng(5).integers(0, 300, 40_000)
    texts = [codes[at : at + 400] for at in range(0, len(codes), 400)]
    batches = [pd.DataFrame({"codes": [t.tobytes() for t in texts]})]
    all_marked = SimpleNamespace(value=np.full(1 << (suffix_tree.BITS - 3), 255, np.uint8))
    found = list(suffix_tree._counter(2, all_marked, 64)(iter(batches)))
    packed = ["keys", "contexts", "suffixes", "times"]
    assert len(found) > 10 and all(f[packed].map(len).to_numpy().sum() < 30_000 for f in found)
    got = {}
    for bucket, keys, *_, times in (row for f in found for row in f.itertuples(index=False)):
        for key, n in zip(suffix_tree._numbers(keys).tolist(), suffix_tree._numbers(times).tolist(), strict=True):
            assert key % 64 == bucket and key not in got
            got[key] = n
    wanted = Counter()
    for t in texts:
        context = suffix_tree._append(t[:-2], t[1:-1])
        wanted.update(suffix_tree._append(context, t[2:]).tolist())
    assert got == wanted
    tallied = list(suffix_tree._tally(iter(batches)))
    assert len(tallied) > 1 and dict(zip(pd.concat(tallied)["key"], pd.concat(tallied)["n"], strict=True)) == Counter(codes.tolist())


def encoded_pieces(texts, held_out):
    columns = {"doc_id": pa.array(range(len(texts))), "held_out": held_out, "text": texts, "row": pa.array(range(len(texts)))}
    halves = [pa.RecordBatch.from_pydict({c: v[at : at + 300] for c, v in columns.items()}) for at in range(0, len(texts), 300)]
    rows = pd.concat([b.to_pandas() for b in suffix_tree._encode(iter(halves))])
    return rows[rows["codes"].isna()], rows[rows["codes"].notna()]


def test_pieces_hold_all_tokens_in_few_bytes():
    rng = random.Random(4)
    texts = [" ".join(f"Word{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 400))) for _ in range(600)] + [None, "", " \n", "\x0bÄÖ y\x1cq  "]
    held_out = [i % 10 == 0 for i in range(len(texts))]
    rows, pieces = encoded_pieces(texts, held_out)
    assert rows["n_tokens"].tolist() == [len(toks(t)) for t in texts] and rows["held_out"].tolist() == held_out
    words, seen = {}, []
    for out in (False, True):
        for f in suffix_tree._unpacked(iter([pieces[pieces["held_out"] == out]])):
            for row, codes in f.itertuples(index=False):
                assert held_out[row] == out
                seen.append(row)
                digests = np.frombuffer(codes, np.int64).tolist()
                assert len(digests) == len(toks(texts[row]))
                assert all(words.setdefault(t, d) == d for t, d in zip(toks(texts[row]), digests, strict=True))
    assert sorted(seen) == list(range(len(texts))) and len(set(words.values())) == len(words)
    packed = [c for name in ("rows", "lengths", "words", "codes") for c in pieces[name]]
    zstd = pa.Codec("zstd")
    alone = sum(len(zstd.compress(np.array([words[t] for t in toks(text)]).tobytes(), asbytes=True)) for text in texts)
    assert sum(len(zstd.compress(c, asbytes=True)) for c in packed) < 0.6 * alone


def test_only_pairs_with_a_repeated_suffix_are_sent():
    codes = np.random.default_rng(6).integers(0, 60, 3000)
    codes = suffix_tree._append(codes, codes * 7919 << 40)  # spread over all slots
    bits = lambda keys: SimpleNamespace(value=suffix_bits(keys))

    def suffix_bits(keys):
        out = np.zeros(1 << suffix_tree.BITS, bool)
        out[np.asarray(keys, np.int64).view(np.uint64) >> np.uint64(64 - suffix_tree.BITS)] = True
        return np.packbits(out, bitorder="little")

    batch = pd.DataFrame({"codes": [codes.tobytes()]})
    pairs = Counter(suffix_tree._append(codes[:-1], codes[1:]).tolist())
    all_marked = SimpleNamespace(value=np.full(1 << (suffix_tree.BITS - 3), 255, np.uint8))
    often = bits([k for k, n in pairs.items() if n >= 2])

    def counted(*more):
        sent = pd.concat(suffix_tree._counter(2, all_marked, 4, *more)(iter([batch])))
        kept = pd.concat([suffix_tree._pair_sums(2)(rows) for _, rows in sent.groupby("bucket")])
        return sent["keys"].map(len).sum(), dict(zip(kept["key"], kept["n"], strict=True))

    whole, part = counted(), counted(often)
    assert part[1] == whole[1] and len(whole[1]) > 5 and part[0] < 0.8 * whole[0]


def test_keys_are_asked_for_after_states_only():
    codes = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, 2000)
    batch = pd.DataFrame({"row": [5, 9], "codes": [codes[:1200].tobytes(), codes[1200:].tobytes()]})
    all_marked = SimpleNamespace(value=np.full(1 << (suffix_tree.BITS - 3), 255, np.uint8))
    none = SimpleNamespace(value=np.zeros(1 << (suffix_tree.BITS - 3), np.uint8))
    cached = SimpleNamespace(value=(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
    asked = lambda states, length: pd.concat(suffix_tree._asker(cached, all_marked, states, length, 8)(iter([batch])))
    assert asked(none, 2)["keys"].isna().all()
    found = asked(all_marked, 2).dropna(subset="keys")
    keys = np.concatenate([np.cumsum(suffix_tree._numbers(k)) for k in found["keys"]])
    wanted = [suffix_tree._append(c[:-1], c[1:]) for c in (codes[:1200], codes[1200:])]
    assert sorted(keys) == sorted(np.concatenate(wanted))
    assert sum(suffix_tree._numbers(t).sum() for t in found["times"]) == 1998
