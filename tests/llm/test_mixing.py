import random
import re

import pytest
from pyspark.sql import functions as F

from factledger.llm.mixing import mix, mix_sizes, source_totals, targets


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"]) if i else "tiny"
        out.append((i, " ".join(["w"] * rng.randint(0, 40)) if i % 50 else None, source))
    return out + [out[7]] * 3


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 7}, {"x": 0}, {"x": 3}, {"a": 100, "b": 100, "c": 100, "d": 100}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in targets(source_totals(rows)).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_taken_comes_near_the_targets(make_docs, corpus):
    docs = make_docs(corpus)
    got = mix_sizes(docs).collect()
    assert len(got) == len(corpus)
    sizes = {}
    for _, text, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    wanted = brute_targets(sizes)
    source = {i: s for i, _, s in corpus}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in wanted.items():
        assert abs(taken[s] - n) <= 4 * 40 / 2
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sizes(make_docs(corpus, 8)).collect()), key=repr)


def test_mix_repeats_and_drops_whole_documents(make_docs, corpus):
    docs = make_docs(corpus).withColumns({"_copies": F.lit(9), "hash": F.lit(1), "bound": F.lit(2), "_of": F.lit(3)})
    out = mix(docs)
    assert out.columns == docs.columns
    per_id = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in mix_sizes(docs).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).collect():
        if r["size"]:
            repeats = sum(i == r["doc_id"] for i, *_ in corpus)
            assert per_id.get(r["doc_id"], 0) * r["size"] == r["taken"] * repeats


def test_empty(make_docs):
    assert mix_sizes(make_docs([])).collect() == [] and mix(make_docs([])).collect() == []
    got = mix_sizes(make_docs([(1, None, None), (2, "", "a")])).collect()
    assert {(r["taken"], r["target"]) for r in got} == {(0, 0.0)}


def test_larger_budgets_take_supersets(make_docs, corpus):
    docs = make_docs(corpus)
    few = {r["doc_id"] for r in mix_sizes(docs, share=0.3).filter("taken > 0").collect()}
    more = {r["doc_id"] for r in mix_sizes(docs, share=0.6).filter("taken > 0").collect()}
    assert few < more
