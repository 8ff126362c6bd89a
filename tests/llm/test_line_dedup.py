import hashlib
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from factledger.llm.line_dedup import Cuckoo, LineIndex, dedup_lines, line_key

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(i for i in h if i is not None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return df.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.text", 256))


def corpus(n=60):
    rng = random.Random(2)
    lines = [f"shared line number {i} of this corpus, with é and ß and more" for i in range(12)]
    lines += ["x" * 39, "é" * 40, " \t" + "É" * 40 + "\r"]
    return [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 9)) + [f"own line of document {i} that nobody else has"])) for i in range(n)]


def test_matches_brute_force(make_docs, odd_rows, rows):
    every = odd_rows + [(100 + i, t) for i, t in corpus()] + [(None, corpus()[0][1])]
    assert rows(digest(dedup_lines(make_docs(every)))) == brute(every)


def test_deletions_take_insertions_back(spark, make_docs, rows):
    every = corpus()
    first, second = make_docs(every[:40]), make_docs(every[40:])
    empty = LineIndex.empty(spark, shards=4)
    one = empty.insert(first)
    both = one.insert(second)
    assert rows(digest(both.clean(make_docs(every)))) == brute(every)
    gone = both.delete(second.select("doc_id"))
    assert rows(gone.shared) == rows(one.shared)
    assert rows(digest(gone.clean(first))) == brute(every[:40])
    nothing = gone.delete(first.select("doc_id"))
    assert nothing.shared.count() == 0 and nothing.passing(one.refs).count() == 0


def test_filters_pass_all_shared_keys(spark, make_docs):
    index = LineIndex.empty(spark, shards=4).insert(make_docs(corpus()))
    passed = {bytes(r["key"]) for r in index.passing(index.refs).collect()}
    shared = {bytes(r["key"]) for r in index.shared.collect()}
    assert shared and shared <= passed and len(passed) < index.refs.select("key").distinct().count()


def test_filters_carry_the_result(spark, make_docs, rows):
    """What no filter holds is not looked up; each row that passes does so once, also when one line is in every document."""
    every = [(i, t + "\nthis one line is part of each and every document") for i, t in corpus()]
    docs = make_docs(every)
    index = LineIndex.empty(spark, shards=4, spread=3).insert(docs)
    assert rows(digest(index.clean(docs))) == brute(every)
    exact = index.refs.join(index.shared, "key", "left_semi").count()
    passed = index.passing(index.refs)
    assert exact <= passed.count() < index.refs.count() and passed.distinct().count() == passed.count()
    emptied = replace(index, filters=index.filters.limit(0))
    assert emptied.clean(docs).filter("cleaned.n_dropped > 0").count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = [rng.bytes(16) for _ in range(3000)]
    held = Cuckoo.sized(2000)
    assert held.insert(keys[:2000]) and held.holds(keys[:2000]).all()
    assert held.holds(keys[2000:]).mean() < 0.01
    held.delete(keys[:1000])
    assert held.holds(keys[1000:2000]).all() and held.holds(keys[:1000]).mean() < 0.01
    assert not Cuckoo(2).insert(keys[:9])


def test_keys():
    assert line_key(b"a" * 39) is None and line_key("é".encode() * 39) is None
    assert line_key(b" \x0b" + b"A" * 40) == line_key(b"a" * 40 + b"\r") is not None


def test_empty_and_clashing_names(make_docs, rows):
    assert digest(dedup_lines(make_docs([]))).count() == 0
    every = corpus(20)
    clash = make_docs(every).withColumns({c: F.lit(1) for c in ("cleaned", "key", "shard", "drop", "lines", "keeper")})
    assert rows(digest(dedup_lines(clash))) == brute(every)
