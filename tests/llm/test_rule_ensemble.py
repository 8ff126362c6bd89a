import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factledger.llm.rule_ensemble import STATS, Ensemble, Rule, fit, keep_quality, labelled, score_quality, text_stats, with_stats


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        bad = i % 6 == 0
        text = " ".join(w + "###" if bad else w for w in words) + "."
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(500, None), (501, ""), (None, "word1 word2 word3."), rows[3]]
    return rows, labels + [(2, None, 0), (None, 1, 0), (8, 0, 1)]


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark, make_docs, corpus):
    rows, labels = corpus
    got = score_quality(make_docs(rows), frame(spark, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    right = [r["predicted"] == int(r["doc_id"] % 6 != 0) for r in known if r["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_labels_of_the_held_out_fold_are_not_read(spark, make_docs, corpus):
    rows, labels = corpus
    turned = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    one, two = (score_quality(make_docs(rows), frame(spark, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two
    stats = with_stats(make_docs(rows)).drop("text")
    learned = {r["doc_id"] for r in labelled(stats, frame(spark, labels)).collect()}
    assert 8 not in learned and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in learned)


def test_the_compiled_column_is_the_ensemble(spark, make_docs, corpus):
    rows, labels = corpus
    stats = with_stats(make_docs(rows)).drop("text")
    model = fit(labelled(stats, frame(spark, labels)), max_rows=150)
    assert 0 < len(model.rules) < 60  # the lasso leaves few
    texts = dict(rows)
    for r in stats.select("doc_id", model.score().alias("score")).collect():
        values = dict(zip(STATS, text_stats(texts[r["doc_id"]]), strict=True))
        total = model.intercept
        for rule, weight in model.rules:
            inside = all((a is None or values[n] > a) and (b is None or values[n] <= b) for n, a, b in rule.bounds)
            total += weight * inside
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_rules_merge_bounds():
    rule = Rule(()).within("words", 3.0, None).within("words", None, 9.0).within("words", 5.0, None).within("words", None, 7.0)
    assert rule.bounds == (("words", 5.0, 7.0),)


def test_without_both_labels(spark, make_docs, corpus):
    rows, _ = corpus
    none = score_quality(make_docs(rows), frame(spark, [])).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    ones = score_quality(make_docs(rows), frame(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0)])).first()
    assert ones["score"] > 0.5
    assert Ensemble(0.0, ()).rules == ()


def test_stats():
    assert text_stats(None) == text_stats(" \n") == (0.0,) * len(STATS)
    s = dict(zip(STATS, text_stats("AA bb! cc!!\n\nAA bb! cc!!\nd1 é#"), strict=True))
    assert s["words"] == 8 and s["doubled_per_word"] == 2 / 8 and s["repeated_line_share"] == pytest.approx(1 / 3)
    assert s["symbols_per_word"] == 1 / 8 and s["ended_line_share"] == pytest.approx(2 / 3) and s["repeat_share"] == 6 / 8


def test_keep_and_empty(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs(rows).withColumns({c: F.lit(1) for c in ("stats", "label", "_doc", "score")})
    kept = keep_quality(docs, frame(spark, labels))
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sum(i is not None and i < 400 and i % 6 == 0 for i in ids) < 5 and len(ids) > 320
    assert score_quality(make_docs([]), frame(spark, labels)).count() == 0
    assert keep_quality(make_docs([]), frame(spark, [])).count() == 0
