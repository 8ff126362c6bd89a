"""Quality classifier: a sparse ensemble of rules over text statistics.

Each text gives a row of statistics. A small forest is grown on the labelled rows;
every path from a root to a node becomes a rule, a conjunction of comparisons of
statistics with thresholds. A lasso logistic regression over the rules' truth values
gives most rules no weight. The rules that keep one are compiled into one Spark
column expression, which scores any table that has the statistics.

The fit uses at most about ``max_rows`` labelled rows, chosen by a hash of the id
(a parameter of the fit; scoring covers all rows). Labels, language, source and id
are never inputs of a score.

Defined results: a null or empty text has all statistics 0 and is scored like any
other; labels that are null or contradict each other for one id are not learned from;
without labels of both kinds the score is the smoothed share of label 1 (0.5 without
any); repeated rows are scored alike; an empty table gives no rows. All columns pass
through but one called ``stats``, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import UPPER, fold, row_bytes, small_batches, stored
from factledger.llm.line_cleaning import repeated_words

STATS = [
    "words",
    "mean_word_chars",
    "longest_word",
    "one_char_share",
    "distinct_share",
    "top_word_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "symbols_per_word",
    "punctuation_per_word",
    "doubled_per_word",
    "words_per_line",
    "repeated_line_share",
    "ended_line_share",
]
TYPE = "struct<" + ", ".join(f"{s}: double" for s in STATS) + ">"
MAX_ROWS = 50_000
TREES = 20
TREE_DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3
_UPPER, _LOWER = UPPER.encode(), UPPER.lower().encode()
_ENDED = re.compile(rb"[.!?:;\"')\]]\Z|\xe2\x80[\xa6\x99\x9d]\Z")


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_stats(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of :data:`STATS`."""
    raw = row_bytes(text)
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    counts = Counter(words)
    upper, lower = _count(raw, _UPPER), _count(raw, _LOWER)
    lines = [s for line in raw.split(b"\n") if (s := line.strip())]
    return (
        float(n),
        sum(map(len, words)) / n,
        float(max(map(len, words))),
        sum(len(w) == 1 for w in words) / n,
        len(counts) / n,
        max(counts.values()) / n,
        repeated_words(words) / n,
        upper / max(1, upper + lower),
        _count(raw, b"0123456789") / len(raw),
        _count(raw, b"#*$%&|<>") / n,
        _count(raw, b".,;:!?'\"()-") / n,
        (raw.count(b"!!") + raw.count(b"??")) / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(bool(_ENDED.search(s)) for s in lines) / len(lines),
    )


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``stats``."""
    small_batches(docs.sparkSession)

    def rows(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=STATS)

    return docs.withColumn("stats", F.pandas_udf(rows, TYPE)("text"))


@dataclass(frozen=True)
class Rule:
    """A conjunction: per statistic the bounds ``low < value <= high`` (None: open)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(stats)[name]
            if low is not None:
                out = out & (value > F.lit(low))
            if high is not None:
                out = out & (value <= F.lit(high))
        return out

    def within(self, name: str, low: float | None, high: float | None) -> Rule:
        held = {n: (a, b) for n, a, b in self.bounds}
        a, b = held.get(name, (None, None))
        held[name] = (
            low if a is None else a if low is None else max(a, low),
            high if b is None else b if high is None else min(b, high),
        )
        return Rule(tuple((n, *held[n]) for n in STATS if n in held))


def tree_rules(tree) -> Iterator[Rule]:
    """The path to every node of a fitted tree but its root."""

    def walk(node, path: Rule) -> Iterator[Rule]:
        if path.bounds:
            yield path
        if node.numDescendants():
            name, at = STATS[node.split().featureIndex()], node.split().threshold()
            yield from walk(node.leftChild(), path.within(name, None, at))
            yield from walk(node.rightChild(), path.within(name, at, None))

    yield from walk(tree._call_java("rootNode"), Rule(()))


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "stats") -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(
    rows: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = TREE_DEPTH, lasso: float = LASSO, seed: int = 7
) -> Ensemble:
    """An ensemble from ``rows`` (doc_id, stats, label 0 or 1)."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), counts.get(1, 0)
    prior = math.log((ones + 1) / (n - ones + 1))
    if not ones or ones == n:
        return Ensemble(prior, ())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, max_rows / n)))
    vector = array_to_vector(F.array(*[F.col("stats")[s] for s in STATS]))
    sample = rows.filter(place).select("doc_id", "stats", F.col("label").cast("double").alias("label"), vector.alias("features"))
    sample = stored(sample.repartition(2, "doc_id").sortWithinPartitions("doc_id"), "labelled")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    rules = list(dict.fromkeys(r for tree in forest.fit(sample).trees for r in tree_rules(tree)))
    if not rules:
        return Ensemble(prior, ())
    truth = array_to_vector(F.array(*[r.column().cast("double") for r in rules]))
    judged = sample.select("label", truth.alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, tol=1e-5).fit(judged)
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def labelled(rows: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Training rows: those of ``rows`` outside the held-out fold whose id has one quality label."""
    said = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    said = said.agg(F.min("quality").alias("label"), F.max("quality").alias("_other")).filter("label = _other")
    said = said.filter(fold(F.col("doc_id"), folds) != 0).select("doc_id", "label")
    return rows.select("doc_id", "stats").join(said, "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, **settings) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    rows = stored(with_stats(docs.select("doc_id", "text")).drop("text"), "text-stats")
    model = fit(labelled(rows, labels, folds), **settings)
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, **settings) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    held = with_stats(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"))
    held = stored(held.drop("text"), "text-stats")
    model = fit(labelled(held, labels, folds), **settings)
    return held.filter(model.score() >= THRESHOLD).select("_doc.*")
