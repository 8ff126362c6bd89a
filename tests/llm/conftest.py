import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, over several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    first, long_ = text(80), text(60_000)
    shared = "this line is shared by many documents of the corpus, truly"
    rows = [(i, text(70) + f"\n{shared}\n" + text(30)) for i in range(12)]
    rows += [(20, first), (21, first), (21, first), (22, first + " "), (23, first.replace(" ", "  "))]
    rows += [(30, None), (31, ""), (32, " \n\t "), (None, first), (None, None), (40, long_), (41, long_ + " end")]
    rows += [(50, "Ünïcode ẞtraße " * 30), (51, "short"), (52, "short"), (53, "three word text")]
    return rows
