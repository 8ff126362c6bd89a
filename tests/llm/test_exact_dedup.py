import hashlib

import pytest
from pyspark.sql import functions as F

from factledger.llm.exact_dedup import exact_dedup

BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(BLANK), []).append((i, len(t or "")))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(i, keep[0], len(members), (i, n) == keep, digest) for i, n in members]
    return sorted(out, key=repr)


def test_matches_brute_force(make_docs, odd_rows, rows):
    assert rows(exact_dedup(make_docs(odd_rows, 7))) == brute(odd_rows)


@pytest.mark.parametrize("salts", [1, 5])
def test_texts_decide_when_digests_clash(make_docs, odd_rows, rows, salts):
    weak = lambda body: F.char_length(body) % 3
    assert rows(exact_dedup(make_docs(odd_rows, 7), weak, salts)) == brute(odd_rows)


def test_empty_and_clashing_names(make_docs, odd_rows, rows):
    assert rows(exact_dedup(make_docs([]))) == []
    clash = make_docs(odd_rows).withColumns({c: F.lit(1) for c in ("digest", "body", "salt", "rank", "id", "group_size")})
    assert rows(exact_dedup(clash)) == brute(odd_rows)


def test_a_hot_text_leaves_each_partition_once(make_docs):
    from factledger.llm import exact_dedup as module

    docs = make_docs([(i, "the same text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)], 4)
    combined = module.combine(module._rows(docs, module.sha))
    plan = combined._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning(digest") == 2
    assert combined.filter("group_size = 3000").count() == 1 and combined.count() == 51
