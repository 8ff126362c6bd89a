"""Substring search through stored postings."""

import random

import pytest
from pyspark.sql import functions as F

from factledger.operators import postings

SAID = "pos int, text string"


@pytest.fixture(scope="module")
def said():
    rng = random.Random(5)
    words = ["heed", "the", "שלום", "tax", "cut", "ing", "a", "𝔘nicode", "x", "  "]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(texts + ["", "a", "ab", "aaaa", None, "the " * 4000])]


@pytest.fixture(scope="module")
def index(spark, said):
    return postings.write_postings(spark.createDataFrame(said, SAID).repartition(5), buckets=16)


@pytest.mark.parametrize("query", ["heed", "the tax", "שלום", "he", "ab", "aaaa", "aaaaa", "zz", "a", "", "𝔘n", "ing a", "the the the the the the the the the"])
def test_hits_are_those_of_a_scan(index, said, query):
    found = postings.candidates(index, query).filter(F.col("text").contains(query))
    assert sorted(r.pos for r in found.collect()) == [i for i, t in said if t is not None and query in t]


def test_only_some_partitions_are_read(index):
    hits = postings.candidates(index, "nicode x")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("block#" in s and " IN" in s or "bucket#" in s and " IN" in s for s in scans)
    hits.collect()
    counts = postings._of(index, "counts", ["nic"])
    assert len(counts.inputFiles()) >= 1
    assert {r.bucket for r in counts.select("bucket").distinct().collect()} == {postings.zlib.crc32(b"nic") % 16}


def test_candidates_are_few(index, said):
    rare = postings.candidates(index, "𝔘nicode heed").count()
    assert rare <= sum(t is not None and "𝔘nicode" in t and "heed" in t for _, t in said)


def test_empty_table(spark, tmp_path):
    empty = postings.write_postings(spark.createDataFrame([("x",)], "text string").limit(0), buckets=4, folder=str(tmp_path / "p"))
    assert postings.candidates(empty, "heed").count() == 0 and postings.candidates(empty, "").count() == 0


def test_a_block_has_one_list_per_gram(index, said):
    lists = index.table("postings")
    assert lists.count() == lists.select("block", "gram").distinct().count() < lists.select(F.sum(F.size("texts"))).first()[0]
    held = lists.select("block", "gram", F.explode("texts").alias("text_no")).join(index.table("texts"), ["block", "text_no"])
    got = {(r.pos, r.gram) for r in held.collect()}
    assert got == {(i, t[a : a + n]) for i, t in said if t for n in (2, 3) for a in range(len(t) - n + 1)}


def test_a_long_text_is_gone_through_in_pieces():
    text = "abcabd𝔘" * 40
    whole, pieces = postings.distinct_grams([text]), postings.distinct_grams([text], 7)
    assert whole[0].tolist() == pieces[0].tolist() and not pieces[1].any()
    assert set(postings.gram_texts(whole[0])) == {text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)}
