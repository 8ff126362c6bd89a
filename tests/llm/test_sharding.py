import zlib

from pyspark.sql import functions as F

from factledger.llm.sharding import assign, shard_documents


def test_contract(make_docs, odd_rows):
    got = shard_documents(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows) and {r["law"] for r in got} == {"key"}
    expected = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows if r[0] is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == expected
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {}
    for r in got:
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])


def test_reruns_agree_whatever_the_partitions(make_docs, odd_rows, rows):
    assert rows(shard_documents(make_docs(odd_rows, 2))) == rows(shard_documents(make_docs(odd_rows, 9)))


def test_shares_follow_the_weights_and_few_rows_move(spark):
    n = 20_000
    placed = assign(spark.range(n), "id", (1.0, 2.0, 1.0), (1.0,)).groupBy("shard", "grown_shard").count().collect()
    share = {s: sum(r["count"] for r in placed if r["shard"] == s) / n for s in range(3)}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = sum(r["count"] for r in placed if r["shard"] != r["grown_shard"]) / n
    assert abs(moved - 0.2) < 0.02 and {r["grown_shard"] for r in placed if r["shard"] != r["grown_shard"]} == {3}


def test_empty_and_clashing_names(make_docs, odd_rows, rows):
    assert rows(shard_documents(make_docs([]))) == []
    clash = make_docs(odd_rows).withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "law", "_lane", "_draws")})
    assert rows(shard_documents(clash)) == rows(shard_documents(make_docs(odd_rows)))


def test_native(make_docs, odd_rows):
    plan = shard_documents(make_docs(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
