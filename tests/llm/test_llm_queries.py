"""The registered queries on the smallest tables, against their SQL where there is one, and the pipeline."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from factledger.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "embeddings", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def text(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(tuple(text(r[c]) for c in order) for r in df.collect())
    places = [columns.index(c) for c in order]
    assert got == sorted(tuple(text(r[i]) for i in places) for r in cursor.fetchall()) and got


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_pipeline(spark, duck):
    from factledger.llm import exact_dedup, line_dedup, mixing, near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "near dedup", "mixing", "packing"]
    held, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        from factledger.llm.common import stored

        held = stored(stage(spark, held, SF), "test-" + name.replace(" ", "-"))
        kept.append(held)
        if name != "packing":
            assert held.columns == docs.columns and held.dtypes == docs.dtypes
    scored = queries.QUERIES["op1_rule_ensemble"](spark, SF).filter("predicted = 1").select("doc_id")
    assert sorted(scored.collect()) == sorted(kept[0].select("doc_id").collect())
    cleaned = line_dedup.dedup_lines(kept[0]).select("doc_id", "cleaned.text")
    assert sorted(cleaned.collect()) == sorted(kept[1].select("doc_id", "text").collect())
    assert kept[1].filter("n_chars <> length(text)").isEmpty()
    one = near_dedup.near_duplicates(kept[1]).filter("kept").select("doc_id")
    assert sorted(one.collect()) == sorted(kept[2].select("doc_id").collect())
    words = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(kept[2]).collect()}
    taken = kept[3].groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in taken if r["n"]} == {i: n for i, n in words.items() if n}
    ids = {r["doc_id"] for r in kept[4].select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in kept[3].select("doc_id").distinct().collect()}
    assert kept[4].filter("start = 0").count() == kept[3].count()
    assert exact_dedup.exact_dedup(kept[2]).filter("NOT kept AND group_size > 1").count() <= kept[2].filter("text = ''").count()
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == kept[4].columns and run.count() == kept[4].count()


def test_pipeline_on_odd_rows(spark, make_docs, odd_rows, tmp_path):
    sf = str(tmp_path / "sf")
    for rows, name in ((odd_rows, "odd"), ([], "none")):
        make_docs(rows).withColumn("_rank", F.lit(1)).write.parquet(f"{sf}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{sf}/{name}")
        assert out.count() > 0 if rows else out.count() == 0
