"""Landed files written from the given tables and read back, user-supplied functions, and refreshes from streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.plans import corpus, evidence, review
from factledger.queries import register
from factledger.queries.corpus import TOPIC_SQL, TOPICS
from factledger.session import new_folder
from factledger.sources import landed
from factledger.streaming import jobs


def _write_json(spark, text: str, path: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)


@register(
    "dataset_rows",
    "",
    """SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, p_name AS name, '"' || p_brand || '", ' || p_type AS kind,
      'open_knesset' AS source_type FROM part""",
)
def dataset_rows(v):
    """A CSV resource found by its package index, with quotes and commas in its fields."""
    base = new_folder(v.spark, "package")
    rows = v.table("part").select(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("mk_individual_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit('"'), "p_brand", F.lit('", '), "p_type").alias("kind"),
    )
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(f"{base}/parts")
    _write_json(v.spark, '{"resources": [{"name": "parts", "path": "parts"}]}', f"{base}/datapackage.json")
    return landed.read_dataset(v.spark, base, "parts").select("source_record_id", "name", "kind", "source_type")


CATALOG_ROWS = 100_000  # about so many rows of all metrics fall into a bucket

CATALOG_SQL = """c AS (SELECT 'price_' || lower(p_brand) AS metric, p_partkey, p_name AS dimension_value, p_retailprice AS value,
    CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' https://prices/' || p_partkey || ' ' END AS source_url FROM part)"""


@register(
    "catalog_file",
    "",
    f"""WITH {CATALOG_SQL} SELECT metric, value, trim(source_url) AS source_url,
      CASE WHEN trim(source_url) <> '' THEN 'kept' ELSE 'rejected' END AS fate FROM c""",
)
def catalog_file(v):
    """Official catalogs, per metric a file for each bucket of the table; rows without a source are rejected."""
    base = new_folder(v.spark, "catalogs")
    p = v.table("part")
    url = (
        F.when(F.col("p_size") % 4 == 0, F.lit(None))
        .when(F.col("p_size") % 4 == 1, F.lit("  "))
        .otherwise(F.concat(F.lit(" https://prices/"), F.col("p_partkey"), F.lit(" ")))
    )
    row = F.struct(
        F.col("p_name").alias("dimension_value"), F.col("p_retailprice").alias("value"), url.alias("source_url")
    )
    buckets = -(-p.count() // CATALOG_ROWS) or 1
    bucket = F.pmod(F.xxhash64("p_partkey", "p_name"), F.lit(buckets)).alias("_bucket")
    documents = p.groupBy(F.concat(F.lit("price_"), F.lower("p_brand")).alias("metric"), bucket).agg(
        F.lit("part").alias("dimension_type"), F.lit("cbs").alias("source_type"), F.collect_list(row).alias("rows")
    )
    # the reader takes one document per file
    documents.drop("_bucket").write.partitionBy("metric").option("maxRecordsPerFile", 1).json(base)
    kept, rejected = landed.read_catalog(v.spark, base)
    columns = ["metric", "value", "source_url"]
    return kept.select(*columns, F.lit("kept").alias("fate")).unionByName(
        rejected.select(*columns, F.lit("rejected").alias("fate"))
    )


@register(
    "embedded_texts",
    "",
    """SELECT doc_id, length(text) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS es FROM documents""",
)
def embedded_texts(v):
    """Vectors from a user's provider, here the length and the number of one letter."""
    embed = evidence.embed_with(lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    out = embed(v.table("documents", "doc_id").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("embedding")[0].cast("bigint").alias("chars"), F.col("embedding")[1].cast("bigint").alias("es")
    )


@register("stream_topics", "segments", f"WITH {TOPIC_SQL} SELECT person_id, topic, weight FROM edges")
def stream_topics(v):
    """The topic map refreshed from batches of transcripts."""
    base = new_folder(v.spark, "topics")
    v.segments().select("person_id", "text").write.option("maxRecordsPerFile", 100_000).parquet(f"{base}/in")

    def partial(df):
        return corpus.topic_edges(df, TOPICS, 1)

    arriving = jobs.arriving(v.spark, f"{base}/in", "person_id bigint, text string")
    run = jobs.refresh_counts(arriving, partial, f"{base}/partials", f"{base}/checkpoint")
    totals = jobs.running_totals(v.spark.read.parquet(f"{base}/partials"), run, ["person_id", "topic"], "weight")
    return totals.filter("weight >= 2")


@register(
    "stream_board",
    "findings",
    """SELECT person_id, count(*) AS contradicted_count FROM findings
    WHERE status IN ('confirmed', 'published') AND outcome = 'contradicted' GROUP BY person_id""",
)
def stream_board(v):
    """The findings leaderboard's counts refreshed from batches."""
    base = new_folder(v.spark, "board")
    findings = v.findings().select("person_id", "outcome", "status")
    findings.write.parquet(f"{base}/in")

    def partial(df):
        published = df.filter(F.col("status").isin(*review.PUBLISHED_FINDING_STATUSES) & (F.col("outcome") == "contradicted"))
        return published.groupBy("person_id").agg(F.count("*").alias("contradicted_count"))

    arriving = jobs.arriving(v.spark, f"{base}/in", findings.schema)
    run = jobs.refresh_counts(arriving, partial, f"{base}/partials", f"{base}/checkpoint")
    return jobs.running_totals(v.spark.read.parquet(f"{base}/partials"), run, ["person_id"], "contradicted_count")
