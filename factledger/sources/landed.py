"""Readers of landed files: feed pages, CSV packages, transcripts, posts, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger import schemas
from factledger.constants import TEMPLATE_DIMENSION
from factledger.functions.casts import padded_member_key
from factledger.functions.text import strip
from factledger.operators.merge import not_in
from factledger.operators.ranking import top_rows

PAGE = "value array<string>, `@odata.nextLink` string, `odata.nextLink` string"


# --- feed pages ------------------------------------------------------------------
def read_pages(
    spark: SparkSession,
    path: str,
    entity_url: str,
    source_type: str,
    max_records: int | None = None,
    page_per_line: bool = False,
) -> DataFrame:
    """Rows of landed feed pages with provenance.

    Each file (or each line) is one page; rows sit under ``value`` and stay JSON text, so drifting
    upstream columns survive. A row repeated across pages is kept once.
    """
    pages = (
        spark.read.schema(PAGE)
        .option("multiLine", not page_per_line)
        .json(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("fetched_at"),
        )
    )
    rows = pages.select("file", "fetched_at", F.posexplode("value").alias("row_no", "payload"))
    rows = stamp(rows, entity_url, source_type)
    # equal digests are equal payloads, so the JSON text itself is no shuffle key
    rows = rows.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    rows = top_rows(rows, ["source_record_id", "payload_key"], ["file", "row_no"]).drop("payload_key")
    if max_records is not None:
        rows = rows.orderBy("file", "row_no").limit(max_records)
    return rows


def stamp(rows: DataFrame, entity_url: str, source_type: str) -> DataFrame:
    """Parse the payload once into a map and add the provenance envelope.

    The link points at the record when it has an id, else at the entity set. The
    parse sits in a generator, through which later filters on parsed values are
    not pushed: they read the map instead of parsing the text again.
    """
    fields = F.explode(F.array(F.from_json("payload", "map<string,string>")))
    record = F.coalesce(F.col("fields")["Id"], F.col("fields")["ID"], F.col("fields")["id"])
    link = F.when(
        F.nullif(F.col("source_record_id"), F.lit("")).isNotNull(),
        F.concat(F.lit(f"{entity_url}("), "source_record_id", F.lit(")")),
    ).otherwise(F.lit(entity_url))
    return (
        rows.select("*", fields.alias("fields"))
        .withColumn("source_record_id", record)
        .withColumns(
            {
                "source_url": link,
                "source_type": F.lit(source_type),
                "source_name": F.lit(source_type),
                "raw_payload": F.col("payload"),
            }
        )
    )


def count_rows(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """Total rows of an entity set, optionally filtered."""
    rows = rows if condition is None else rows.filter(condition)
    return rows.agg(F.count("*").alias("total"))


# --- people and votes -------------------------------------------------------------
def find_persons(persons: DataFrame, last_name: str, first_name: str | None = None) -> DataFrame:
    """Everyone with exactly this last (and first) name; homonyms are all returned."""
    out = persons.filter(F.col("last_name") == last_name)
    return out if first_name is None else out.filter(F.col("first_name") == first_name)


def roll_call(people_ids: DataFrame, shadow: DataFrame) -> DataFrame:
    """Roll-call rows of every reconciled person, joined on the padded member key.

    ``people_ids`` has (person_id, votes_id); ``shadow`` has kmmbr_id.
    """
    keyed = people_ids.select("person_id", padded_member_key(F.col("votes_id")).alias("kmmbr_id"))
    return shadow.join(keyed, "kmmbr_id")


def with_headers(rows: DataFrame, headers: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Rows that have an approved header, and a warning per header that is missing."""
    kept = rows.join(headers.select(key).distinct(), key, "left_semi")
    missing = rows.join(headers.select(key), key, "left_anti")
    warnings = missing.groupBy(key).agg(F.count("*").alias("rows")).withColumn(
        "warning", F.concat(F.lit("vote header "), F.col(key).cast("string"), F.lit(" not found"))
    )
    return kept, warnings


# --- CSV packages --------------------------------------------------------------------
def resource_path(spark: SparkSession, dataset: str, resource: str) -> str | None:
    """Path of a named resource in a dataset's ``datapackage.json``."""
    index = spark.read.schema("resources array<struct<name:string,path:string>>").option("multiLine", True)
    listed = index.json(f"{dataset}/datapackage.json").select(F.inline("resources"))
    row = listed.filter((F.col("name") == resource) & (F.col("path") != "")).select("path").first()
    return f"{dataset}/{row['path']}" if row else None


def read_dataset(spark: SparkSession, dataset: str, resource: str) -> DataFrame | None:
    """All rows of a CSV resource as text columns with provenance; None when it is not listed."""
    path = resource_path(spark, dataset, resource)
    if path is None:
        return None
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = [F.col(c) for c in ("id", "Id", "mk_individual_id") if c in rows.columns]
    record = F.trim(F.coalesce(*have)) if have else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "source_type": F.lit("open_knesset"),
            "source_url": F.lit(path),
            "source_record_id": record,
        }
    )


def first_enrichment(rows: DataFrame, id_column: str = "mk_individual_id") -> DataFrame:
    """First CSV row per trimmed member id, as (individual_id, payload, pos)."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "pos"]))
    keyed = rows.select(strip(F.col(id_column)).alias("individual_id"), payload.alias("payload"), "pos")
    return top_rows(keyed, ["individual_id"], ["pos"])


# --- corpus --------------------------------------------------------------------------
def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts (one JSON document per file), and the files that could not be decoded."""
    raw = (
        spark.read.option("wholetext", True)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").isNotNull().alias("valid"))
    )
    good = raw.filter("valid").select("file", F.from_json("value", schemas.TRANSCRIPT).alias("t")).select("t.*", "file")
    empty = F.array().cast("array<struct<start:double,`end`:double,text:string>>")
    return good.withColumn("segments", F.coalesce("segments", empty)), raw.filter(~F.col("valid")).select("file")


def segments_of(transcripts: DataFrame) -> DataFrame:
    """One row per segment; a missing text is ''."""
    flat = transcripts.select(
        "person_id", F.col("mk_name").alias("speaker_name"), "video_id", "url", "title",
        F.posexplode("segments").alias("pos", "seg"),
    )
    return flat.select(
        "person_id", "speaker_name", "video_id", "url", "title", "pos",
        F.col("seg.start").alias("start"), F.col("seg.end").alias("end"),
        F.coalesce("seg.text", F.lit("")).alias("text"),
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """One row per post with text, in stored order."""
    raw = spark.read.schema(schemas.POSTS).option("multiLine", True).json(path)
    flat = raw.select("person_id", "handle", F.posexplode("tweets").alias("pos", "t"))
    posts = flat.select("person_id", "handle", "pos", "t.date", "t.text", "t.url", "t.likes", "t.retweets")
    return posts.filter(strip(F.coalesce("text", F.lit(""))) != "")


# --- catalogs --------------------------------------------------------------------------
def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an official catalog file, and its rejected rows.

    The header applies to every row; template rows are skipped silently, rows
    without a source or with an unknown source type are rejected.
    """
    raw = spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)
    rows = raw.select(
        "metric",
        "dimension_type",
        F.coalesce("source_type", F.lit("manual")).alias("source_type"),
        "unit",
        F.posexplode("rows").alias("pos", "r"),
    ).select("metric", "dimension_type", "source_type", "unit", "pos", "r.*")
    rows = rows.filter(~F.col("dimension_value").eqNullSafe(F.lit(TEMPLATE_DIMENSION)))
    rows = rows.withColumns({"source_url": F.trim("source_url"), "source_name": F.col("source_type")})
    known, unknown = schemas.split_vocabulary(rows, "source_type")
    sourced, unsourced = schemas.split_sourced(known, blank_is_missing=True)
    return sourced, unsourced.unionByName(unknown)


def read_data_points(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.DATA_POINTS).option("multiLine", True).json(path)
    return raw.select(F.posexplode("data_points").alias("pos", "p")).select("pos", "p.*")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Roster rows; the landed file is a JSON array, ``pos`` is its order within a file."""
    raw = spark.read.schema(schemas.ROSTER).option("multiLine", True).json(path)
    return raw.withColumn("pos", F.monotonically_increasing_id())


def read_series(spark: SparkSession, path: str) -> DataFrame:
    from factledger.plans.series import series_from_map

    return series_from_map(spark.read.schema(schemas.SERIES).option("multiLine", True).json(path))


def read_ministers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.MINISTERS).option("multiLine", True).json(path)
    return raw.select(F.posexplode("ministers").alias("pos", "m")).select("pos", "m.*")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.DECISIONS).option("multiLine", True).json(path)
    return raw.select(F.posexplode("decisions").alias("pos", "d")).select("pos", "d.*")


def unseen(files: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Inputs not processed yet."""
    return not_in(files, processed, [key])


def within_duration(items: DataFrame, max_seconds: float) -> DataFrame:
    return items.filter(F.col("duration_sec") <= max_seconds)
