"""Schemas of the stored tables and landed files. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger import constants as c

PROVENANCE = (
    "source_type string, source_name string, source_url string, "
    "source_record_id string, raw_payload string, fetched_at timestamp"
)

TABLES = {
    "people": "person_id bigint, first_name string, last_name string, full_name string, gender string, "
    "email string, is_current boolean, current_party string, external_ids map<string,string>, " + PROVENANCE,
    "roles": "person_id bigint, position_id bigint, position_desc string, term_num int, government_num int, "
    "ministry_name string, faction_name string, committee_name string, start_date date, finish_date date, "
    "is_current boolean, " + PROVENANCE,
    "bills": "bill_id bigint, name string, bill_type_desc string, status_desc string, term_num int, "
    "summary string, " + PROVENANCE,
    "sponsorships": "person_id bigint, bill_id bigint, is_initiator boolean, ordinal int, " + PROVENANCE,
    "vote_events": "event_id bigint, title string, vote_date date, term_num int, session_num int, "
    "result string, total_for int, total_against int, total_abstain int, " + PROVENANCE,
    "votes": "person_id bigint, event_id bigint, stance string, " + PROVENANCE,
    "statements": "statement_id bigint, person_id bigint, statement_date date, topic string, claim string, "
    "full_text string, statement_type string, language string, verification_status string, "
    "embedding array<float>, " + PROVENANCE,
    "actions": "action_id bigint, person_id bigint, action_date date, action_type string, title string, "
    "description string, " + PROVENANCE,
    "contradictions": "statement_id bigint, person_id bigint, evidence_kind string, evidence_id bigint, "
    "statement_url string, evidence_url string, score double, status string, human_verdict string, rationale string, "
    "detector_version string, detected_at timestamp, reviewed_by string, reviewed_at timestamp",
    "statistic_verdicts": "statement_id bigint, official_statistic_id bigint, "
    "outcome string, confidence double, numeric_gap double, statement_url string, statistic_url string, "
    "rationale string, adjudicator_version string, published boolean, auto_published boolean, "
    "review_status string, reviewer string",
    "statistics": "stat_id bigint, metric string, dimension_type string, dimension_value string, value double, "
    "unit string, period string, notes string, " + PROVENANCE,
}

TRANSCRIPT = (
    "video_id string, url string, title string, channel string, published_at string, person_id bigint, "
    "mk_name string, duration_sec double, engine string, transcribed_at string, "
    "segments array<struct<start:double,`end`:double,text:string>>"
)
POSTS = (
    "person_id bigint, handle string, "
    "tweets array<struct<id:string,date:string,text:string,url:string,likes:bigint,retweets:bigint>>"
)
ROSTER = "person_id bigint, name string, party string, role string, is_mk boolean"
SERIES = (
    "series map<string,struct<label:string,unit:string,match:array<string>,note:string,"
    "sources:array<struct<org:string,url:string>>,"
    "points:array<struct<year:int,value:double,provisional:boolean>>>>"
)
CATALOG = (
    "metric string, dimension_type string, source_type string, unit string, "
    "rows array<struct<dimension_value:string,value:double,period:string,source_url:string,notes:string>>"
)
DATA_POINTS = (
    "data_points array<struct<metric:string,dimension_type:string,dimension_value:string,value:double,"
    "unit:string,period:string,source_org:string,source_url:string,confirm_quote:string,notes:string,"
    "verified:boolean>>"
)
MINISTERS = (
    "ministers array<struct<person_id:bigint,name:string,position:string,ministry:string,"
    "start_date:string,source:string>>"
)
DECISIONS = "decisions array<struct<id:string,decision:string,note:string>>"

# column -> allowed values
VOCABULARIES = {
    "source_type": c.SOURCE_TYPES,
    "stance": c.VOTE_STANCES,
    "result": c.VOTE_RESULTS,
    "statement_type": c.STATEMENT_TYPES,
    "action_type": c.ACTION_TYPES,
    "verification_status": c.VERIFICATION_STATUSES,
    "contradiction_status": c.CONTRADICTION_STATUSES,
    "outcome": c.VERDICT_OUTCOMES,
    "review_status": c.REVIEW_STATUSES,
    "assertion": c.CLAIM_ASSERTIONS,
}


def allowed(column: str, vocabulary: str | None = None) -> Column:
    """True for null or a value of the vocabulary."""
    values = VOCABULARIES[vocabulary or column]
    return F.col(column).isNull() | F.col(column).isin(*values)


def split_sourced(df: DataFrame, blank_is_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with a source link, and the rejected rows without one."""
    url = F.nullif(F.trim("source_url"), F.lit("")) if blank_is_missing else F.col("source_url")
    return df.filter(url.isNotNull()), df.filter(url.isNull()).withColumn(
        "reject_reason", F.lit("no source_url")
    )


def split_vocabulary(df: DataFrame, column: str, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is in the vocabulary, and the rejected rest."""
    ok = allowed(column, vocabulary)
    return df.filter(ok), df.filter(~ok).withColumn(
        "reject_reason", F.concat(F.lit(f"unknown {column}: "), F.col(column))
    )
