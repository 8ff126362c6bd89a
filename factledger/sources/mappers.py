"""Upstream rows to stored rows.

Input rows carry ``fields`` (MAP<STRING,STRING> of the payload) and the
provenance columns of :func:`factledger.sources.landed.stamp`. Candidate keys
are upstream column names, most trusted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions.casts import (
    first_of,
    first_text,
    stance_of,
    to_bool,
    to_date,
    to_int,
    vote_result_of,
)

PROVENANCE_COLUMNS = ["source_type", "source_name", "source_url", "source_record_id", "raw_payload", "fetched_at"]


def _int(*names: str):
    return to_int(first_of(F.col("fields"), *names))


def _text(*names: str):
    return first_text(F.col("fields"), *names)


def _flag(*names: str):
    return F.coalesce(to_bool(first_of(F.col("fields"), *names)), F.lit(False))


def _day(*names: str):
    return to_date(first_of(F.col("fields"), *names))


def map_people(rows: DataFrame) -> DataFrame:
    first, last = _text("FirstName", "first_name"), _text("LastName", "last_name")
    return rows.select(
        _int("Id", "ID", "id", "PersonID").alias("person_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat_ws(" ", first, last).alias("full_name"),
        _text("GenderDesc", "Gender", "gender").alias("gender"),
        _text("Email", "email").alias("email"),
        _flag("IsCurrent", "is_current").alias("is_current"),
        F.lit(None).cast("string").alias("current_party"),
        F.create_map().cast("map<string,string>").alias("external_ids"),
        *PROVENANCE_COLUMNS,
    )


def map_bills(rows: DataFrame) -> DataFrame:
    return rows.select(
        _int("Id", "ID", "id", "BillID").alias("bill_id"),
        _text("Name", "BillName", "name").alias("name"),
        _text("SubTypeDesc", "BillTypeDesc", "TypeDesc", "bill_type_desc").alias("bill_type_desc"),
        _text("StatusDesc", "status_desc", "StatusID", "StatusId").alias("status_desc"),
        _int("KnessetNum", "knesset_num").cast("int").alias("term_num"),
        _text("Summary", "summary").alias("summary"),
        *PROVENANCE_COLUMNS,
    )


def map_sponsorships(rows: DataFrame) -> DataFrame:
    """Bill initiations; rows without a bill id are dropped."""
    return rows.select(
        _int("PersonID", "PersonId", "person_id").alias("person_id"),
        _int("BillID", "BillId", "bill_id").alias("bill_id"),
        _flag("IsInitiator", "is_initiator").alias("is_initiator"),
        _int("Ordinal", "ordinal").cast("int").alias("ordinal"),
        *PROVENANCE_COLUMNS,
    ).filter(F.col("bill_id").isNotNull())


def map_roles(rows: DataFrame) -> DataFrame:
    return rows.select(
        _int("PersonID", "PersonId", "person_id").alias("person_id"),
        _int("PositionID", "PositionId", "position_id").alias("position_id"),
        _text("DutyDesc", "PositionDesc", "position_desc").alias("position_desc"),
        _int("KnessetNum", "knesset_num").cast("int").alias("term_num"),
        _int("GovernmentNum", "government_num").cast("int").alias("government_num"),
        _text("GovMinistryName", "MinistryName", "ministry_name").alias("ministry_name"),
        _text("FactionName", "faction_name").alias("faction_name"),
        _text("CommitteeName", "committee_name").alias("committee_name"),
        _day("StartDate", "start_date").alias("start_date"),
        _day("FinishDate", "finish_date").alias("finish_date"),
        _flag("IsCurrent", "is_current").alias("is_current"),
        *PROVENANCE_COLUMNS,
    )


def map_vote_events(rows: DataFrame) -> DataFrame:
    """Vote headers; the item description is preferred over the session item's."""
    return rows.select(
        _int("vote_id", "VoteId", "id", "Id").alias("event_id"),
        _text("vote_item_dscr", "sess_item_dscr", "title", "Title").alias("title"),
        _day("vote_date", "VoteDate", "date").alias("vote_date"),
        _int("knesset_num", "KnessetNum").cast("int").alias("term_num"),
        _int("session_num", "SessionNum", "session_id").cast("int").alias("session_num"),
        vote_result_of(first_of(F.col("fields"), "is_accepted", "IsAccepted", "accepted")).alias("result"),
        _int("total_for", "TotalFor").cast("int").alias("total_for"),
        _int("total_against", "TotalAgainst").cast("int").alias("total_against"),
        _int("total_abstain", "TotalAbstain").cast("int").alias("total_abstain"),
        *PROVENANCE_COLUMNS,
    )


def map_votes(rows: DataFrame) -> DataFrame:
    """Roll-call rows (with ``person_id`` from :func:`factledger.sources.landed.roll_call`)."""
    raw = first_of(F.col("fields"), "vote_result", "VoteResult", "result", "vote_result_type")
    return rows.select(
        "person_id",
        _int("vote_id", "VoteId", "VoteID").alias("event_id"),
        stance_of(raw).alias("stance"),
        *PROVENANCE_COLUMNS,
    ).filter(F.col("event_id").isNotNull())
