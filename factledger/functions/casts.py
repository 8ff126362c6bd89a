"""Best-effort casts for upstream values: unknown becomes null, nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger.constants import FALSE_WORDS, STANCE_BY_CODE, STANCE_BY_LABEL, TRUE_WORDS
from factledger.functions.text import clean_text, strip

def to_int(s: Column) -> Column:
    """Whole number from text; ``965.0`` truncates, booleans and words give null."""
    return strip(s.cast("string")).try_cast("decimal(38,18)").try_cast("bigint")


def to_bool(s: Column) -> Column:
    t = F.lower(strip(s.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def to_date(s: Column) -> Column:
    """ISO date or date-time, or an epoch tick ``/Date(ms+off)/`` read in UTC.

    A date-time with an offset keeps its own calendar day, so the day is taken
    from the text and never goes through a time zone.
    """
    t = strip(s.cast("string"))
    inner = F.regexp_extract(t, r"^/Date\((.[^+-]*)([+-].*)?\)/$", 1)
    millis = F.when(F.trim(inner).rlike(r"^[+-]?\d+$"), F.trim(inner).try_cast("bigint"))
    day_no = F.floor(millis / F.lit(86400000))
    tick_day = F.when(
        day_no.between(-719162, 2932896),
        F.date_add(F.lit("1970-01-01").cast("date"), day_no.cast("int")),
    )
    head = F.left(t, F.lit(10))
    iso_day = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))
    packed = F.when(
        t.rlike(r"^\d{8}(T\d{2}(\d{2}){0,2}(\.\d+)?([+-]\d{2}:?\d{2}|Z)?)?$"),
        F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date"),
    )
    return F.when(t.startswith("/Date("), tick_day).otherwise(F.coalesce(iso_day, packed))


def year_in(s: Column) -> Column:
    """Leftmost run of four digits as a year; '0000' counts as missing."""
    found = F.nullif(F.regexp_extract(F.coalesce(s, F.lit("")), r"(\d{4})", 1), F.lit(""))
    return F.nullif(found.cast("int"), F.lit(0))


def start_year(s: Column) -> Column:
    """Year a date text starts with; zero and blank become null."""
    return F.nullif(F.left(s.cast("string"), F.lit(4)).try_cast("int"), F.lit(0))


def stance_of(value: Column) -> Column:
    """Vote stance from a result code or a label; unclear is ``na``."""
    codes = F.create_map(*[x for k, v in STANCE_BY_CODE.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    labels = F.create_map(*[F.lit(x) for pair in STANCE_BY_LABEL.items() for x in pair])
    return F.coalesce(
        codes[to_int(value)],
        labels[F.lower(strip(value.cast("string")))],
        F.lit("na"),
    )


def vote_result_of(accepted: Column) -> Column:
    flag = to_bool(accepted)
    return F.when(flag, "passed").when(~flag, "failed").otherwise("unknown")


def padded_member_key(member_id: Column) -> Column:
    """Nine-digit member key; only shorter digit strings are padded (lpad would cut longer ones)."""
    t = strip(member_id.cast("string"))
    return F.when(t.rlike(r"^\d{1,8}$"), F.lpad(t, 9, "0")).otherwise(t)


def first_of(payload: Column, *names: str) -> Column:
    """First present value among candidate keys of a MAP<STRING,STRING> payload."""
    return F.coalesce(*[payload[name] for name in names])


def first_text(payload: Column, *names: str) -> Column:
    return clean_text(first_of(payload, *names))
