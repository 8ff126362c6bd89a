"""Text cleaning, labels and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITESPACE))


def clean_text(s: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(s), F.lit(""))


def person_name_key(s: Column) -> Column:
    """Name without quote marks, used to line up rosters."""
    return F.translate(strip(F.coalesce(s, F.lit(""))), "\"'׳״", "")


def alnum_key(s: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}\p{N}]", ""))


def contains_any(s: Column, words: Sequence[str]) -> Column:
    """True when ``s`` holds one of the literal ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | s.contains(word)
    return F.coalesce(hit, F.lit(False))


def first_matching(s: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Label of the first (needle, label) whose needle is contained in ``s``."""
    chain = F.lit(None).cast("string")
    for needle, label in reversed(table):
        chain = F.when(s.contains(needle), F.lit(label)).otherwise(chain)
    return chain


def preview(s: Column, size: int = 200) -> Column:
    """First ``size`` characters, with dots only when something was cut."""
    s = strip(F.coalesce(s, F.lit("")))
    return F.when(F.length(s) > size, F.concat(F.left(s, F.lit(size)), F.lit("..."))).otherwise(s)


def short_org(s: Column, size: int = 60) -> Column:
    """Organisation name before a dash clause or a bracket."""
    return F.left(F.substring_index(F.substring_index(s, " — ", 1), " (", 1), F.lit(size))


def moment_link(url: Column, start: Column) -> Column:
    """Link to the second a passage starts at; '#' without a url."""
    joiner = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    second = F.floor(F.coalesce(start.cast("double"), F.lit(0.0))).cast("string")
    return F.when(F.nullif(url, F.lit("")).isNull(), F.lit("#")).otherwise(
        F.concat(url, joiner, F.lit("t="), second)
    )


def clock_label(start: Column) -> Column:
    """``mm:ss`` of a start second."""
    second = F.floor(F.coalesce(start.cast("double"), F.lit(0.0))).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(second / 60).cast("bigint"), second % 60)


def minutes(seconds: Column) -> Column:
    """Whole minutes of a duration, null when unknown or zero."""
    seconds = seconds.cast("double")
    return F.when(seconds != 0, F.floor(seconds / 60 + 0.5).cast("int"))


def person_slug(official_id: Column, internal_id: Column) -> Column:
    """``person-<id>``; an official id of 0 counts as missing."""
    chosen = F.coalesce(F.nullif(official_id.cast("bigint"), F.lit(0).cast("bigint")), internal_id.cast("bigint"))
    return F.concat(F.lit("person-"), chosen.cast("string"))


def unit_label(unit: Column) -> Column:
    """Display unit; unknown units pass through."""
    from factledger.constants import UNIT_LABELS

    labels = F.create_map(*[F.lit(x) for pair in UNIT_LABELS.items() for x in pair])
    return F.coalesce(labels[unit], unit)


def transcript_parts(segments: Column, size: int = 14000) -> Column:
    """Transcript text of an array of segments, in consecutive parts one prompt can carry.

    Parts end at segment borders: a part takes segments while its text has at most
    ``size`` characters. Only a single segment longer than that is a part on its
    own, uncut. No text is left unread; an empty transcript has one empty part.
    """
    texts = F.transform(segments, lambda s: F.coalesce(s["text"], F.lit("")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, text: Column) -> Column:
        joined = F.concat(state["open"], F.lit(" "), text)
        fits = F.char_length(joined) <= size
        return F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), text.alias("open"))).otherwise(
            F.struct(
                F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
                F.when(fits, joined).otherwise(text).alias("open"),
            )
        )

    return F.aggregate(texts, start, add, lambda s: F.array_append(s["done"], F.coalesce(s["open"], F.lit(""))))
