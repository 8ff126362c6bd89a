"""List and detail queries: filters, nested parents, child counts, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import NO_PARTY
from factledger.functions.text import strip
from factledger.operators.ranking import top_rows

MAX_PAGE = 200
DEFAULT_PAGE = 50


# --- filters -----------------------------------------------------------------
def like_any(query: str | None, *columns: str) -> Column:
    """Case-insensitive substring match on any column; ``%`` and ``_`` act as wildcards."""
    if not query:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return hit


def directory_filter(roster: DataFrame, query: str) -> DataFrame:
    """Name or party contains the query, case-sensitive."""
    q = (query or "").strip()
    if not q:
        return roster
    blank = F.lit("")
    return roster.filter(F.coalesce("name", blank).contains(q) | F.coalesce("party", blank).contains(q))


def list_statements(statements: DataFrame, query: str | None = None, person_id: int | None = None) -> DataFrame:
    out = statements.filter(like_any(query, "claim", "topic"))
    return out if person_id is None else out.filter(F.col("person_id") == person_id)


# --- orders -------------------------------------------------------------------
def newest_first(date: str, tie: str) -> list[Column]:
    return [F.col(date).desc_nulls_last(), F.col(tie).asc()]


def by_ordinal(ordinal: str, tie: str) -> list[Column]:
    return [F.col(ordinal).asc_nulls_last(), F.col(tie).asc()]


# --- pages ------------------------------------------------------------------------
def page(df: DataFrame, order: Sequence[Column | str], limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One page in a total order; a distributed top-k, never a full sort into one task.

    For deep pages use :func:`page_after`, whose cost does not grow with depth.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset >= 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: object | None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """Next page by key (keyset paging); the filter reaches the scan."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE}")
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def envelope(df: DataFrame, order: Sequence[Column | str], limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Page rows, each with the total of matching rows, the limit and the offset."""
    total = df.agg(F.count("*")).scalar()
    return page(df, order, limit, offset).withColumns(
        {"total": total, "limit": F.lit(limit), "offset": F.lit(offset)}
    )


# --- details ----------------------------------------------------------------------
def child_counts(people: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Number of child rows per person for several child tables.

    Children are counted before the join; all tables share one grouping.
    """
    names = list(children)
    tagged = None
    for name in names:
        part = children[name].select("person_id", F.lit(name).alias("kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("person_id").agg(
        *[F.count_if(F.col("kind") == name).alias(f"{name}_count") for name in names]
    )
    out = people.join(counts, "person_id", "left")
    return out.withColumns({f"{n}_count": F.coalesce(f"{n}_count", F.lit(0)) for n in names})


def votes_with_event(votes: DataFrame, events: DataFrame) -> DataFrame:
    """Votes with the nested event and its title and date copied to the top."""
    nested = events.select(
        "event_id", F.struct(*[c for c in events.columns]).alias("event")
    )
    out = votes.join(nested, "event_id", "left")
    return out.withColumns({"event_title": F.col("event.title"), "event_date": F.col("event.vote_date")})


def sponsorships_with_bill(sponsorships: DataFrame, bills: DataFrame) -> DataFrame:
    nested = bills.select("bill_id", F.struct(*bills.columns).alias("bill"))
    return sponsorships.join(nested, "bill_id", "left")


# --- profile pieces ------------------------------------------------------------------
def sample_bills(sponsorships: DataFrame, bills: DataFrame, k: int = 12) -> DataFrame:
    """Per person the first ``k`` sponsorships, lead initiator first; rows without a bill drop out after the cut."""
    order = [F.desc("is_initiator"), F.col("ordinal").asc_nulls_last(), F.col("bill_id").asc()]
    cut = top_rows(sponsorships, ["person_id"], order, k, rank="bill_no")
    details = bills.select("bill_id", "name", "term_num", F.col("source_url").alias("bill_url"))
    return cut.join(details, "bill_id").select(
        "person_id", "bill_no", "bill_id", "name", "term_num", F.col("is_initiator").alias("is_lead_initiator"), "bill_url"
    )


def recent_votes(votes: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """Per person the latest ``k`` votes by id."""
    cut = top_rows(votes, ["person_id"], [F.desc("vote_id")], k, rank="recent_no")
    heads = events.select("event_id", "title", "vote_date", F.col("source_url").alias("event_url"))
    return cut.join(heads, "event_id", "left").select(
        "person_id",
        "recent_no",
        "vote_id",
        "stance",
        F.col("title").alias("event_title"),
        F.col("vote_date").alias("event_date"),
        F.coalesce("source_url", "event_url").alias("source_url"),
    )


def latest_posts(posts: DataFrame, k: int = 15) -> DataFrame:
    """The first ``k`` posts of a profile in stored order."""
    return top_rows(posts, ["person_id"], ["pos"], k, rank="post_no")


def party_sizes(roster: DataFrame) -> DataFrame:
    """Members per party, largest first; no party gets its own label."""
    party = strip(F.coalesce(F.nullif("party", F.lit("")), F.lit(NO_PARTY)))
    return (
        roster.groupBy(party.alias("party")).agg(F.count("*").alias("members")).orderBy(F.desc("members"), "party")
    )


def role_cards(appointments: DataFrame, matched: DataFrame) -> DataFrame:
    """All roles, those of one person together and in stored order; people with a matched series first.

    Cards stay in long form (one row per role), so a person may hold any number
    of roles; ``card_pos`` orders the cards and ``role_count`` is the card's size.
    """
    cards = appointments.groupBy("person_id").agg(
        F.min_by("name", "pos").alias("card_name"), F.count("*").alias("role_count"), F.min("pos").alias("card_pos")
    )
    charted = matched.select("person_id").distinct().withColumn("charted", F.lit(True))
    heads = cards.join(charted, "person_id", "left").withColumn("charted", F.coalesce("charted", F.lit(False)))
    roles = appointments.select("person_id", "pos", "position", "ministry", "start_date")
    return roles.join(heads, "person_id").orderBy(F.desc("charted"), "card_pos", "person_id", "pos")
