"""Identity: office holders, name reconciliation across sources, account matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.constants import MIN_FOLLOWERS, OFFICE_PREFIXES, PUBLIC_FIGURE_BIO
from factledger.functions.casts import to_int
from factledger.functions.text import alnum_key, contains_any, strip
from factledger.operators.merge import with_entry
from factledger.operators.ranking import top_rows


def is_office_holder(description: Column, prefixes=OFFICE_PREFIXES) -> Column:
    text = strip(F.coalesce(description, F.lit("")))
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return hit


def current_holders(roles: DataFrame, prefixes=OFFICE_PREFIXES) -> DataFrame:
    """Current roles with a ministry whose description names an office."""
    return roles.filter(F.coalesce("is_current", F.lit(False)) & F.col("ministry_name").isNotNull()).filter(
        is_office_holder(F.col("position_desc"), prefixes)
    )


def ministers(roles: DataFrame, roster: DataFrame, persons: DataFrame) -> DataFrame:
    """Holders with a name from the roster, else from the person table, else ''; ordered by position."""
    held = current_holders(roles)
    listed = roster.groupBy("person_id").agg(F.max_by("name", "pos").alias("roster_name"))
    return (
        held.join(listed, "person_id", "left")
        .join(persons.select("person_id", "full_name"), "person_id", "left")
        .select(
            "person_id",
            F.coalesce("roster_name", "full_name", F.lit("")).alias("name"),
            strip(F.coalesce("position_desc", F.lit(""))).alias("position"),
            strip(F.coalesce("ministry_name", F.lit(""))).alias("ministry"),
            "start_date",
            F.col("source_url").alias("source"),
        )
        .orderBy("position", "person_id")
    )


def directory_names(directory: DataFrame) -> DataFrame:
    """Member directory with one last and one first name per row and a numeric vote id.

    The native name columns come first, then the English ones, then the generic ones.
    """
    return directory.select(
        F.coalesce("mk_individual_name", "mk_individual_name_eng", "LastName").alias("last_name"),
        F.coalesce("mk_individual_first_name", "mk_individual_first_name_eng", "FirstName").alias("first_name"),
        to_int(F.coalesce("vip_id", "mk_id", *[c for c in directory.columns if c in ("Id", "ID")])).alias("votes_id"),
        F.col("mk_individual_id").cast("string").alias("individual_id"),
        (F.col("mk_individual_name").isNull() | F.col("mk_individual_first_name").isNull()).alias("fallback"),
        "pos",
    ).filter(F.col("votes_id").isNotNull())


def reconcile(people: DataFrame, directory: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write ``votes_id`` into the id map of every person found by exact name.

    People who already have one keep it unless ``force``; the second frame lists
    the people who could not be matched.
    """
    names = directory_names(directory)
    hits = top_rows(names, ["first_name", "last_name"], ["fallback", "pos"])  # native names are tried first
    held = to_int(F.col("external_ids")["votes_mk_id"])
    keyed = people.withColumns(
        {
            "_first": strip(F.coalesce("first_name", F.lit(""))),
            "_last": strip(F.coalesce("last_name", F.lit(""))),
            "_held": F.lit(None).cast("bigint") if force else held,
        }
    )
    joined = keyed.join(
        hits.select(F.col("first_name").alias("_first"), F.col("last_name").alias("_last"), "votes_id"),
        ["_first", "_last"],
        "left",
    )
    named = (F.col("_first") != "") | (F.col("_last") != "")
    found = F.coalesce("_held", F.when(named, F.col("votes_id")))
    out = joined.withColumn("_found", found).withColumn(
        "external_ids", with_entry(F.col("external_ids"), "votes_mk_id", F.col("_found").cast("string"))
    )
    missing = out.filter(F.col("_found").isNull()).select("person_id", "first_name", "last_name")
    return out.select(*people.columns), missing


def enrich(people: DataFrame, enrichment: DataFrame, key: str = "open_knesset") -> DataFrame:
    """Attach the first enrichment row per member under one extra map key; nothing else changes.

    ``enrichment`` has (individual_id, payload, pos); people carry ``individual_id``.
    """
    first = top_rows(
        enrichment.withColumn("individual_id", strip(F.col("individual_id").cast("string"))), ["individual_id"], ["pos"]
    )
    joined = people.join(first.select("individual_id", "payload"), "individual_id", "left")
    return joined.withColumn(
        "external_ids", with_entry(F.col("external_ids"), key, F.col("payload"))
    ).select(*people.columns)


def match_accounts(
    candidates: DataFrame, bio_words=PUBLIC_FIGURE_BIO, min_followers: int = MIN_FOLLOWERS
) -> DataFrame:
    """First candidate account per person that passes the identity gate.

    ``candidates`` has (person_id, name, pos, username, display_name, bio,
    followers, verified, government).
    """
    target, shown = alnum_key(F.col("name")), alnum_key(F.col("display_name"))
    same_name = (target != "") & (shown != "") & (shown.contains(target) | target.contains(shown))
    public = (
        contains_any(F.lower(F.coalesce("bio", F.lit(""))), [w.lower() for w in bio_words])
        | F.coalesce("verified", F.lit(False))
        | F.coalesce("government", F.lit(False))
        | (F.coalesce("followers", F.lit(0)) >= min_followers)
    )
    passed = candidates.filter(same_name & public)
    return top_rows(passed, ["person_id"], ["pos"]).select("person_id", "username", "pos")
