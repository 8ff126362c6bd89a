"""Scorecards, listings, profiles and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger import schemas
from factledger.constants import OFFICE_PREFIXES
from factledger.operators.merge import append_unnamed
from factledger.operators.ranking import with_position
from factledger.plans import listings, people, scorecard
from factledger.queries import register
from factledger.sources import sinks

PART = """part_ AS (SELECT person_id, count_if(stance IN ('for','against','abstain'))::BIGINT AS "cast",
      count_if(stance = 'absent')::BIGINT AS absent FROM votes GROUP BY person_id),
  part2 AS (SELECT *, "cast" + absent AS eligible, CASE WHEN "cast" + absent > 0 THEN
      CAST(format('{:.1f}', "cast" / ("cast" + absent) * 100) AS DOUBLE) END AS score FROM part_),
  leg AS (SELECT person_id, count(*) AS bills_sponsored, count_if(is_initiator)::BIGINT AS as_lead_initiator
    FROM sponsorships GROUP BY person_id)"""


@register(
    "stance_counts", "votes", "SELECT person_id, stance, count(*) AS n FROM votes GROUP BY ALL"
)
def stance_counts(v):
    return scorecard.stance_counts(v.votes())


@register(
    "participation",
    "votes sponsorships",
    f"""WITH {PART}, st AS (SELECT person_id, string_agg(stance || '=' || n, ',' ORDER BY stance) AS by_stance FROM (
        SELECT person_id, stance, count(*) AS n FROM votes GROUP BY ALL) GROUP BY person_id)
    SELECT person_id, "cast", absent, eligible, score, by_stance FROM part2 JOIN st USING (person_id)""",
)
def participation(v):
    """Votes cast out of votes eligible, for everybody in one pass."""
    entries = F.array_sort(F.transform(F.map_entries("by_stance"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return scorecard.participation(v.votes()).withColumn("by_stance", F.array_join(entries, ","))


@register("legislative_activity", "votes sponsorships", f"WITH {PART} SELECT * FROM leg")
def legislative_activity(v):
    return scorecard.legislative_activity(v.sponsorships())


def _dimensions(v):
    return scorecard.dimension_table(v.actors(), v.votes(), v.sponsorships())


@register(
    "scorecard_dimensions",
    "actors votes sponsorships",
    f"""WITH {PART}, d(no, key, weight) AS (VALUES (1,'participation',0.15::DOUBLE), (2,'legislative_activity',0.15),
      (3,'integrity',0.3), (4,'promise_keeping',0.2), (5,'financial_conflict',0.2))
    SELECT a.person_id, key, weight, CASE no WHEN 1 THEN coalesce(eligible,0) > 0 WHEN 2 THEN coalesce(bills_sponsored,0) > 0
        ELSE false END AS available, no = 1 AND coalesce(eligible,0) > 0 AS scorable, CASE WHEN no = 1 THEN score END AS score
    FROM actors a CROSS JOIN d LEFT JOIN part2 USING (person_id) LEFT JOIN leg USING (person_id)""",
)
def scorecard_dimensions(v):
    """Five dimensions per person, three of them pending."""
    return _dimensions(v).select("person_id", "key", "weight", "available", "scorable", "score")


@register(
    "composite_index",
    "actors votes sponsorships",
    f"""WITH {PART} SELECT a.person_id, score AS index_value, CASE WHEN score IS NULL THEN 0 ELSE 1 END::BIGINT AS coverage_scored,
      CAST(5 AS BIGINT) AS coverage_total, 'preliminary' AS label, CASE WHEN score IS NULL THEN '' ELSE 'participation' END AS included,
      'Index reflects ' || CASE WHEN score IS NULL THEN 0 ELSE 1 END || ' of 5 dimensions; the rest await Phase 2 data sources.' AS note
    FROM actors a LEFT JOIN part2 USING (person_id)""",
)
def composite_index(v):
    """Coverage-aware index of every person."""
    out = scorecard.composite_index(_dimensions(v))
    return out.select(
        "person_id",
        "index_value",
        "coverage_scored",
        "coverage_total",
        "label",
        F.array_join("included", ",").alias("included"),
        "note",
    )


@register(
    "composite_index_weighted",
    "actors votes sponsorships",
    f"""WITH {PART}, x AS (SELECT a.person_id, score AS s1, least(bills_sponsored, 100)::DOUBLE AS s2 FROM actors a
        LEFT JOIN part2 USING (person_id) LEFT JOIN leg USING (person_id))
    SELECT person_id, CAST(format('{{:.1f}}', 0.0::DOUBLE + s1 * (0.6::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE))
        + s2 * (0.2::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE))) AS DOUBLE) AS index_value,
      CAST(2 AS BIGINT) AS coverage_scored, 'partial' AS label, 0.6::DOUBLE / (0.6::DOUBLE + 0.2::DOUBLE) AS first_share FROM x""",
)
def composite_index_weighted(v):
    """The index with a second scored dimension and the caller's weights."""
    own = {"participation": 0.6, "legislative_activity": 0.2}
    dims = scorecard.dimension_table(v.actors(), v.votes(), v.sponsorships(), own)
    is_bills = F.col("key") == "legislative_activity"
    bills = F.least(F.col("raw")["bills_sponsored"], F.lit(100)).cast("double")
    dims = dims.withColumns(
        {"scorable": F.col("scorable") | is_bills, "score": F.when(is_bills, bills).otherwise(F.col("score"))}
    )
    out = scorecard.composite_index(dims)
    return out.select(
        "person_id", "index_value", "coverage_scored", "label", F.col("weights_used")["participation"].alias("first_share")
    )


# --- listings ---------------------------------------------------------------------
@register(
    "people_page",
    "people",
    """SELECT person_id, full_name, party, (SELECT count(*) FROM people WHERE full_name ILIKE '%mer#00000012%') AS total
    FROM people WHERE full_name ILIKE '%mer#00000012%' ORDER BY full_name, person_id LIMIT 5 OFFSET 3""",
)
def people_page(v):
    """One page of a name search, with the total."""
    hits = v.people().filter(listings.like_any("MER#00000012", "full_name"))
    out = listings.envelope(hits, ["full_name", "person_id"], limit=5, offset=3)
    return out.select("person_id", "full_name", "party", "total")


@register(
    "people_after",
    "people",
    "SELECT person_id, full_name FROM people WHERE person_id > 100 ORDER BY person_id LIMIT 50",
)
def people_after(v):
    """The next page by key."""
    return listings.page_after(v.people(), "person_id", 100).select("person_id", "full_name")


@register(
    "statement_search",
    "statements",
    "SELECT statement_id, topic FROM statements WHERE claim ILIKE '%\"k\": 6_}%' OR topic ILIKE '%SIGN%'",
)
def statement_search(v):
    """Statements by text in claim or topic; ``_`` is a wildcard."""
    return listings.list_statements(v.statements(), '"K": 6_}').select("statement_id", "topic").unionByName(
        listings.list_statements(v.statements(), "SIGN").select("statement_id", "topic")
    ).distinct()


@register(
    "statement_page",
    "statements",
    "SELECT statement_id, statement_date FROM statements ORDER BY statement_date DESC, statement_id LIMIT 50",
)
def statement_page(v):
    """The newest statements."""
    order = listings.newest_first("statement_date", "statement_id")
    return listings.page(v.statements(), order).select("statement_id", "statement_date")


@register(
    "sponsorship_page",
    "sponsorships",
    """SELECT person_id, bill_id, ordinal FROM sponsorships ORDER BY ordinal ASC NULLS LAST, bill_id, person_id LIMIT 200 OFFSET 100""",
)
def sponsorship_page(v):
    """Sponsorships by ordinal, missing ordinals last."""
    order = [*listings.by_ordinal("ordinal", "bill_id"), F.col("person_id")]
    return listings.page(v.sponsorships(), order, 200, 100).select("person_id", "bill_id", "ordinal")


@register(
    "child_counts",
    "actors votes sponsorships statements actions",
    """SELECT a.person_id, (SELECT count(DISTINCT l_returnflag) FROM lineitem x WHERE x.l_suppkey = a.person_id) AS roles_count,
      (SELECT count(*) FROM sponsorships x WHERE x.person_id = a.person_id) AS bills_count,
      (SELECT count(*) FROM votes x WHERE x.person_id = a.person_id) AS votes_count,
      (SELECT count(*) FROM statements x WHERE x.person_id = a.person_id) AS statements_count,
      (SELECT count(*) FROM actions x WHERE x.person_id = a.person_id) AS actions_count FROM actors a""",
)
def child_counts(v):
    """Related records per person."""
    roles = v.table("lineitem").select(F.col("l_suppkey").alias("person_id"), "l_returnflag").distinct()
    children = {"roles": roles, "bills": v.sponsorships(), "votes": v.votes(), "statements": v.statements(), "actions": v.actions()}
    return listings.child_counts(v.actors().select("person_id"), children)


@register(
    "votes_with_event",
    "votes vote_events",
    """SELECT person_id, v.event_id, stance, title AS event_title, vote_date AS event_date, result FROM votes v
    LEFT JOIN vote_events e USING (event_id)""",
)
def votes_with_event(v):
    """Votes with their event nested and its title and date copied up."""
    out = listings.votes_with_event(v.votes(), v.vote_events())
    return out.select("person_id", "event_id", "stance", "event_title", "event_date", F.col("event.result").alias("result"))


@register(
    "sponsorships_with_bill",
    "sponsorships bills",
    "SELECT person_id, bill_id, name AS bill_name, term_num FROM sponsorships LEFT JOIN bills USING (bill_id)",
)
def sponsorships_with_bill(v):
    out = listings.sponsorships_with_bill(v.sponsorships(), v.bills())
    return out.select("person_id", "bill_id", F.col("bill.name").alias("bill_name"), F.col("bill.term_num").alias("term_num"))


SAMPLE = """sample AS (SELECT person_id, CAST(rn AS INTEGER) AS bill_no, s.bill_id, name, term_num, is_initiator AS is_lead_initiator
    FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY is_initiator DESC, ordinal ASC NULLS LAST, bill_id) AS rn
      FROM sponsorships) s JOIN bills USING (bill_id) WHERE rn <= 12)"""
RECENT = """recent AS (SELECT person_id, CAST(rn AS INTEGER) AS recent_no, vote_id, stance, title AS event_title, vote_date AS event_date,
      r.source_url FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY vote_id DESC) AS rn FROM votes) r
    LEFT JOIN vote_events USING (event_id) WHERE rn <= 20)"""


@register("sample_bills", "sponsorships bills", f"WITH {SAMPLE} SELECT * FROM sample")
def sample_bills(v):
    """Twelve bills per person, lead initiator first."""
    return listings.sample_bills(v.sponsorships(), v.bills()).drop("bill_url")


@register("recent_votes", "votes vote_events", f"WITH {RECENT} SELECT * FROM recent")
def recent_votes(v):
    """Latest twenty votes per person."""
    return listings.recent_votes(v.votes(), v.vote_events())


@register(
    "party_sizes",
    "people",
    """SELECT party, count(*) AS members, row_number() OVER (ORDER BY count(*) DESC, party) AS position FROM people GROUP BY party""",
)
def party_sizes(v):
    return with_position(listings.party_sizes(v.people()))


@register(
    "directory_filter",
    "people",
    "SELECT person_id, party FROM people WHERE contains(full_name, '0000007') OR contains(party, 'NATION_7')",
)
def directory_filter(v):
    """Directory rows matching on name or party."""
    both = listings.directory_filter(v.people().withColumnRenamed("full_name", "name"), "0000007")
    party = listings.directory_filter(v.people().withColumnRenamed("full_name", "name"), "NATION_7")
    return both.unionByName(party).select("person_id", "party").distinct()


@register(
    "person_profiles",
    "actors votes vote_events sponsorships bills",
    f"""WITH {PART}, {SAMPLE}, {RECENT},
      b AS (SELECT person_id, string_agg(bill_id || ':' || name || ':' || is_lead_initiator, ',' ORDER BY bill_no) AS bills
        FROM sample GROUP BY person_id),
      r AS (SELECT person_id, string_agg(stance || ':' || coalesce(event_title, '') || ':' || source_url, ',' ORDER BY recent_no) AS recent
        FROM recent GROUP BY person_id),
      n AS (SELECT person_id, count(*) AS votes_count FROM votes GROUP BY person_id),
      o AS (SELECT l_suppkey AS person_id, count(*) AS roles_count FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) GROUP BY 1)
    SELECT 'person-' || a.person_id AS slug, a.person_id, a.name AS full_name, party, score AS index_value,
      CASE WHEN score IS NULL THEN '' ELSE 'participation=1.0' END AS weights_used,
      coalesce(roles_count, 0) AS roles_count, coalesce(bills_sponsored, 0) AS bills_count, coalesce(votes_count, 0) AS votes_count,
      'participation computed over ' || coalesce(votes_count, 0) || ' ingested votes' AS votes_note,
      'participation=' || (coalesce("cast", 0) + coalesce(absent, 0) > 0) || ',legislative_activity=' || (coalesce(bills_sponsored, 0) > 0)
        || ',integrity=false,promise_keeping=false,financial_conflict=false' AS dimensions,
      'Index reflects ' || CASE WHEN score IS NULL THEN 0 ELSE 1 END || ' of 5 dimensions; the rest await Phase 2 data sources.' AS notes,
      coalesce(bills, '') AS bills, coalesce(recent, '') AS recent_votes, 'votes' AS sources
    FROM actors a LEFT JOIN part2 USING (person_id) LEFT JOIN leg USING (person_id) LEFT JOIN n USING (person_id)
      LEFT JOIN o USING (person_id) LEFT JOIN b USING (person_id) LEFT JOIN r USING (person_id)""",
)
def person_profiles(v):
    """Whole profile documents; their nested parts are written out as text to be compared."""
    none = F.lit(None).cast("string")
    people = v.actors().select(
        "person_id",
        F.col("person_id").alias("official_id"),
        F.col("name").alias("full_name"),
        none.alias("first_name"),
        none.alias("last_name"),
        F.lit(True).alias("is_current"),
        "party",
        none.alias("source_url"),
    )
    roles = v.table("lineitem").select(F.col("l_suppkey").alias("person_id"), "l_returnflag").distinct()
    docs = sinks.person_profiles(
        people,
        roles,
        v.votes(),
        v.vote_events(),
        v.sponsorships(),
        v.bills(),
        F.lit("2026-01-01T00:00:00Z"),
        {"votes": "https://rollcall.example/"},
    )

    def text(column, *parts):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[p(x) for p in parts])), ",")

    return docs.select(
        "slug",
        "person_id",
        "politician.full_name",
        "politician.party",
        F.col("scorecard.index.value").alias("index_value"),
        F.array_join(
            F.transform(F.map_entries("scorecard.index.weights_used"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("weights_used"),
        F.col("counts.roles").alias("roles_count"),
        F.col("counts.bills").alias("bills_count"),
        F.col("counts.votes").alias("votes_count"),
        F.col("votes_ingested_note").alias("votes_note"),
        F.array_join(
            F.transform("scorecard.dimensions", lambda d: F.concat(d["key"], F.lit("="), d["available"].cast("string"))), ","
        ).alias("dimensions"),
        F.array_join("scorecard.notes", ",").alias("notes"),
        text("sample_bills", lambda b: b["bill_id"], lambda b: b["name"], lambda b: b["is_lead_initiator"].cast("string")).alias("bills"),
        text("recent_votes", lambda r: r["stance"], lambda r: F.coalesce(r["event_title"], F.lit("")), lambda r: r["source_url"]).alias(
            "recent_votes"
        ),
        F.array_join(F.map_keys("sources"), ",").alias("sources"),
    )


@register(
    "profile_manifest",
    "actors",
    """SELECT 'person-' || person_id AS slug, name AS full_name, party, 'person-' || person_id || '.json' AS file FROM actors
    UNION ALL SELECT 'person-old-' || n_nationkey, n_name, NULL, 'old.json' FROM nation""",
)
def profile_manifest(v):
    """Manifest after an export: new slugs replaced, others kept."""
    a = v.actors().select(
        F.concat(F.lit("person-"), F.col("person_id")).alias("slug"),
        F.col("name").alias("full_name"),
        "party",
        F.lit(1.0).alias("index_value"),
    )
    stale = a.select("slug", F.lit("stale").alias("full_name"), "party", F.lit("stale.json").alias("file"), F.lit(0.0).alias("index_value"))
    old = v.table("nation").select(
        F.concat(F.lit("person-old-"), F.col("n_nationkey")).alias("slug"),
        F.col("n_name").alias("full_name"),
        F.lit(None).cast("string").alias("party"),
        F.lit("old.json").alias("file"),
        F.lit(0.0).alias("index_value"),
    )
    return sinks.update_manifest(old.unionByName(stale), a).select("slug", "full_name", "party", "file")


# --- identity -------------------------------------------------------------------------
def _directory(v):
    """One directory row per order: the customer's name with the order as vote id."""
    blank = F.lit(None).cast("string")
    return v.table("orders").select(
        F.when(
            F.col("o_orderpriority") == "1-URGENT", F.lpad(F.col("o_custkey").cast("string"), 9, "0")
        ).alias("mk_individual_name"),
        F.when(F.col("o_orderstatus") != "P", "Customer").alias("mk_individual_first_name"),
        blank.alias("mk_individual_name_eng"),
        F.lit("Customer").alias("mk_individual_first_name_eng"),
        blank.alias("LastName"),
        blank.alias("FirstName"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(" ")).alias("vip_id"),
        blank.alias("mk_id"),
        blank.alias("Id"),
        F.col("o_custkey").alias("mk_individual_id"),
        F.col("o_orderkey").alias("pos"),
    )


def _customers(v):
    c = v.table("customer")
    name = F.split("c_name", "#")
    held = F.col("c_acctbal") < 0
    ids = F.when(held, F.create_map(F.lit("votes_mk_id"), F.lit("-5"), F.lit("x"), F.lit("1"))).otherwise(
        F.create_map(F.lit("x"), F.lit("1"))
    )
    return c.select(
        F.col("c_custkey").alias("person_id"),
        name[0].alias("first_name"),
        name[1].alias("last_name"),
        ids.alias("external_ids"),
        F.col("c_custkey").cast("string").alias("individual_id"),
    )


@register(
    "reconcile_ids",
    "",
    """WITH d AS (SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus <> 'P'), min(o_orderkey)) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey AS person_id, CASE WHEN c_acctbal < 0 THEN '-5' ELSE CAST(v AS VARCHAR) END AS votes_id, '1' AS kept
    FROM customer LEFT JOIN d ON o_custkey = c_custkey""",
)
def reconcile_ids(v):
    """Vote ids found by exact name, other ids kept."""
    out, _ = people.reconcile(_customers(v), _directory(v))
    return out.select(
        "person_id", F.col("external_ids")["votes_mk_id"].alias("votes_id"), F.col("external_ids")["x"].alias("kept")
    )


@register(
    "reconcile_missing",
    "",
    """SELECT c_custkey AS person_id, split_part(c_name, '#', 2) AS last_name FROM customer
    WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def reconcile_missing(v):
    """People without a directory match."""
    _, missing = people.reconcile(_customers(v), _directory(v))
    return missing.select("person_id", "last_name")


@register(
    "enrich_people",
    "",
    """SELECT c_custkey AS person_id, first_order AS payload FROM customer LEFT JOIN (SELECT o_custkey,
      CAST(min(o_orderkey) AS VARCHAR) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def enrich_people(v):
    """Enrichment attached under one extra key, first row per member."""
    rows = v.table("orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("\t")).alias("individual_id"),
        F.col("o_orderkey").cast("string").alias("payload"),
        F.col("o_orderkey").alias("pos"),
    )
    out = people.enrich(_customers(v), rows)
    return out.select("person_id", F.col("external_ids")["open_knesset"].alias("payload"))


@register(
    "match_accounts",
    "",
    """SELECT person_id, username, pos FROM (SELECT p_brand AS person_id, p_name || p_partkey AS username, p_partkey AS pos,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part
      WHERE p_type <> 'SMALL' AND (contains(p_name, 'ring') OR p_retailprice > 990 OR p_size * 200 >= 5000)) WHERE rn = 1""",
)
def match_accounts(v):
    """First account per person that passes the identity gate."""
    p = v.table("part")
    shown = F.when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")))
    candidates = p.select(
        F.col("p_brand").alias("person_id"),
        F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")).alias("name"),
        F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.col("p_partkey")).alias("username"),
        shown.alias("display_name"),
        F.col("p_name").alias("bio"),
        (F.col("p_size") * 200).alias("followers"),
        (F.col("p_retailprice") > 990).alias("verified"),
        F.lit(False).alias("government"),
    )
    return people.match_accounts(candidates, ["RING"])


@register(
    "office_holders",
    "",
    """SELECT l_suppkey AS person_id, p_name AS position_desc, count(*) AS roles FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND (starts_with(p_name, 'red ') OR starts_with(p_name, 'small g')) GROUP BY ALL""",
)
def office_holders(v):
    """Current roles with a ministry whose description names an office."""
    p = v.table("part").select("p_partkey", "p_name")
    roles = v.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("person_id"),
        F.concat(F.lit("\t "), "p_name").alias("position_desc"),
        F.when(F.col("l_linestatus") == "F", "M").alias("ministry_name"),
        (F.col("l_returnflag") == "R").alias("is_current"),
    )
    held = people.current_holders(roles, ("red ", "small g"))
    return held.groupBy("person_id", F.btrim("position_desc", F.lit("\t ")).alias("position_desc")).agg(
        F.count("*").alias("roles")
    )


@register(
    "ministers",
    "",
    f"""WITH r AS (SELECT DISTINCT l_suppkey AS person_id, p_name, p_size % 2 AS kind, l_linestatus, l_returnflag
      FROM lineitem JOIN part ON l_partkey = p_partkey), held AS (
      SELECT person_id, '{OFFICE_PREFIXES[0]} ' || p_name AS "position", p_name AS ministry FROM r
      WHERE kind = 0 AND l_returnflag = 'R' AND l_linestatus = 'F')
    SELECT h.person_id, CASE WHEN h.person_id % 2 = 0 THEN s_name WHEN h.person_id % 3 = 0 THEN 'Person ' || h.person_id ELSE '' END AS name,
      "position", ministry, '2020-01-01' AS start_date, 'https://feed.example/' || h.person_id AS source,
      row_number() OVER (ORDER BY "position", h.person_id) AS place
    FROM held h JOIN supplier ON s_suppkey = h.person_id""",
)
def ministers(v):
    """Office holders with a name from the roster, else from the person table, else none, in order of office."""
    part = v.table("part").select("p_partkey", "p_name", (F.col("p_size") % 2).alias("kind"))
    rows = v.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_suppkey").alias("person_id"), "p_name", "kind", "l_linestatus", "l_returnflag").distinct()
    office = F.when(F.col("kind") == 0, F.concat(F.lit(f" {OFFICE_PREFIXES[0]} "), "p_name")).otherwise(F.col("p_name"))
    roles = rows.select(
        "person_id",
        office.alias("position_desc"),
        F.when(F.col("l_linestatus") == "F", F.col("p_name")).alias("ministry_name"),
        (F.col("l_returnflag") == "R").alias("is_current"),
        F.lit("2020-01-01").alias("start_date"),
        F.concat(F.lit("https://feed.example/"), F.col("person_id").cast("string")).alias("source_url"),
    )
    s = v.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    roster = s.filter("person_id % 2 = 0").withColumn("pos", F.col("person_id"))
    persons = s.filter("person_id % 3 = 0").select("person_id", F.concat(F.lit("Person "), F.col("person_id").cast("string")).alias("full_name"))
    return with_position(people.ministers(roles, roster, persons), "place")


@register(
    "append_figures",
    "",
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part), f AS (SELECT DISTINCT lower(p_type) AS name FROM part)
    SELECT name, true AS listed FROM names UNION ALL SELECT name, false FROM f
      WHERE NOT EXISTS (SELECT 1 FROM names n WHERE contains(n.name, f.name))""",
)
def append_figures(v):
    """Figures appended unless an existing name contains theirs."""
    p = v.table("part")
    roster = p.select(F.col("p_name").alias("name")).distinct().withColumn("listed", F.lit(True))
    figures = p.select(F.lower("p_type").alias("name")).distinct().withColumn("listed", F.lit(False))
    return append_unnamed(roster, figures)


@register(
    "source_vocabulary",
    "claims",
    """SELECT CASE WHEN source_type IN ('cbs', 'manual') THEN source_type ELSE 'rejected' END AS source_type, count(*) AS n
    FROM (SELECT CASE source_type WHEN 'court' THEN 'rumour' ELSE source_type END AS source_type FROM claims) GROUP BY 1""",
)
def source_vocabulary(v):
    """Rows with a known source type, and the count of rejected ones."""
    c = v.claims().select(
        F.when(F.col("source_type") == "court", "rumour").otherwise(F.col("source_type")).alias("source_type")
    )
    good, bad = schemas.split_vocabulary(c, "source_type")
    both = good.select("source_type").unionByName(bad.select(F.lit("rejected").alias("source_type")))
    return both.groupBy("source_type").agg(F.count("*").alias("n"))
