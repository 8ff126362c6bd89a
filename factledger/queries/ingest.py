"""Landed rows, mappers and idempotent merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.functions import casts
from factledger.queries import register
from factledger.session import new_folder
from factledger.sources import ingest, landed, mappers, sinks
from factledger.sources.bucketed import BucketedTable

T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _stamped(rows, when: str, entity: str):
    """Rows with a JSON ``payload`` as a source adapter would deliver them."""
    dated = rows.withColumn("fetched_at", F.lit(when).cast("timestamp"))
    return landed.stamp(dated, f"https://feed.example/{entity}", "knesset_odata")


def _person_payloads(v):
    c = v.table("customer")
    name = F.split("c_name", "#")
    payload = F.to_json(
        F.struct(
            F.col("c_custkey").alias("Id"),
            F.concat(F.lit("\t"), name[1], F.lit(" ")).alias("LastName"),
            F.when(F.col("c_acctbal") >= 1000, name[0]).alias("first_name"),
            F.col("c_mktsegment").alias("GenderDesc"),
            F.lit("  ").alias("Email"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") > 5000).alias("IsCurrent"),
        )
    )
    return c.select(payload.alias("payload"), "c_acctbal")


@register(
    "map_people",
    "",
    """SELECT c_custkey AS person_id, CASE WHEN c_acctbal >= 1000 THEN 'Customer' END AS first_name,
      split_part(c_name, '#', 2) AS last_name,
      CASE WHEN c_acctbal >= 1000 THEN 'Customer ' ELSE '' END || split_part(c_name, '#', 2) AS full_name,
      c_mktsegment AS gender, CAST(NULL AS VARCHAR) AS email, c_acctbal > 5000 AS is_current,
      'https://feed.example/Person(' || c_custkey || ')' AS source_url, CAST(c_custkey AS VARCHAR) AS source_record_id FROM customer""",
)
def map_people(v):
    """Person payloads (JSON) mapped to rows with provenance."""
    out = mappers.map_people(_stamped(_person_payloads(v), T0, "Person"))
    return out.select(
        "person_id",
        "first_name",
        "last_name",
        "full_name",
        "gender",
        "email",
        "is_current",
        "source_url",
        "source_record_id",
    )


PEOPLE_SQL = """SELECT c_custkey AS person_id, 'Customer ' || split_part(c_name, '#', 2) AS full_name,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS gender, 'y' AS kept_id,
  CASE WHEN c_acctbal < 0 THEN '2024-02-01' ELSE '2024-01-01' END AS fetched FROM customer"""


def people_fetches(v):
    """A first fetch of all people, and a second one of some with empty names and no id map."""
    c = v.table("customer")
    name = F.split("c_name", "#")
    first = c.select(
        F.to_json(
            F.struct(
                F.col("c_custkey").alias("Id"),
                name[0].alias("FirstName"),
                name[1].alias("LastName"),
                F.col("c_mktsegment").alias("GenderDesc"),
            )
        ).alias("payload")
    )
    stored = mappers.map_people(_stamped(first, T0, "Person")).withColumn(
        "external_ids", F.create_map(F.lit("x"), F.lit("y"))
    )
    again = c.filter(F.col("c_acctbal") < 0).select(
        F.to_json(F.struct(F.col("c_custkey").cast("string").alias("ID"))).alias("payload")
    )
    return stored, mappers.map_people(_stamped(again, T1, "Person"))


def shown_people(merged):
    return merged.select(
        "person_id",
        "full_name",
        "gender",
        F.col("external_ids")["x"].alias("kept_id"),
        F.to_date("fetched_at").cast("string").alias("fetched"),
    )


@register("upsert_people", "", PEOPLE_SQL)
def upsert_people(v):
    """A second fetch with empty names and no id map: the name and the map survive, provenance moves on."""
    return shown_people(ingest.ingest_people(*people_fetches(v)))


def _roles(v, *flags: str):
    rows = v.table("lineitem").filter(F.col("l_returnflag").isin(*flags))
    return rows.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.min("l_shipdate").alias("d")).select(
        F.to_json(
            F.struct(
                F.col("l_suppkey").alias("PersonID"),
                F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("PositionID"),
                F.concat(F.lit("role "), "l_returnflag").alias("DutyDesc"),
                F.concat(F.to_date("d").cast("string"), F.lit("T00:30:00+02:00")).alias("StartDate"),
                F.concat(F.lit("/Date("), F.unix_date(F.to_date("d")).cast("bigint") * 86400000, F.lit("+0200)/")).alias(
                    "FinishDate"
                ),
                F.lit("yes").alias("IsCurrent"),
            )
        ).alias("payload")
    )


@register(
    "roles_snapshot",
    "",
    """WITH a AS (SELECT l_suppkey AS person_id, l_partkey AS position_id, 'role ' || l_returnflag AS position_desc,
        strftime(min(l_shipdate), '%Y-%m-%d') AS start_date, l_returnflag AS f FROM lineitem GROUP BY ALL)
    SELECT person_id, position_id, position_desc, start_date, start_date AS finish_date, true AS is_current FROM a
    JOIN supplier ON s_suppkey = person_id WHERE (s_acctbal >= 5000) = (f = 'R')""",
)
def roles_snapshot(v):
    """Roles replaced for everyone whose positions were fetched; the others keep theirs."""
    stored = mappers.map_roles(_stamped(_roles(v, "A", "N"), T0, "Role"))
    new = mappers.map_roles(_stamped(_roles(v, "R"), T1, "Role"))
    s = v.table("supplier")
    fetched = s.filter(F.col("s_acctbal") >= 5000).select(F.col("s_suppkey").alias("person_id"))
    out = ingest.ingest_roles(stored, new, fetched)
    return out.select(
        "person_id",
        "position_id",
        "position_desc",
        F.col("start_date").cast("string").alias("start_date"),
        F.col("finish_date").cast("string").alias("finish_date"),
        "is_current",
    )


def _bill_rows(v, when: str, suffix: str, condition):
    p = v.table("part").filter(condition)
    payload = F.to_json(
        F.struct(
            F.col("p_partkey").alias("BillID"),
            F.concat("p_name", F.lit(suffix)).alias("Name"),
            F.col("p_type").alias("SubTypeDesc"),
            F.col("p_size").alias("StatusID"),
            F.col("p_size").alias("KnessetNum"),
        )
    )
    return mappers.map_bills(_stamped(p.select(payload.alias("payload")), when, "Bill"))


@register(
    "upsert_bills",
    "",
    """SELECT p_partkey AS bill_id, p_name || CASE WHEN p_size > 25 THEN ' v2' ELSE ' v1' END AS name, p_type AS bill_type_desc,
      CAST(p_size AS VARCHAR) AS status_desc, p_size AS term_num FROM part""",
)
def upsert_bills(v):
    """Bills: the refetched ones updated, the others kept."""
    stored = _bill_rows(v, T0, " v1", F.lit(True))
    new = _bill_rows(v, T1, " v2", F.col("p_size") > 25)
    out = ingest.ingest_bills(stored, new)
    return out.select("bill_id", "name", "bill_type_desc", "status_desc", "term_num")


def _initiations(v):
    rows = v.table("lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(
        F.max("l_linenumber").alias("ordinal"), F.max("l_shipdate").alias("d")
    )
    payload = F.to_json(
        F.struct(
            F.col("l_suppkey").alias("PersonID"),
            F.col("l_partkey").cast("string").alias("BillID"),
            (F.col("l_returnflag") == "R").alias("IsInitiator"),
            F.col("ordinal").alias("Ordinal"),
        )
    )
    # the fetch time orders the rows: returns are the latest, then N, then A
    day = F.when(F.col("l_returnflag") == "R", T1).when(F.col("l_returnflag") == "N", T0).otherwise("2023-12-01 00:00:00")
    stamped = _stamped(rows.select(payload.alias("payload"), day.cast("timestamp").alias("at")), T0, "Initiator")
    return mappers.map_sponsorships(stamped.withColumn("fetched_at", F.col("at")))


@register(
    "upsert_sponsorships",
    "",
    """WITH i AS (SELECT l_suppkey AS person_id, l_partkey AS bill_id, l_returnflag AS f, max(l_linenumber) AS ordinal
        FROM lineitem GROUP BY ALL)
    SELECT person_id, bill_id, arg_max(f, CASE f WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) = 'R' AS is_initiator,
      arg_max(ordinal, CASE f WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) AS ordinal FROM i JOIN part ON p_partkey = bill_id
    WHERE p_type <> 'PROMO' GROUP BY ALL""",
)
def upsert_sponsorships(v):
    """Latest sponsorship per (person, bill) of known bills."""
    new = _initiations(v)
    bills = v.table("part").filter(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("bill_id"))
    lead = F.coalesce("is_initiator", F.lit(False))
    stored, _ = ingest.ingest_sponsorships(new.limit(0), new.filter(~lead), bills)
    out, _ = ingest.ingest_sponsorships(stored, new.filter(lead), bills)
    return out.select("person_id", "bill_id", "is_initiator", "ordinal")


@register(
    "sponsorship_rejects",
    "",
    """SELECT count(*) AS rejected FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem
      JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO')""",
)
def sponsorship_rejects(v):
    """Initiations whose bill is unknown."""
    new = _initiations(v)
    bills = v.table("part").filter(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("bill_id"))
    _, rejects = ingest.ingest_sponsorships(new.limit(0), new, bills)
    return rejects.agg(F.count("*").alias("rejected"))


def _header_rows(v, when: str, tail: str):
    o = v.table("orders")
    accepted = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "no")
    payload = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("vote_id"),
            F.concat("o_orderpriority", F.lit(tail)).alias("sess_item_dscr"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("item "), "o_orderkey")).alias("vote_item_dscr"),
            F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T10:00:00Z")).alias("vote_date"),
            accepted.alias("is_accepted"),
            F.col("o_custkey").alias("session_id"),
        )
    )
    return mappers.map_vote_events(_stamped(o.select(payload.alias("payload")), when, "Vote"))


@register(
    "insert_vote_events",
    "",
    """SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'item ' || o_orderkey ELSE o_orderpriority ||
        CASE WHEN o_orderstatus = 'O' THEN ' old' ELSE ' new' END END AS title,
      strftime(o_orderdate, '%Y-%m-%d') AS vote_date, CAST(o_custkey AS INTEGER) AS session_num,
      CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'unknown' END AS result FROM orders""",
)
def insert_vote_events(v):
    """Vote headers inserted once; stored ones are not touched."""
    stored = _header_rows(v, T0, " old").filter(F.col("result") == "failed")
    out = ingest.ingest_vote_events(stored, _header_rows(v, T1, " new"))
    return out.select("event_id", "title", F.col("vote_date").cast("string").alias("vote_date"), "session_num", "result")


VOTES_SQL = """SELECT l_suppkey AS person_id, l_orderkey AS event_id, CASE max(l_linenumber) % 5 WHEN 0 THEN 'na' WHEN 1 THEN 'for'
  WHEN 2 THEN 'against' WHEN 3 THEN 'abstain' ELSE 'absent' END AS stance FROM lineitem GROUP BY 1, 2"""


def vote_fetches(v):
    """Roll-call payloads joined on the padded member key, in two fetches."""
    ids = v.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_suppkey").alias("votes_id"))
    payload = F.to_json(
        F.struct(
            F.col("l_orderkey").cast("string").alias("vote_id"),
            F.concat((F.col("l_linenumber") % 5).cast("string"), F.lit(".0")).alias("vote_result"),
            F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("kmmbr_id"),
        )
    )
    rows = v.table("lineitem", "l_orderkey").select(
        payload.alias("payload"),
        F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("kmmbr_id"),
        F.timestamp_seconds(F.col("l_linenumber")).alias("at"),
    )
    stamped = _stamped(landed.roll_call(ids, rows), T0, "Rollcall").withColumn("fetched_at", F.col("at"))
    new = mappers.map_votes(stamped)
    early = F.col("fetched_at") <= F.timestamp_seconds(F.lit(3))
    return new.filter(early), new.filter(~early)


@register("upsert_votes", "", VOTES_SQL)
def upsert_votes(v):
    """Roll-call payloads of two fetches; the last stance per (person, event) is kept."""
    early, late = vote_fetches(v)
    stored = ingest.ingest_votes(early.limit(0), early)
    return ingest.ingest_votes(stored, late).select("person_id", "event_id", "stance")


@register(
    "missing_headers",
    "votes vote_events",
    """SELECT event_id, count(*) AS rows, 'vote header ' || event_id || ' not found' AS warning FROM votes
    WHERE event_id NOT IN (SELECT event_id FROM vote_events WHERE result <> 'unknown') GROUP BY event_id""",
)
def missing_headers(v):
    """A warning per vote whose header is not in the approved set."""
    headers = v.vote_events().filter(F.col("result") != "unknown")
    return landed.with_headers(v.votes(), headers)[1]


STATISTICS_SQL = """WITH k AS (SELECT metric, dimension_type, dimension_value, period, arg_max(value, pos) * 2 AS value,
    arg_max(notes, pos) AS notes, arg_min(source_org, pos) AS source_org FROM data_points GROUP BY ALL)
  SELECT * FROM k"""


@register("upsert_statistics", "data_points", STATISTICS_SQL)
def upsert_statistics(v):
    """A catalog loaded twice: values updated in place, null periods equal, other columns as first stored."""
    cols = ["metric", "dimension_type", "dimension_value", "period", "value", "unit", "notes", "source_url", "source_org"]
    points = v.data_points().select(*cols, "pos")
    first = ingest.ingest_statistics(points.select(*cols).limit(0), points)
    second = points.withColumns({"value": F.col("value") * 2, "source_org": F.lit("later")})
    out = ingest.ingest_statistics(first, second)
    return out.select("metric", "dimension_type", "dimension_value", "period", "value", "notes", "source_org")


@register(
    "drifting_casts",
    "",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS whole,
      CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag,
      CASE event_type WHEN 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day,
      CASE event_type WHEN 'click' THEN 'for' WHEN 'view' THEN 'against' WHEN 'error' THEN 'absent' ELSE 'na' END AS stance
    FROM events""",
)
def drifting_casts(v):
    """Best-effort casts of drifting upstream values."""
    e = v.table("events")
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit(" "), k, F.lit(".0 ")))
        .when(kind == "view", k)
        .when(kind == "error", "true")
        .otherwise("n/a")
    )
    flag = F.when(kind == "click", " Yes").when(kind == "view", "0").otherwise("maybe")
    day = F.to_date("ts").cast("string")
    dated = (
        F.when(kind == "click", F.concat(day, F.lit("T23:59:59-05:00")))
        .when(kind == "view", F.concat(F.lit("/Date("), F.unix_date(F.to_date("ts")).cast("bigint") * 86400000 + 1, F.lit(")/")))
        .when(kind == "error", "soon")
        .when(kind == "signup", F.replace(day, F.lit("-"), F.lit("")))
        .otherwise(F.concat(day, F.lit(" or so")))
    )
    vote = F.when(kind == "click", "1").when(kind == "view", " נגד ").when(kind == "error", "Did Not Vote").otherwise("?")
    return e.select(
        "event_id",
        casts.to_int(raw).alias("whole"),
        casts.to_bool(flag).alias("flag"),
        casts.to_date(dated).cast("string").alias("day"),
        casts.stance_of(vote).alias("stance"),
    )


@register(
    "persons_by_name",
    "",
    "SELECT c_custkey AS person_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
)
def persons_by_name(v):
    """Everyone with a given name; homonyms are all returned."""
    c = v.table("customer").select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_mktsegment").alias("last_name"),
        F.col("c_nationkey").cast("string").alias("first_name"),
    )
    return landed.find_persons(c, "BUILDING", "3").select("person_id")


@register(
    "entity_count", "", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
)
def entity_count(v):
    """Rows of an entity set under a filter."""
    return landed.count_rows(v.table("orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@register(
    "landed_pages",
    "",
    """SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS source_record_id, role,
      'https://feed.example/Turn(' || (conv_id * 1000 + turn) || ')' AS source_url, md5(text) AS text_md5 FROM conversations""",
)
def landed_pages(v):
    """Feed pages written to the shared folder and read back; rows repeated in a page are kept once."""
    c = v.table("conversations")
    row = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("Id"), "role", "text")
    path = new_folder(v.spark, "pages")
    c.select(F.array(row, row).alias("value")).write.json(path)
    rows = landed.read_pages(v.spark, path, "https://feed.example/Turn", "knesset_odata", page_per_line=True)
    return rows.select(
        "source_record_id", F.col("fields")["role"].alias("role"), "source_url", F.md5(F.col("fields")["text"]).alias("text_md5")
    )


@register(
    "sink_roundtrip",
    "segments",
    "SELECT person_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM segments GROUP BY person_id",
)
def sink_roundtrip(v):
    """Segments written per person and as a compressed index, then read back."""
    s = v.segments().select("person_id", "video_id", "pos", "text")
    by_person, index = new_folder(v.spark, "by-person"), new_folder(v.spark, "index")
    sinks.write_by_person(s, by_person)
    sinks.write_index(s, index)
    schema = "person_id bigint, video_id bigint, pos int, text string"
    counted = v.spark.read.schema(schema + ", pid bigint").json(by_person).groupBy("pid").agg(F.count("*").alias("n"))
    sized = v.spark.read.schema(schema).json(index).groupBy("person_id").agg(F.sum(F.length("text")).alias("chars"))
    return counted.withColumnRenamed("pid", "person_id").join(sized, "person_id")


@register(
    "findings_sink",
    "findings",
    """SELECT 'public' AS output, count(*) AS rows FROM findings WHERE status = 'confirmed'
    UNION ALL SELECT 'store', count(*) FROM findings""",
)
def findings_sink(v):
    """Findings written as internal store and public subset; rows of each."""
    store, public = new_folder(v.spark, "store"), new_folder(v.spark, "public")
    sinks.write_findings(v.findings(), store, public)
    schema = "id string, pos bigint"
    return ingest.report(
        store=v.spark.read.parquet(store).select("pos"), public=v.spark.read.schema(schema).json(public)
    )


# --- the same merges into stored tables -------------------------------------------------------
@register("stored_people", "", PEOPLE_SQL)
def stored_people(v):
    """Both fetches merged into a bucketed table; the second rewrites only the buckets it touches."""
    first, second = people_fetches(v)
    table = BucketedTable(v.spark, new_folder(v.spark, "people"), first.schema, ["person_id"])
    for fetch in (first, second):
        table.merge(fetch, ingest.ingest_people)
    return shown_people(table.read())


@register("stored_votes", "", VOTES_SQL)
def stored_votes(v):
    """Both fetches of votes merged into a table bucketed by person and event."""
    early, late = vote_fetches(v)
    table = BucketedTable(v.spark, new_folder(v.spark, "votes"), early.schema, ["person_id", "event_id"])
    for fetch in (early, late):
        table.merge(fetch, ingest.ingest_votes)
    return table.read().select("person_id", "event_id", "stance")


@register("stored_statistics", "data_points", STATISTICS_SQL)
def stored_statistics(v):
    """A catalog loaded twice into a bucketed table; null periods share a bucket."""
    cols = ["metric", "dimension_type", "dimension_value", "period", "value", "unit", "notes", "source_url", "source_org"]
    points = v.data_points().select(*cols, "pos")
    table = BucketedTable(v.spark, new_folder(v.spark, "statistics"), points.select(*cols).schema, ingest.STATISTIC_KEY)
    table.merge(points, ingest.ingest_statistics)
    table.merge(points.withColumns({"value": F.col("value") * 2, "source_org": F.lit("later")}), ingest.ingest_statistics)
    return table.read().select("metric", "dimension_type", "dimension_value", "period", "value", "notes", "source_org")
