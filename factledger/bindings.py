"""Domain views over the driver's tables, once for Spark and once as SQL.

Every view reads its whole tables. ``VIEWS`` holds the same definitions as SQL
text for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators.layout import spread
from factledger.plans.review import finding_id


_READERS: dict[tuple, DataFrame] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str, *spread_by: str) -> DataFrame:
        """A driver table; the reader (schema and file list) is kept per session, the data is not.

        ``spread_by`` columns spread a table of few splits over the cores, for
        views that lead into costly per-row work.
        """
        key = (self.spark, self.dir, name, spread_by)
        if key not in _READERS:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            _READERS[key] = spread(df, *spread_by) if spread_by else df
        return _READERS[key]

    # --- people ------------------------------------------------------------
    def _nations(self) -> DataFrame:
        return self.table("nation").select("n_nationkey", F.col("n_name").alias("party"))

    def actors(self) -> DataFrame:
        s = self.table("supplier").join(self._nations(), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), "party")

    def people(self) -> DataFrame:
        c = self.table("customer").join(self._nations(), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(
            F.col("c_custkey").alias("person_id"),
            F.col("c_custkey").alias("official_id"),
            F.col("c_name").alias("full_name"),
            "party",
        )

    # --- statistics and claims -------------------------------------------------
    def _orders_by_nation(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        o = self.table("orders", "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
        return o.join(self._nations(), F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
            "year", F.year("o_orderdate")
        )

    def statistics(self) -> DataFrame:
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        grouped = (
            self._orders_by_nation()
            .groupBy("year", "c_nationkey", "party")
            .agg((total / F.count("*")).alias("value"))
        )
        year = F.col("year").cast("string")
        return grouped.select(
            (F.col("year") * 1000 + F.col("c_nationkey")).cast("bigint").alias("stat_id"),
            F.concat(F.lit("avg_order_value_"), year).alias("metric"),
            F.lit("nation").alias("dimension_type"),
            F.col("party").alias("dimension_value"),
            "value",
            year.alias("period"),
            F.concat(F.lit("https://stats.example/"), year, F.lit("/"), F.col("c_nationkey")).alias("source_url"),
        )

    def claims(self) -> DataFrame:
        """One claim per order. Priorities give the assertion: lowest, highest, value,
        an unknown dimension, and a metric without statistics."""
        p = F.left("o_orderpriority", F.lit(1))
        year = F.col("year").cast("string")
        is_value = p.isin("3", "5")
        return self._orders_by_nation().select(
            F.col("o_orderkey").alias("statement_id"),
            F.col("o_custkey").alias("politician_id"),
            F.concat(F.when(p == "5", "order_count_").otherwise("avg_order_value_"), year).alias("metric"),
            F.lit("nation").alias("dimension_type"),
            F.when(p == "4", F.col("c_mktsegment")).otherwise(F.col("party")).alias("dimension_value"),
            F.when(p.isin("1", "4"), "superlative_min")
            .when(p == "2", "superlative_max")
            .otherwise("value")
            .alias("assertion"),
            F.when(is_value, F.col("o_totalprice")).alias("claimed_value"),
            F.when(F.col("o_orderstatus") == "F", "cbs")
            .when(F.col("o_orderstatus") == "O", "manual")
            .otherwise("court")
            .alias("source_type"),
            F.concat(F.lit("https://claims.example/"), F.col("o_orderkey")).alias("source_url"),
        )

    def statements(self) -> DataFrame:
        """Statements of the events' users; person ids share the actors' range."""
        e = self.table("events", "event_id")
        return e.select(
            F.col("event_id").alias("statement_id"),
            F.col("user_id").alias("person_id"),
            F.to_date("ts").alias("statement_date"),
            F.col("event_type").alias("topic"),
            F.concat("event_type", F.lit(" "), F.col("props")).alias("claim"),
            F.concat(F.lit("https://says.example/"), F.col("event_id")).alias("source_url"),
        )

    # --- votes and bills --------------------------------------------------------
    def vote_events(self) -> DataFrame:
        from factledger.functions.casts import vote_result_of

        accepted = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("?")
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_orderpriority").alias("title"),
            F.to_date("o_orderdate").alias("vote_date"),
            F.year("o_orderdate").alias("term_num"),
            vote_result_of(accepted).alias("result"),
            F.concat(F.lit("https://votes.example/"), F.col("o_orderkey")).alias("source_url"),
        )

    def votes_raw(self) -> DataFrame:
        from factledger.functions.casts import stance_of

        return self.table("lineitem", "l_orderkey").select(
            F.col("l_suppkey").alias("person_id"),
            F.col("l_orderkey").alias("event_id"),
            stance_of((F.col("l_linenumber") % 5).cast("string")).alias("stance"),
            F.col("l_linenumber").alias("line"),
        )

    def votes(self) -> DataFrame:
        """Last stance per (person, event)."""
        from factledger.operators.ranking import last_by

        v = last_by(self.votes_raw(), ["person_id", "event_id"], ["line"], ["stance"])
        return v.withColumns(
            {
                "vote_id": F.col("event_id"),
                "source_url": F.concat(F.lit("https://rollcall.example/"), F.col("event_id")),
            }
        )

    def sponsorships(self) -> DataFrame:
        from factledger.operators.ranking import last_by

        rows = self.table("lineitem", "l_orderkey").select(
            F.col("l_suppkey").alias("person_id"),
            F.col("l_partkey").alias("bill_id"),
            (F.col("l_returnflag") == "R").alias("is_initiator"),
            F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("ordinal"),
            "l_orderkey",
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
        )
        order = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
        return last_by(rows, ["person_id", "bill_id"], order, ["is_initiator", "ordinal"])

    def bills(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("bill_id"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("term_num"),
            F.concat(F.lit("https://bills.example/"), F.col("p_partkey")).alias("source_url"),
        )

    def actions(self) -> DataFrame:
        """Parts supplied count as actions of the supplier."""
        rows = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("d"))
        return rows.select(
            (F.col("l_partkey")).alias("action_id"),
            F.col("l_suppkey").alias("person_id"),
            F.to_date("d").alias("action_date"),
            F.lit("policy").alias("action_type"),
            F.lit(None).cast("string").alias("title"),
            F.concat(F.lit("https://acts.example/"), F.col("l_partkey")).alias("source_url"),
        )

    # --- corpus ---------------------------------------------------------------------
    def _person_of(self):
        return F.substring("source", 4, 10).cast("bigint")

    def segments(self) -> DataFrame:
        d = self.table("documents", "doc_id").select(
            self._person_of().alias("person_id"),
            F.col("source").alias("speaker_name"),
            F.col("doc_id").alias("video_id"),
            F.concat(F.lit("https://video.example/?v="), F.col("doc_id")).alias("url"),
            F.col("lang").alias("title"),
            F.when(F.col("lang") != "en", F.col("lang")).alias("published_at"),
            F.posexplode(F.split("text", "\n")).alias("pos", "text"),
        )
        return d.withColumns({"name": F.col("speaker_name"), "start": F.col("pos").cast("double") * 7.25})

    def interviews(self) -> DataFrame:
        return self.table("documents", "doc_id").select(
            self._person_of().alias("person_id"),
            F.col("source").alias("name"),
            F.col("doc_id").alias("video_id"),
            F.concat(F.lit("https://video.example/?v="), F.col("doc_id")).alias("url"),
            F.col("lang").alias("title"),
            F.when(F.col("lang") != "en", F.col("lang")).alias("published_at"),
            F.col("n_chars").alias("duration_sec"),
            F.transform(
                F.split("text", "\n"),
                lambda t, i: F.struct((i.cast("double") * 7.25).alias("start"), t.alias("text")),
            ).alias("segments"),
        )

    def speakers(self) -> DataFrame:
        """Roster of the corpus: the actors with a small id, so some speakers are unlisted."""
        return self.actors()

    def posts(self) -> DataFrame:
        c = self.table("conversations")
        text = F.when(F.col("role") == "system", F.concat(F.lit("RT @"), F.col("text"))).otherwise(F.col("text"))
        return c.select(
            F.col("conv_id").alias("person_id"),
            F.concat(F.lit("conv"), F.col("conv_id")).alias("handle"),
            F.col("turn").alias("pos"),
            F.concat(F.lit("https://posts.example/"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("url"),
            text.alias("text"),
        )

    def number_claims(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("person_id"),
            F.col("event_type").alias("metric"),
            "value",
            F.to_date("ts").cast("string").alias("video_id"),
            F.col("event_id").alias("start"),
        )

    # --- series ------------------------------------------------------------------------
    def series(self) -> DataFrame:
        """Yearly quantity per kind of part (the last word of its name)."""
        p = self.table("part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("key"))
        sold = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        yearly = sold.groupBy("key", F.year("l_shipdate").alias("year")).agg(
            F.sum("l_quantity").alias("value"), F.min("l_partkey").alias("pos")
        )
        point = F.struct("year", "value", (F.col("year") == 2001).alias("provisional"))
        arrays = yearly.groupBy("key").agg(F.sort_array(F.collect_list(point)).alias("points"), F.min("pos").alias("pos"))
        return arrays.select(
            "pos",
            "key",
            F.concat(F.lit("Sales of "), F.col("key")).alias("label"),
            F.lit("units").alias("unit"),
            F.array("key").alias("match"),
            F.concat(F.lit("whole tables, "), F.col("key")).alias("note"),
            F.array(
                F.struct(F.lit("Sales office").alias("org"), F.concat(F.lit("https://s.example/"), "key").alias("url"))
            ).alias("sources"),
            "points",
        )

    def appointments(self) -> DataFrame:
        p = self.table("part").select("p_partkey", "p_name", "p_brand")
        rows = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        held = rows.groupBy("l_suppkey", "p_name").agg(
            F.min("l_partkey").alias("pos"),
            F.min("l_shipdate").alias("d"),
            F.min("p_brand").alias("ministry"),
        )
        return held.select(
            "pos",
            F.col("l_suppkey").alias("person_id"),
            F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("name"),
            F.col("p_name").alias("position"),
            "ministry",
            F.to_date("d").cast("string").alias("start_date"),
        )

    def data_points(self) -> DataFrame:
        """Catalog points in a fixed order: line revenue per brand, yearly, with national rows."""
        p = self.table("part").select("p_partkey", "p_brand", "p_type")
        sold = self.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
        grouped = sold.groupBy("p_brand", "p_type", F.year("l_shipdate").alias("y")).agg(
            F.sum("l_quantity").alias("value"), F.min("l_partkey").alias("part")
        )
        national = F.col("p_type") == "PROMO"
        return grouped.select(
            (F.col("y").cast("bigint") * 10000000000 + F.col("part")).alias("pos"),
            F.concat(F.lit("price_"), F.lower("p_brand")).alias("metric"),
            F.lit("national").alias("dimension_type"),
            F.when(national, "national").otherwise(F.concat("p_type", F.lit(" "), F.col("y"))).alias("dimension_value"),
            "value",
            F.when(F.col("p_type").isin("LARGE", "SMALL"), "count").otherwise("units").alias("unit"),
            F.when(national | (F.col("p_type") == "LARGE"), F.concat(F.lit("FY "), F.col("y"))).alias("period"),
            F.concat(F.lit("Bureau "), "p_type", F.lit(" (yearly) — tables")).alias("source_org"),
            F.when(F.col("p_type") != "SMALL", F.concat(F.lit("https://b.example/"), "p_type")).alias("source_url"),
            F.concat(F.lit("note "), "p_type", F.lit(" "), F.col("y")).alias("notes"),
            F.concat(F.lit("quote "), "p_type").alias("confirm_quote"),
        )

    # --- findings -------------------------------------------------------------------------
    def findings(self) -> DataFrame:
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        return d.select(
            F.col("doc_id").alias("pos"),
            F.when(F.col("quality") == 1, finding_id(F.col("doc_id"))).alias("id"),
            self._person_of().alias("person_id"),
            F.col("source").alias("speaker_name"),
            F.when(F.col("lang") != "es", F.col("lang")).alias("video_id"),
            F.col("text").alias("quote"),
            F.when(F.col("toxic") == 1, "consistent").otherwise("contradicted").alias("outcome"),
            F.when(F.col("quality") == 1, "confirmed")
            .when(F.col("quality") == 0, "candidate")
            .otherwise("published")
            .alias("status"),
            "quality",
            "toxic",
        )


# The same views as SQL, in dependency order.
VIEWS: dict[str, str] = {
    "actors": """SELECT s_suppkey AS person_id, s_name AS name, n_name AS party
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "people": """SELECT c_custkey AS person_id, c_custkey AS official_id, c_name AS full_name, n_name AS party
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "nation_orders": """SELECT o.*, c_nationkey, c_mktsegment, n_name AS party, CAST(year(o_orderdate) AS INTEGER) AS year
        FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "statistics": """SELECT CAST(year * 1000 + c_nationkey AS BIGINT) AS stat_id,
        'avg_order_value_' || year AS metric, 'nation' AS dimension_type, party AS dimension_value,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value,
        CAST(year AS VARCHAR) AS period,
        'https://stats.example/' || year || '/' || c_nationkey AS source_url
        FROM nation_orders GROUP BY year, c_nationkey, party""",
    "claims": """SELECT o_orderkey AS statement_id, o_custkey AS politician_id,
        (CASE WHEN left(o_orderpriority,1)='5' THEN 'order_count_' ELSE 'avg_order_value_' END) || year AS metric,
        'nation' AS dimension_type,
        CASE WHEN left(o_orderpriority,1)='4' THEN c_mktsegment ELSE party END AS dimension_value,
        CASE WHEN left(o_orderpriority,1) IN ('1','4') THEN 'superlative_min'
             WHEN left(o_orderpriority,1)='2' THEN 'superlative_max' ELSE 'value' END AS assertion,
        CASE WHEN left(o_orderpriority,1) IN ('3','5') THEN o_totalprice END AS claimed_value,
        CASE o_orderstatus WHEN 'F' THEN 'cbs' WHEN 'O' THEN 'manual' ELSE 'court' END AS source_type,
        'https://claims.example/' || o_orderkey AS source_url FROM nation_orders""",
    "statements": """SELECT event_id AS statement_id, user_id AS person_id, CAST(ts AS DATE) AS statement_date,
        event_type AS topic, event_type || ' ' || props AS claim,
        'https://says.example/' || event_id AS source_url FROM events""",
    "vote_events": """SELECT o_orderkey AS event_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS vote_date,
        CAST(year(o_orderdate) AS INTEGER) AS term_num,
        CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'unknown' END AS result,
        'https://votes.example/' || o_orderkey AS source_url FROM orders""",
    "votes_raw": """SELECT l_suppkey AS person_id, l_orderkey AS event_id, l_linenumber AS line,
        CASE l_linenumber % 5 WHEN 0 THEN 'na' WHEN 1 THEN 'for' WHEN 2 THEN 'against' WHEN 3 THEN 'abstain'
        ELSE 'absent' END AS stance FROM lineitem""",
    "votes": """SELECT person_id, event_id, arg_max(stance, line) AS stance, event_id AS vote_id,
        'https://rollcall.example/' || event_id AS source_url FROM votes_raw GROUP BY person_id, event_id""",
    "sponsorships": """SELECT person_id, bill_id, is_initiator, ordinal FROM (
        SELECT l_suppkey AS person_id, l_partkey AS bill_id, l_returnflag = 'R' AS is_initiator,
        CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS ordinal,
        row_number() OVER (PARTITION BY l_suppkey, l_partkey
          ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem)
        WHERE rn = 1""",
    "bills": """SELECT p_partkey AS bill_id, p_name AS name, p_size AS term_num,
        'https://bills.example/' || p_partkey AS source_url FROM part""",
    "actions": """SELECT l_partkey AS action_id, l_suppkey AS person_id, CAST(max(l_shipdate) AS DATE) AS action_date,
        'policy' AS action_type, CAST(NULL AS VARCHAR) AS title,
        'https://acts.example/' || l_partkey AS source_url FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "lines": """SELECT *, unnest(string_split(text, chr(10))) AS line_text,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents""",
    "segments": """SELECT CAST(substr(source, 4) AS BIGINT) AS person_id, source AS speaker_name, doc_id AS video_id,
        'https://video.example/?v=' || doc_id AS url, lang AS title,
        CASE WHEN lang <> 'en' THEN lang END AS published_at, CAST(line_no AS INTEGER) AS pos,
        line_text AS text, source AS name, line_no * 7.25::DOUBLE AS start FROM lines""",
    "interviews": """SELECT CAST(substr(source, 4) AS BIGINT) AS person_id, source AS name, doc_id AS video_id,
        'https://video.example/?v=' || doc_id AS url, lang AS title,
        CASE WHEN lang <> 'en' THEN lang END AS published_at, n_chars AS duration_sec,
        len(string_split(text, chr(10))) AS n_segments, text FROM documents""",
    "posts": """SELECT conv_id AS person_id, 'conv' || conv_id AS handle, turn AS pos,
        'https://posts.example/' || conv_id || '/' || turn AS url,
        CASE WHEN role = 'system' THEN 'RT @' || text ELSE text END AS text FROM conversations""",
    "number_claims": """SELECT user_id AS person_id, event_type AS metric, value,
        strftime(ts, '%Y-%m-%d') AS video_id, event_id AS start FROM events""",
    "yearly": """SELECT string_split(p_name, ' ')[-1] AS key, CAST(year(l_shipdate) AS INTEGER) AS year,
        sum(l_quantity) AS value, min(l_partkey) AS pos
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "series": """SELECT key, min(pos) AS pos, 'Sales of ' || key AS label, 'units' AS unit,
        'whole tables, ' || key AS note, list(struct_pack(year := year, value := value) ORDER BY year) AS points
        FROM yearly GROUP BY key""",
    "appointments": """SELECT l_suppkey AS person_id, p_name AS position, min(l_partkey) AS pos,
        min(p_brand) AS ministry, strftime(min(l_shipdate), '%Y-%m-%d') AS start_date,
        'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS name
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_name""",
    "data_points": """SELECT CAST(y AS BIGINT) * 10000000000 + part AS pos, 'price_' || lower(p_brand) AS metric,
        'national' AS dimension_type,
        CASE WHEN p_type = 'PROMO' THEN 'national' ELSE p_type || ' ' || y END AS dimension_value, value,
        CASE WHEN p_type IN ('LARGE','SMALL') THEN 'count' ELSE 'units' END AS unit,
        CASE WHEN p_type IN ('PROMO','LARGE') THEN 'FY ' || y END AS period,
        'Bureau ' || p_type || ' (yearly) — tables' AS source_org,
        CASE WHEN p_type <> 'SMALL' THEN 'https://b.example/' || p_type END AS source_url,
        'note ' || p_type || ' ' || y AS notes, 'quote ' || p_type AS confirm_quote
        FROM (SELECT p_brand, p_type, CAST(year(l_shipdate) AS INTEGER) AS y, sum(l_quantity) AS value,
              min(l_partkey) AS part FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)""",
    "findings": """SELECT d.doc_id AS pos,
        CASE WHEN quality = 1 THEN 'F-' || (CASE WHEN d.doc_id < 10000 THEN lpad(CAST(d.doc_id AS VARCHAR), 4, '0')
             ELSE CAST(d.doc_id AS VARCHAR) END) END AS id,
        CAST(substr(source, 4) AS BIGINT) AS person_id, source AS speaker_name,
        CASE WHEN lang <> 'es' THEN lang END AS video_id, text AS quote,
        CASE WHEN toxic = 1 THEN 'consistent' ELSE 'contradicted' END AS outcome,
        CASE WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'candidate' ELSE 'published' END AS status,
        quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

NEEDS = {
    "statistics": ["nation_orders"],
    "claims": ["nation_orders"],
    "votes": ["votes_raw"],
    "segments": ["lines"],
    "series": ["yearly"],
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the CTEs of the named views and of what they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
