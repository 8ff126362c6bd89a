"""Entity graph over the driver's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.plans import graph
from factledger.queries import register




def _related(v):
    """Customers related to the suppliers of their orders."""
    o = v.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = v.table("supplier").select("s_suppkey", "s_name")
    rows = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return rows.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("o_custkey").alias("person_key"),
        F.col("s_name").alias("name"),
        F.col("o_orderpriority").alias("relation"),
        F.col("o_orderkey").alias("at"),
    )


def _owned(v):
    s = v.table("supplier")
    links = s.select(
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("registration_id"),
        (F.col("s_acctbal") < 0).alias("controls"),
    )
    return graph.ownership_edges(links)


def _awarded(v):
    c = v.table("customer")
    return c.select(
        F.col("c_nationkey").cast("string").alias("registration_id"), F.col("c_mktsegment").alias("tender_id")
    )


RELATED = """related AS (SELECT DISTINCT o_custkey AS person_key, s_name AS relative, o_orderpriority AS relation FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
  owned AS (SELECT DISTINCT s_name AS relative, CASE WHEN s_acctbal < 0 THEN 'CONTROLS' ELSE 'OWNS' END AS rel_type,
    CAST(s_nationkey AS VARCHAR) AS registration_id FROM supplier),
  awarded AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS registration_id, c_mktsegment AS tender_id FROM customer)"""


@register(
    "graph_related",
    "",
    """SELECT o_custkey AS person_key, s_name AS name, o_orderpriority AS relation,
      coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 1), max(o_orderkey)) AS at FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def graph_related(v):
    """RELATED_TO edges merged by (person, name, relation), latest provenance kept."""
    new = _related(v)
    keys, odd = ["person_key", "name", "relation"], F.col("at") % 2 == 1
    stored = graph.upsert_edges(new.limit(0), new.filter(~odd), keys, ["at"])
    return graph.upsert_edges(stored, new.filter(odd), keys, ["at"])


@register("graph_owned", "", f"WITH {RELATED} SELECT relative AS name, rel_type, registration_id FROM owned")
def graph_owned(v):
    """OWNS and CONTROLS edges."""
    return _owned(v).select("name", "rel_type", "registration_id")


@register(
    "graph_people",
    "",
    """SELECT s_name AS name, 'supplier' AS role, 'second' AS source_type FROM supplier""",
)
def graph_people(v):
    """Person nodes merged twice: a missing role keeps the old one, provenance is refreshed."""
    s = v.table("supplier").select(F.col("s_name").alias("name"))
    stored = s.withColumns({"role": F.lit("supplier"), "source_type": F.lit("first"), "at": F.lit(0)})
    new = s.withColumns({"role": F.lit(None).cast("string"), "source_type": F.lit("second"), "at": F.lit(1)})
    out = graph.upsert_nodes(stored, new, "name", ["at"], keep_present=["role"])
    return out.select("name", "role", "source_type")


@register(
    "graph_politicians",
    "people",
    "SELECT person_id AS person_key, full_name || ' 2' AS full_name, CAST(NULL AS VARCHAR) AS party FROM people",
)
def graph_politicians(v):
    """Politician nodes: every attribute refreshed, rows without a key refused."""
    p = v.people().select(F.col("person_id").alias("person_key"), "full_name", "party")
    stored = p.withColumn("at", F.lit(0))
    keyless = p.withColumn("person_key", F.lit(None).cast("bigint"))
    new = p.withColumns({"full_name": F.concat("full_name", F.lit(" 2")), "party": F.lit(None).cast("string")})
    new = new.unionByName(keyless).withColumn("at", F.lit(1))
    return graph.upsert_nodes(stored, new, "person_key", ["at"]).drop("at")


@register(
    "graph_companies",
    "",
    """SELECT CAST(n_nationkey AS VARCHAR) AS registration_id, CASE WHEN n_regionkey = 0 THEN n_name END AS name,
      n_nationkey IN (SELECT s_nationkey FROM supplier) AS owned FROM nation
    WHERE n_regionkey = 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier)""",
)
def graph_companies(v):
    """Company nodes: the known ones and those that only occur in edges."""
    n = v.table("nation").filter(F.col("n_regionkey") == 0)
    known = n.select(F.col("n_nationkey").cast("string").alias("registration_id"), F.col("n_name").alias("name"))
    implied = graph.endpoints(_owned(v), "registration_id", "registration_id")
    nodes = graph.add_missing(known, implied, "registration_id")
    flagged = implied.withColumn("owned", F.lit(True))
    return nodes.join(flagged, "registration_id", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


@register(
    "graph_duplicate_keys",
    "",
    "SELECT c_nationkey AS nation_key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
)
def graph_duplicate_keys(v):
    """Keys that break the uniqueness rule."""
    return graph.duplicate_keys(v.table("customer").select(F.col("c_nationkey").alias("nation_key")), "nation_key")


@register(
    "graph_award_edges",
    "",
    "SELECT CAST(c_nationkey AS VARCHAR) AS registration_id, c_mktsegment AS tender_id, "
    "coalesce(max(c_custkey) FILTER (c_custkey % 2 = 1), max(c_custkey)) AS at FROM customer GROUP BY ALL",
)
def graph_award_edges(v):
    """AWARDED edges merged by (company, tender)."""
    new = v.table("customer").select(
        F.col("c_nationkey").cast("string").alias("registration_id"),
        F.col("c_mktsegment").alias("tender_id"),
        F.col("c_custkey").alias("at"),
    )
    keys, odd = ["registration_id", "tender_id"], F.col("at") % 2 == 1
    stored = graph.upsert_edges(new.limit(0), new.filter(~odd), keys, ["at"])
    return graph.upsert_edges(stored, new.filter(odd), keys, ["at"])


@register(
    "graph_paths",
    "",
    f"WITH {RELATED} SELECT person_key, relation, relative, rel_type, registration_id, tender_id FROM related "
    "JOIN owned USING (relative) JOIN awarded USING (registration_id)",
)
def graph_paths(v):
    """Politician - relative - company - tender paths."""
    return graph.award_paths(_related(v), _owned(v), _awarded(v))


@register(
    "graph_path_counts",
    "",
    f"""WITH {RELATED} SELECT person_key, count(*) AS paths, count(DISTINCT (relation, relative, rel_type, registration_id)) AS holdings
    FROM related JOIN owned USING (relative) JOIN awarded USING (registration_id) GROUP BY person_key""",
)
def graph_path_counts(v):
    """Paths and holdings per politician, counted without listing the paths."""
    return graph.path_counts(_related(v), _owned(v), _awarded(v))
