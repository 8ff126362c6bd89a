"""Claim matching, adjudication, publication and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.operators.ranking import with_position
from factledger.plans import adjudication as adj
from factledger.plans import evidence as ev
from factledger.queries import register

TRANSCRIBED = ["court"]

PEERS = """peer AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY metric, dimension_type) AS n_peers
    FROM statistics WINDOW w AS (PARTITION BY metric, dimension_type ORDER BY value, stat_id)),
  sets AS (SELECT metric, dimension_type, count(*) AS n_peers,
    arg_min(stat_id, place) AS low_id, arg_max(stat_id, place) AS high_id,
    arg_min(value, place) AS low_value, arg_max(value, place) AS high_value,
    list(stat_id ORDER BY stat_id) AS ids FROM peer GROUP BY ALL),
  own AS (SELECT metric, dimension_type, dimension_value, arg_min(stat_id, place) AS r_id, min(place) AS place,
    arg_min(value, place) AS r_value, arg_min(source_url, place) AS r_url,
    min(stat_id) AS l_id, arg_min(value, stat_id) AS l_value, arg_min(source_url, stat_id) AS l_url
    FROM peer GROUP BY ALL)"""

VERDICTS = (
    PEERS
    + """,
  matched AS (SELECT c.*, s.n_peers, s.low_id, s.high_id, s.low_value, s.high_value, s.ids,
      o.r_id, o.place, o.r_value, o.r_url, o.l_id, o.l_value, o.l_url,
      CASE WHEN assertion = 'superlative_min' THEN low_id ELSE high_id END AS ext_id,
      CASE WHEN assertion = 'superlative_min' THEN low_value ELSE high_value END AS ext_value,
      CAST(format('{:.4f}', claimed_value - l_value) AS DOUBLE) AS v_gap
    FROM claims c LEFT JOIN sets s USING (metric, dimension_type)
    LEFT JOIN own o USING (metric, dimension_type, dimension_value)),
  measured AS (SELECT *, abs(v_gap) / greatest(abs(l_value), 1e-9) AS rel,
      CASE WHEN assertion = 'superlative_min' THEN place / (n_peers - 1)
           ELSE 1.0::DOUBLE - place / (n_peers - 1) END AS distance,
      least(1.0::DOUBLE, n_peers / 10.0::DOUBLE) AS coverage FROM matched),
  verdict AS (SELECT statement_id, politician_id, metric, dimension_type, dimension_value, assertion, claimed_value,
      source_type, source_url, coalesce(n_peers, 0) AS n_peers, ids, ext_value, r_value, l_value, v_gap,
      CASE WHEN assertion = 'value' THEN CASE WHEN l_id IS NULL OR claimed_value IS NULL THEN 'unverifiable'
             WHEN rel <= 0.05 THEN 'consistent' WHEN rel >= 0.25 THEN 'inconsistent' ELSE 'unverifiable' END
           WHEN r_id IS NULL THEN 'unverifiable' WHEN r_id = ext_id THEN 'consistent' ELSE 'inconsistent' END AS outcome,
      CASE WHEN assertion = 'value' THEN CASE WHEN l_id IS NULL OR claimed_value IS NULL THEN 0.0
             WHEN rel <= 0.05 THEN 0.9 WHEN rel >= 0.25 THEN CAST(format('{:.4f}', least(0.97::DOUBLE, 0.6::DOUBLE + rel)) AS DOUBLE) ELSE 0.5 END
           WHEN r_id IS NULL THEN 0.0 WHEN r_id = ext_id THEN CAST(format('{:.4f}', 0.5::DOUBLE + 0.4::DOUBLE * coverage) AS DOUBLE)
           ELSE CAST(format('{:.4f}', least(0.97::DOUBLE, distance * coverage)) AS DOUBLE) END::DOUBLE AS confidence,
      CASE WHEN assertion = 'value' THEN CASE WHEN l_id IS NOT NULL AND claimed_value IS NOT NULL THEN v_gap END
           WHEN r_id IS NULL THEN NULL WHEN r_id = ext_id THEN 0.0 ELSE CAST(format('{:.4f}', r_value - ext_value) AS DOUBLE) END AS numeric_gap,
      CASE WHEN assertion = 'value' THEN CASE WHEN claimed_value IS NOT NULL THEN l_id END ELSE r_id END
        AS official_statistic_id,
      CASE WHEN assertion = 'value' THEN CASE WHEN claimed_value IS NOT NULL THEN l_url END ELSE r_url END AS statistic_url
    FROM measured),
  gated AS (SELECT *, outcome IN ('consistent', 'inconsistent') AND confidence >= 0.85
      AND source_type NOT IN ('court') AS published FROM verdict)"""
)


@register(
    "peer_rank",
    "statistics",
    f"WITH {PEERS} SELECT stat_id, metric, dimension_value, value, place FROM peer",
)
def peer_rank(v):
    """Place of every statistic in its peer set."""
    return adj.peer_members(v.statistics()).select("stat_id", "metric", "dimension_value", "value", "place")


@register(
    "claim_matching",
    "statistics claims",
    f"""WITH {PEERS} SELECT statement_id, coalesce(n_peers, 0) AS n_peers, low_id, high_id, r_id AS own_id
    FROM claims LEFT JOIN sets USING (metric, dimension_type) LEFT JOIN own USING (metric, dimension_type, dimension_value)""",
)
def claim_matching(v):
    """Each claim with its peer set's size and extremes and its own dimension's statistic."""
    matched = adj.match_statistics(v.claims(), v.statistics())
    return matched.select(
        "statement_id",
        F.coalesce("n_peers", F.lit(0)).cast("bigint").alias("n_peers"),
        F.col("lowest.stat_id").alias("low_id"),
        F.col("highest.stat_id").alias("high_id"),
        F.col("ranked.stat_id").alias("own_id"),
    )


@register(
    "claim_adjudication",
    "statistics claims",
    f"""WITH {VERDICTS} SELECT statement_id, n_peers, outcome, confidence, numeric_gap, official_statistic_id, statistic_url
    FROM verdict""",
)
def claim_adjudication(v):
    """Outcome, confidence and gap of every claim."""
    drafts = adj.adjudicate(adj.match_statistics(v.claims(), v.statistics()))
    return drafts.select(
        "statement_id", "n_peers", "outcome", "confidence", "numeric_gap", "official_statistic_id", "statistic_url"
    )


@register(
    "verdict_rationale",
    "statistics claims",
    f"""WITH {VERDICTS} SELECT statement_id, CASE
      WHEN n_peers = 0 THEN 'אין נתון רשמי תואם להכרעה.'
      WHEN official_statistic_id IS NULL AND assertion = 'value' THEN 'אין נתון מספרי תואם לאימות הערך הנטען.'
      WHEN official_statistic_id IS NULL THEN 'הממד הנטען אינו קיים בקטלוג הנתונים הרשמי.'
      WHEN assertion = 'value' THEN 'הערך הנטען ' || claimed_value || ' מול הנתון הרשמי ' || l_value || ' (פער ' || v_gap || ').'
      WHEN outcome = 'consistent' THEN 'הטענה עקבית: ' || dimension_value || ' הוא אכן הערך ה' ||
        CASE assertion WHEN 'superlative_min' THEN 'נמוך' ELSE 'גבוה' END || ' ביותר מבין ' || n_peers || ' ערכים.'
      ELSE 'הטענה אינה תואמת נתונים רשמיים: ' || dimension_value || ' אינו ה' ||
        CASE assertion WHEN 'superlative_min' THEN 'נמוך' ELSE 'גבוה' END || ' ביותר; ערכו ' || r_value ||
        ' לעומת הקיצון ' || ext_value || ' (מתוך ' || n_peers || ' ערכים).' END AS rationale FROM verdict""",
)
def verdict_rationale(v):
    drafts = adj.adjudicate(adj.match_statistics(v.claims(), v.statistics()))
    return drafts.select("statement_id", "rationale")


@register(
    "verdict_statistic_ids",
    "statistics claims",
    f"""WITH {PEERS} SELECT statement_id, stat_id FROM claims JOIN peer USING (metric, dimension_type)""",
)
def verdict_statistic_ids(v):
    """Every statistic each verdict considered, one row each."""
    return adj.considered_statistics(_verdicts(v), v.statistics())


@register(
    "large_peer_set",
    "",
    """WITH p AS (SELECT p_partkey AS stat_id, p_retailprice AS value, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place,
        count(*) OVER () AS n FROM part), e AS (SELECT arg_min(stat_id, place) AS low FROM p)
    SELECT place, stat_id, n AS n_peers, stat_id = low AS consistent FROM p, e""",
)
def large_peer_set(v):
    """One peer set of all parts: its members in order, and the verdict on each as the lowest."""
    stats = v.table("part").select(
        F.col("p_partkey").alias("stat_id"),
        F.lit("price").alias("metric"),
        F.lit("part").alias("dimension_type"),
        F.col("p_partkey").cast("string").alias("dimension_value"),
        F.col("p_retailprice").alias("value"),
        F.lit("https://prices").alias("source_url"),
    )
    claims = stats.select(
        F.col("stat_id").alias("statement_id"),
        F.lit(1).cast("bigint").alias("politician_id"),
        "metric",
        "dimension_type",
        "dimension_value",
        F.lit("superlative_min").alias("assertion"),
        F.lit(None).cast("double").alias("claimed_value"),
        F.lit("cbs").alias("source_type"),
        "source_url",
    )
    verdicts, _, members = adj.verify(claims, stats)
    held = verdicts.select(
        F.col("statement_id").alias("stat_id"), "n_peers", (F.col("outcome") == "consistent").alias("consistent")
    )
    return members.join(held, "stat_id").select("place", "stat_id", "n_peers", "consistent")


def _verdicts(v):
    return adj.verify(v.claims(), v.statistics(), transcription_sources=TRANSCRIBED)[0]


@register(
    "publish_gate",
    "statistics claims",
    f"""WITH {VERDICTS} SELECT source_type, outcome, published,
      CASE WHEN published THEN 'approved' ELSE 'pending' END AS review_status, count(*) AS verdicts
    FROM gated GROUP BY ALL""",
)
def publish_gate(v):
    """How the gate decides, by source type and outcome."""
    drafts = adj.adjudicate(adj.match_statistics(v.claims(), v.statistics()))
    gated = adj.publish_gate(drafts, transcription_sources=TRANSCRIBED)
    return gated.groupBy("source_type", "outcome", "published", "review_status").agg(F.count("*").alias("verdicts"))


@register(
    "claim_verdicts",
    "statistics claims",
    f"""WITH {VERDICTS} SELECT statement_id, official_statistic_id, outcome, confidence, numeric_gap,
      source_url AS statement_url, statistic_url, 'rule-based-v0' AS adjudicator_version, published,
      published AS auto_published, CASE WHEN published THEN 'approved' ELSE 'pending' END AS review_status FROM gated""",
)
def claim_verdicts(v):
    """Match, adjudicate and gate every claim."""
    return _verdicts(v).select(
        "statement_id",
        "official_statistic_id",
        "outcome",
        "confidence",
        "numeric_gap",
        "statement_url",
        "statistic_url",
        "adjudicator_version",
        "published",
        "auto_published",
        "review_status",
    )


@register(
    "verdict_leaderboard",
    "statistics claims people",
    f"""WITH {VERDICTS}, board AS (SELECT 'person-' || p.person_id AS slug, p.person_id, full_name, party,
        count(*) AS contradicted_count FROM gated g JOIN people p ON p.person_id = g.politician_id
      WHERE published AND outcome = 'inconsistent' GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY contradicted_count DESC, person_id) AS position FROM board""",
)
def verdict_leaderboard(v):
    """People by published statements that contradict official data."""
    return with_position(adj.verdict_leaderboard(_verdicts(v), v.people()))


# --- evidence -----------------------------------------------------------------
EVIDENCE = """labelled AS (SELECT v.person_id, 0 AS kind_no, 'vote' AS evidence_kind, v.vote_id AS evidence_id,
      v.source_url AS evidence_url, 'vote (' || stance || ') on ''' || title || '''' AS label
    FROM votes v LEFT JOIN vote_events e USING (event_id)
    UNION ALL SELECT person_id, 1, 'action', action_id, source_url, action_type FROM actions),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY kind_no, evidence_id) AS candidate_no,
      count(*) OVER (PARTITION BY person_id) AS n_candidates FROM labelled)"""


def _rationale(kind: str, label: str) -> str:
    return (
        "'[heuristic-stub-v0] Candidate for human review (NOT a verdict). This ' || "
        + kind
        + " || ' record (' || "
        + label
        + " || ') is part of the politician''s voting/action history and may be relevant to the claim: \"' || claim || "
        + "'\". A reviewer should compare the claim against this record using both linked sources. No contradiction is "
        + "asserted; this flag was produced by a non-LLM structural stub pending the Phase 2 RAG comparison.'"
    )


@register(
    "vote_labels",
    "votes vote_events",
    """SELECT person_id, event_id, 'vote (' || stance || ')' || coalesce(' on ''' || title || '''', '') AS label
    FROM votes LEFT JOIN vote_events USING (event_id)""",
)
def vote_labels(v):
    """Votes labelled with stance and event title."""
    return ev.vote_labels(v.votes(), v.vote_events()).select("person_id", "event_id", "label")


@register(
    "record_candidates",
    "statements votes vote_events actions",
    f"""WITH {EVIDENCE} SELECT statement_id, s.person_id, evidence_kind, evidence_id, s.source_url AS statement_url,
      evidence_url, 'needs_review' AS status, {_rationale('evidence_kind', 'label')} AS rationale, candidate_no, n_candidates
    FROM statements s JOIN ranked USING (person_id) WHERE candidate_no <= 3""",
)
def record_candidates(v):
    """The first page of review candidates of every statement (three per page)."""
    evidence = ev.gather_evidence(v.votes(), v.vote_events(), v.actions())
    out = ev.record_candidates(v.statements(), evidence, 3)
    return out.select(
        "statement_id",
        "person_id",
        "evidence_kind",
        "evidence_id",
        "statement_url",
        "evidence_url",
        "status",
        "rationale",
        F.col("candidate_no").cast("bigint").alias("candidate_no"),
        "n_candidates",
    )


@register(
    "review_evidence",
    "votes vote_events actions",
    f"""WITH {EVIDENCE} SELECT person_id, evidence_kind, evidence_id, evidence_url, label, candidate_no, n_candidates
    FROM ranked WHERE coalesce(evidence_url, '') <> ''""",
)
def review_evidence(v):
    """The complete evidence list of every person, which all statements of the person share."""
    evidence = ev.gather_evidence(v.votes(), v.vote_events(), v.actions())
    return ev.ranked_evidence(evidence).select(
        "person_id", "evidence_kind", "evidence_id", "evidence_url", "label", "candidate_no", "n_candidates"
    )


@register(
    "review_statements",
    "statements votes vote_events actions",
    f"""WITH {EVIDENCE}, n AS (SELECT person_id, max(n_candidates) AS n FROM ranked GROUP BY person_id)
    SELECT statement_id, person_id, coalesce(n, 0) AS n_candidates FROM statements LEFT JOIN n USING (person_id)""",
)
def review_statements(v):
    """Every statement with the number of its review candidates."""
    evidence = ev.ranked_evidence(ev.gather_evidence(v.votes(), v.vote_events(), v.actions()))
    sizes = evidence.groupBy("person_id").agg(F.max("n_candidates").alias("n"))
    return v.statements().join(sizes, "person_id", "left").select(
        "statement_id", "person_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates")
    )


@register(
    "record_candidates_next",
    "statements votes vote_events actions",
    f"""WITH {EVIDENCE}, later AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY kind_no, evidence_id) AS no
      FROM ranked WHERE kind_no > 0 OR evidence_id > 300)
    SELECT statement_id, evidence_kind, evidence_id, n_candidates FROM statements JOIN later USING (person_id) WHERE no <= 2""",
)
def record_candidates_next(v):
    """A later page: the evidence after vote 300 of each person."""
    evidence = ev.gather_evidence(v.votes(), v.vote_events(), v.actions())
    out = ev.record_candidates(v.statements(), evidence, 2, after=("vote", 300))
    return out.select("statement_id", "evidence_kind", "evidence_id", "n_candidates")


@register(
    "evidence_union",
    "votes vote_events actions",
    f"""WITH {EVIDENCE} SELECT person_id, evidence_kind, count(*) AS n, min(evidence_id) AS first_id,
      max(evidence_id) AS last_id FROM labelled GROUP BY ALL""",
)
def evidence_union(v):
    """Evidence of all kinds per person."""
    evidence = ev.gather_evidence(v.votes(), v.vote_events(), v.actions())
    return evidence.groupBy("person_id", "evidence_kind").agg(
        F.count("*").alias("n"), F.min("evidence_id").alias("first_id"), F.max("evidence_id").alias("last_id")
    )


NEAREST = """s AS (SELECT claim_id, vec_id AS evidence_id,
        round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings)
    SELECT claim_id, evidence_id, similarity, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id
      ORDER BY similarity DESC, evidence_id) AS INTEGER) AS place FROM s)"""


@register("nearest_evidence", "", f"WITH q AS (SELECT vec_id AS claim_id, embedding AS qv FROM embeddings), {NEAREST} WHERE place <= 10")
def nearest_evidence(v):
    """Ten nearest vectors of every vector."""
    e = v.table("embeddings")
    claims = e.select(F.col("vec_id").alias("claim_id"), "embedding")
    return ev.nearest_evidence(claims, e.withColumnRenamed("vec_id", "evidence_id"), 10)


@register(
    "nearest_evidence_blocks",
    "",
    f"""WITH q AS (SELECT vec_id * 10 + k AS claim_id, embedding[k + 1:] || embedding[:k] AS qv
      FROM embeddings, (SELECT unnest(range(10)) AS k)), {NEAREST} WHERE place <= 3""",
)
def nearest_evidence_blocks(v):
    """More claims than one block holds: every vector, turned by 0 to 9 places."""
    e = v.table("embeddings")
    turned = F.concat(F.expr("slice(embedding, k + 1, 64)"), F.expr("slice(embedding, 1, k)")).alias("embedding")
    claims = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select(
        (F.col("vec_id") * 10 + F.col("k")).alias("claim_id"), turned
    )
    return ev.nearest_evidence(claims, e.withColumnRenamed("vec_id", "evidence_id"), 3)
