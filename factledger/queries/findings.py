"""Findings store, review decisions, leaderboards, fact-check gate and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.operators.merge import union_keys
from factledger.operators.ranking import with_position
from factledger.plans import factcheck, listings, review
from factledger.queries import register

COLS = ["id", "pos", "person_id", "speaker_name", "video_id", "url", "quote", "outcome", "status"]

STORE = """stored AS (SELECT id, pos, person_id, speaker_name, video_id, CAST(NULL AS VARCHAR) AS url, quote, outcome, status
      FROM findings WHERE quality = 1 AND toxic = 0),
  retracted AS (SELECT person_id, video_id, quote FROM findings WHERE toxic = 1),
  offered AS (SELECT * REPLACE (CASE WHEN quality = 0 THEN 'rejected' ELSE 'confirmed' END AS status) FROM findings),
  known AS (SELECT person_id, video_id, quote FROM stored UNION SELECT * FROM retracted),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, video_id, quote ORDER BY pos) AS rn FROM offered o
      WHERE status = 'confirmed' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.person_id = o.person_id AND k.quote = o.quote
        AND k.video_id IS NOT DISTINCT FROM o.video_id)) WHERE rn = 1)"""


def _store(v):
    f = v.findings()
    stored = f.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).withColumn("url", F.lit(None).cast("string"))
    retracted = f.filter(F.col("toxic") == 1).select(*review.FINDING_KEY)
    offered = f.withColumn("status", F.when(F.col("quality") == 0, "rejected").otherwise("confirmed"))
    return stored.select(*COLS), offered, retracted


@register(
    "findings_merge",
    "findings",
    f"""WITH {STORE}, top AS (SELECT max(CAST(substr(id, 3) AS BIGINT)) AS t FROM stored)
    SELECT id, pos, person_id, video_id, url, outcome, status FROM stored UNION ALL
    SELECT 'F-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END, pos, person_id, video_id,
      'https://www.youtube.com/watch?v=' || coalesce(video_id, 'None'), outcome, status
    FROM (SELECT *, t + row_number() OVER (ORDER BY pos) AS n FROM fresh, top)""",
)
def findings_merge(v):
    """New confirmed findings merged into the store, ids continued."""
    stored, offered, retracted = _store(v)
    out = review.merge_findings(stored, offered, retracted)
    return out.select("id", "pos", "person_id", "video_id", "url", "outcome", "status")


@register(
    "findings_backlog",
    "findings",
    """WITH old AS (SELECT person_id, video_id, quote, pos FROM findings WHERE status = 'candidate')
    SELECT person_id, video_id, pos FROM old UNION ALL SELECT person_id, video_id, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id, video_id, quote ORDER BY pos) AS rn FROM findings f
      WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.person_id = f.person_id AND o.quote = f.quote
        AND o.video_id IS NOT DISTINCT FROM f.video_id)) WHERE rn = 1""",
)
def findings_backlog(v):
    """Claims wanting a statistic, appended once per key."""
    f = v.findings().select("person_id", "video_id", "quote", "pos", "status")
    old = f.filter(F.col("status") == "candidate").drop("status")
    return review.extend_backlog(old, f.drop("status")).select("person_id", "video_id", "pos")


@register(
    "adjudication_ledger",
    "findings",
    """WITH old AS (SELECT speaker_name, video_id AS claim, min(pos) AS pos FROM findings WHERE quality = 0 GROUP BY ALL),
      new AS (SELECT speaker_name, video_id AS claim, pos FROM findings)
    SELECT speaker_name, claim, pos FROM old UNION ALL SELECT speaker_name, claim, min(pos) FROM new n
      WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.speaker_name = n.speaker_name AND o.claim IS NOT DISTINCT FROM n.claim)
      GROUP BY ALL""",
)
def adjudication_ledger(v):
    """Ledger of adjudicated ranking claims, appended once per (speaker, claim)."""
    f = v.findings().select("speaker_name", F.col("video_id").alias("claim"), "pos", "quality")
    old = f.filter(F.col("quality") == 0).groupBy("speaker_name", "claim").agg(F.min("pos").alias("pos"))
    return review.extend_ledger(old, f.drop("quality"))


def _decisions(v):
    """A reject or a confirm per labelled document, with a later one overruling it for some."""
    lab = v.table("labels")
    did = review.finding_id(F.col("doc_id"))
    first = lab.select(did.alias("id"), F.lit("reject").alias("decision"), F.lit("").alias("note"), F.lit(0).alias("pos"))
    later = lab.filter(F.col("toxic") == 0).select(
        did.alias("id"), F.lit("confirm").alias("decision"), F.lit("seen").alias("note"), F.lit(1).alias("pos")
    )
    return first.unionByName(later)


DECIDED = """judged AS (SELECT f.*, l.toxic IS NOT NULL AND f.id IS NOT NULL AS decided, l.toxic AS lt FROM findings f
    LEFT JOIN labels l ON f.pos = l.doc_id)"""


@register(
    "review_decisions",
    "findings",
    f"""WITH {DECIDED} SELECT id, pos, status, CASE WHEN decided THEN true END AS affirmed,
      CASE WHEN decided THEN 'seen' END AS review_note FROM judged WHERE NOT (decided AND lt = 1)""",
)
def review_decisions(v):
    """Findings after the review: rejected ones gone, confirmed ones marked."""
    kept, _ = review.apply_decisions(v.findings(), _decisions(v))
    return kept.select("id", "pos", "status", "affirmed", "review_note")


@register(
    "review_blocklist",
    "findings",
    f"""WITH {DECIDED} SELECT DISTINCT person_id, video_id, md5(quote) AS quote_md5 FROM (
      SELECT person_id, video_id, quote FROM judged WHERE decided AND lt = 1 UNION
      SELECT person_id, video_id, quote FROM findings WHERE status = 'candidate')""",
)
def review_blocklist(v):
    """Blocklist keys after adding the rejected findings."""
    f = v.findings()
    _, rejected = review.apply_decisions(f, _decisions(v))
    old = f.filter(F.col("status") == "candidate")
    return review.extend_blocklist(old, rejected).select("person_id", "video_id", F.md5("quote").alias("quote_md5"))


@register(
    "finding_counts",
    "findings",
    """SELECT count(*) AS total, count_if(outcome = 'contradicted')::BIGINT AS contradicted,
      count_if(outcome = 'consistent')::BIGINT AS consistent, count_if(status = 'confirmed')::BIGINT AS confirmed FROM findings""",
)
def finding_counts(v):
    return review.finding_counts(v.findings())


BOARD = """board AS (SELECT 'person-' || f.person_id AS slug, coalesce(a.name, arg_max(f.speaker_name, f.pos)) AS full_name,
      coalesce(a.party, '') AS party, count(*) AS contradicted_count FROM findings f LEFT JOIN actors a USING (person_id)
    WHERE outcome = 'contradicted' AND status IN ('confirmed', 'published', 'reviewed') GROUP BY f.person_id, a.name, a.party)"""


def _board(v):
    return review.findings_leaderboard(v.findings(), v.actors().withColumn("pos", F.col("person_id")))


@register("findings_leaderboard", "findings actors", f"""WITH {BOARD}
    SELECT *, row_number() OVER (ORDER BY contradicted_count DESC, slug) AS position FROM board""")
def findings_leaderboard(v):
    """People by human-published contradicted findings."""
    return with_position(_board(v))


@register(
    "leaderboard_bars",
    "findings actors",
    f"""WITH {BOARD} SELECT slug, contradicted_count,
      CAST(floor(contradicted_count / greatest(1, max(contradicted_count) OVER ()) * 100 + 0.5) AS INTEGER) AS bar FROM board""",
)
def leaderboard_bars(v):
    """Leaderboard with bar widths."""
    return review.with_bars(_board(v)).select("slug", "contradicted_count", "bar")


@register(
    "leaderboard_topic",
    "findings actors",
    f"""WITH {BOARD} SELECT slug FROM board JOIN (SELECT DISTINCT person_id FROM findings WHERE video_id = 'de'
        AND outcome = 'contradicted') t ON slug = 'person-' || t.person_id""",
)
def leaderboard_topic(v):
    """Leaderboard rows of one topic (here the language of a finding)."""
    topics = v.findings().filter(F.col("outcome") == "contradicted").groupBy(
        F.concat(F.lit("person-"), F.col("person_id")).alias("slug")
    ).agg(F.collect_set("video_id").alias("topics"))  # at most one entry per language
    return review.with_topic(_board(v).join(topics, "slug"), "de").select("slug")


@register(
    "profile_findings",
    "findings",
    """SELECT pos, outcome, quality = 0 AS own_words FROM findings
    WHERE person_id = 7 AND (outcome = 'contradicted' OR quality = 0)""",
)
def profile_findings(v):
    """Findings on one person's profile."""
    f = v.findings().withColumn("type", F.when(F.col("quality") == 0, "self_contradiction"))
    return review.profile_findings(f, "7").select(
        "pos", "outcome", (F.col("quality") == 0).alias("own_words")
    )


@register(
    "public_findings",
    "findings",
    """SELECT id, pos, outcome, row_number() OVER (ORDER BY CASE outcome WHEN 'contradicted' THEN 0 ELSE 1 END, pos) AS position
    FROM findings WHERE status = 'confirmed'""",
)
def public_findings(v):
    """The public subset, contradictions first."""
    listed = review.contradictions_first(review.public_findings(v.findings())).select("id", "pos", "outcome")
    return with_position(listed)


@register(
    "finding_statuses",
    "findings",
    "SELECT status, count(*) AS n FROM findings GROUP BY status",
)
def finding_statuses(v):
    """Findings per status (same report as adjudications per verdict)."""
    from factledger.plans.corpus import count_by

    return count_by(v.findings(), "status")


# --- fact-check gate ----------------------------------------------------------------------
KEYWORDS = {"URGENT": ["ring", "bolt"], "HIGH": ["gear"], "MEDIUM": ["anvil", "plate"], "LOW": ["widget", "gizmo", "ring"]}

ROUTED = """topics(topic_key, word) AS (VALUES ('URGENT','ring'), ('URGENT','bolt'), ('HIGH','gear'), ('MEDIUM','anvil'),
      ('MEDIUM','plate'), ('LOW','widget'), ('LOW','gizmo'), ('LOW','ring')),
  routed AS (SELECT topic_key, p_partkey AS pos, p_name AS metric, p_brand AS dimension_value, p_retailprice AS value,
      row_number() OVER (PARTITION BY topic_key ORDER BY p_partkey) - 1 AS stat_index
    FROM part JOIN (SELECT DISTINCT * FROM topics) ON contains(lower(p_name), word))"""


def _stats(v):
    return v.table("part").select(
        F.col("p_partkey").alias("pos"),
        F.col("p_name").alias("metric"),
        F.col("p_brand").alias("dimension_value"),
        F.col("p_retailprice").alias("value"),
        F.lit("nis").alias("unit"),
        F.col("p_size").cast("string").alias("period"),
        F.col("p_type").alias("source_org"),
        F.concat(F.lit("https://p.example/"), F.col("p_partkey")).alias("source_url"),
        F.lit(None).cast("string").alias("confirm_quote"),
    )


def _checked_claims(v):
    """Verdicts from JSON answers whose index is an integer, a text or a fraction."""
    o = v.table("orders")
    outcome = (
        F.when(F.col("o_orderstatus") == "F", "contradicted")
        .when(F.col("o_orderstatus") == "O", "consistent")
        .otherwise("unverifiable")
    )
    key = F.col("o_custkey").cast("string")
    index = (
        F.when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit('"'), key, F.lit('"')))
        .when(F.col("o_orderkey") % 7 == 2, F.concat(key, F.lit(".5")))
        .otherwise(key)
    )
    answers = o.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("topic"),
        F.format_string('```json\n{"outcome": "%s", "stat_index": %s, "confidence": 0.9}\n```', outcome, index).alias("answer"),
    )
    return factcheck.parse_verdicts(answers)


@register("topic_routing", "", f"WITH {ROUTED} SELECT topic_key, pos, stat_index FROM routed")
def topic_routing(v):
    """Statistics per topic with their index in the topic's list."""
    return factcheck.topic_statistics(_stats(v), KEYWORDS).select("topic_key", "pos", "stat_index")


@register(
    "finding_gate",
    "",
    f"""WITH {ROUTED}, c AS (SELECT o_orderkey AS claim_id, o_orderpriority AS topic,
        CASE o_orderstatus WHEN 'F' THEN 'contradicted' WHEN 'O' THEN 'consistent' ELSE 'unverifiable' END AS outcome,
        CASE WHEN o_orderkey % 7 NOT IN (1, 2) THEN o_custkey END AS stat_no,
        CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'URGENT' WHEN contains(o_orderpriority, 'HIGH') THEN 'HIGH'
          WHEN contains(o_orderpriority, 'MEDIUM') THEN 'MEDIUM' WHEN contains(o_orderpriority, 'LOW') THEN 'LOW' END AS topic_key
      FROM orders)
    SELECT claim_id, topic, outcome, metric AS stat_metric, value AS stat_value, 'candidate' AS status
    FROM c JOIN routed ON c.topic_key = routed.topic_key AND stat_no = stat_index WHERE outcome <> 'unverifiable'""",
)
def finding_gate(v):
    """Candidate findings: decisive verdicts whose index names a statistic of the claim's topic."""
    out = factcheck.gate_findings(_checked_claims(v), _stats(v), KEYWORDS)
    return out.select(
        "claim_id",
        "topic",
        "outcome",
        F.col("stat.metric").alias("stat_metric"),
        F.col("stat.value").alias("stat_value"),
        "status",
    )


@register(
    "stat_prompt_lines",
    "",
    f"""WITH {ROUTED} SELECT topic_key, stat_index // 100 AS list_no, md5(string_agg(stat_index || ': ' || metric || ' | '
      || dimension_value || ' = ' || value || ' nis (' || p_size || ') — מקור: ' || p_type, chr(10) ORDER BY stat_index)) AS lines_md5
    FROM routed JOIN part ON p_partkey = pos GROUP BY ALL""",
)
def stat_prompt_lines(v):
    """Numbered statistics per topic, cut into lists a prompt can carry."""
    lists = factcheck.stat_lists(_stats(v), KEYWORDS, 100)
    return lists.select("topic_key", "list_no", F.md5("stat_lines").alias("lines_md5"))


@register(
    "json_recovery",
    "",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def json_recovery(v):
    """JSON recovered from model-like answers: fenced, bare, wrapped in prose, or broken."""
    e = v.table("events")
    answer = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nbye")))
        .when(F.col("event_type") == "view", F.concat(F.lit("the answer is "), "props", F.lit(" - done")))
        .when(F.col("event_type") == "error", F.concat(F.lit("sorry ["), F.lit("no json")))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", factcheck.parse_json(answer, "struct<k:bigint>")["k"].alias("k"))


@register(
    "segment_recovery",
    "",
    """SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS INTEGER) AS segments,
      value AS first_start FROM events""",
)
def segment_recovery(v):
    """Segments parsed from model-like answers; malformed rows are skipped."""
    e = v.table("events")
    good = F.concat(F.lit('{"start": '), F.col("value").cast("string"), F.lit(', "end": "9.5", "text": " a "}'))
    second = F.when(F.col("event_type") == "error", '{"start": "soon", "text": "b"}').otherwise(
        '{"start": 1, "end": 2, "text": "b"}'
    )
    body = F.concat(F.lit("["), good, F.lit(","), second, F.lit("]"))
    answer = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    parsed = e.select("event_id", factcheck.parse_segments(answer).alias("s"))
    return parsed.select("event_id", F.size("s").alias("segments"), F.get("s", 0)["start"].alias("first_start"))


@register(
    "processed_union",
    "findings",
    "SELECT DISTINCT pos FROM findings WHERE quality = 1 OR toxic = 0",
)
def processed_union(v):
    """Union of two processed sets."""
    f = v.findings()
    return union_keys(f.filter(F.col("quality") == 1).select("pos"), f.filter(F.col("toxic") == 0).select("pos"))


@register(
    "role_cards",
    "appointments",
    """SELECT person_id, pos, position, count(*) OVER c AS role_count, min(pos) OVER c AS card_pos,
      bool_or(contains(position, 'gear')) OVER c AS charted FROM appointments WINDOW c AS (PARTITION BY person_id)
    """.join(["SELECT *, row_number() OVER (ORDER BY charted DESC, card_pos, person_id, pos) AS place FROM (", ")"]),
)
def role_cards(v):
    """The roles of every person, grouped into cards."""
    a = v.appointments()
    charted = a.filter(F.col("position").contains("gear"))
    out = listings.role_cards(a, charted)
    return with_position(out.select("person_id", "pos", "position", "role_count", "card_pos", "charted"), "place")
