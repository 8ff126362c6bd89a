"""Topic map, ranking claims, conflicting numbers, search and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.functions.text import transcript_parts
from factledger.operators import postings
from factledger.operators.merge import union_first
from factledger.operators.ranking import with_position
from factledger.plans import conflicts, corpus, listings
from factledger.queries import register
from factledger.session import cut_lineage

# Keywords and patterns that occur in the driver's corpus.
TOPICS = {
    "common": ("Common words", ["heed", "blesh"]),
    "ring": ("Rings", ["schen"]),
    "bolt": ("Bolts", ["ción", "und "]),
    "gear": ("Gears", ["Quevi", "eaux"]),
    "silent": ("Never said", ["zzzqqq"]),
}
RANK = r"(?U)\b[Tt]h\S+ (the|of|and)\b"
TOPIC = r"ation|heed|ering"

TOPIC_SQL = """hits AS (SELECT person_id, unnest(list_filter([
      CASE WHEN contains(text, 'heed') OR contains(text, 'blesh') THEN 'common' END,
      CASE WHEN contains(text, 'schen') THEN 'ring' END,
      CASE WHEN contains(text, 'ción') OR contains(text, 'und ') THEN 'bolt' END,
      CASE WHEN contains(text, 'Quevi') OR contains(text, 'eaux') THEN 'gear' END,
      CASE WHEN contains(text, 'zzzqqq') THEN 'silent' END], lambda x: x IS NOT NULL)) AS topic FROM segments),
  edges AS (SELECT person_id, topic, count(*) AS weight FROM hits GROUP BY ALL HAVING count(*) >= 2)"""


def _edges(v):
    return corpus.topic_edges(v.segments(), TOPICS)


@register(
    "topic_edges",
    "segments actors",
    f"""WITH {TOPIC_SQL}, s AS (SELECT DISTINCT person_id, speaker_name FROM segments)
    SELECT topic, e.person_id, coalesce(a.name, speaker_name) AS name, coalesce(party, '') AS party, weight
    FROM edges e LEFT JOIN actors a USING (person_id) LEFT JOIN s USING (person_id)""",
)
def topic_edges(v):
    """Who talks about what: segments per person and topic, with name and party."""
    spoken = v.segments().select("person_id", "speaker_name").distinct()
    return corpus.topic_people(_edges(v), v.actors(), spoken)


@register(
    "topic_summary",
    "segments series",
    f"""WITH {TOPIC_SQL}, t(topic_no, topic, topic_label, keyword) AS (VALUES (0,'common','Common words','heed'),
      (1,'ring','Rings','schen'), (2,'bolt','Bolts','ción'), (3,'gear','Gears','Quevi'), (4,'silent','Never said','zzzqqq')),
    n AS (SELECT topic, count(*) AS people FROM edges GROUP BY topic)
    SELECT topic, topic_label AS label, coalesce(unit, '') AS unit, coalesce(label, '') AS official_label,
      points[-1].year AS latest_year, points[-1].value AS latest_value,
      CASE WHEN key IS NULL THEN '' ELSE 'Sales office' END AS source_org,
      CASE WHEN key IS NULL THEN '' ELSE 'https://s.example/' || key END AS source_url, keyword,
      coalesce(people, 0) AS people,
      CAST(floor(coalesce(people, 0) / greatest(1, max(coalesce(people, 0)) OVER ()) * 100 + 0.5) AS INTEGER) AS bar,
      CAST(topic_no AS INTEGER) AS topic_no, row_number() OVER (ORDER BY coalesce(people, 0) DESC, topic_no) AS position
    FROM t LEFT JOIN n USING (topic) LEFT JOIN series ON key = topic""",
)
def topic_summary(v):
    """Topics with their official series and number of people, silent topics included."""
    from factledger.plans.series import latest_points

    return with_position(corpus.topic_summary(_edges(v), latest_points(v.series()), TOPICS))


@register(
    "topic_totals",
    "segments",
    f"""WITH {TOPIC_SQL} SELECT CAST(5 AS BIGINT) AS topics, count(DISTINCT person_id) AS people_connected,
      count(*) AS edges FROM edges""",
)
def topic_totals(v):
    return corpus.topic_totals(_edges(v), TOPICS)


RANKED = """hits AS (SELECT 'interview' AS source, person_id, speaker_name, video_id,
      CAST(round_even(start, 0) AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS url, trim(text) AS quote FROM segments
    UNION ALL SELECT 'tweet', person_id, handle, NULL, NULL, url, trim(text) FROM posts WHERE NOT starts_with(trim(text), 'RT @')),
  ranked AS (SELECT * FROM hits WHERE regexp_matches(quote, '(^|[^\\pL\\pN_])[Tt]h\\S+ (the|of|and)($|[^\\pL\\pN_])')
    AND regexp_matches(quote, 'ation|heed|ering'))"""


@register("ranking_claims", "segments posts", f"WITH {RANKED} SELECT * FROM ranked")
def ranking_claims(v):
    """Ranking statements on covered topics from segments and own posts."""
    return corpus.ranking_claims(v.segments(), v.posts(), RANK, TOPIC)


@register("claims_by_source", "segments posts", f"WITH {RANKED} SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS position FROM ranked GROUP BY 1")
def claims_by_source(v):
    return with_position(corpus.count_by(corpus.ranking_claims(v.segments(), v.posts(), RANK, TOPIC), "source"))


# --- conflicting numbers ---------------------------------------------------------
PAIRS = """pairs AS (SELECT a.person_id, a.metric, a.start, a.value, b.value AS other FROM number_claims a
    JOIN number_claims b ON a.person_id = b.person_id AND a.metric = b.metric AND a.video_id <> b.video_id
    WHERE abs(a.value - b.value) >= 3.0)"""


@register(
    "conflict_queue",
    "number_claims",
    f"""WITH {PAIRS}, q AS (SELECT start, count(*) AS conflicts, min(other) AS lo, max(other) AS hi FROM pairs GROUP BY start)
    SELECT person_id, metric, value, video_id, start, conflicts, CASE WHEN value - lo >= 3 THEN lo END AS lowest_partner,
      CASE WHEN hi - value >= 3 THEN hi END AS highest_partner, 'candidate' AS status FROM number_claims JOIN q USING (start)""",
)
def conflict_queue(v):
    """Every claim that disagrees with the person's own claim in another video."""
    return conflicts.conflict_queue(v.number_claims())


@register(
    "conflict_totals",
    "number_claims",
    f"""WITH {PAIRS} SELECT metric, CAST(count(*) / 2 AS BIGINT) AS pairs, count(DISTINCT person_id) AS people,
      row_number() OVER (ORDER BY count(*) DESC, metric) AS position FROM pairs GROUP BY metric""",
)
def conflict_totals(v):
    """Candidate pairs and people per metric."""
    return with_position(conflicts.conflict_totals(v.number_claims()))


@register(
    "conflicting_people", "number_claims", f"WITH {PAIRS} SELECT count(DISTINCT person_id) AS people FROM pairs"
)
def conflicting_people(v):
    return conflicts.conflicting_people(v.number_claims())


@register(
    "price_conflicts",
    "",
    """WITH c AS (SELECT l_suppkey AS person_id, l_returnflag AS metric, l_orderkey AS video_id,
        l_extendedprice * (1 - l_discount) AS value FROM lineitem)
    SELECT a.metric, CAST(count(*) / 2 AS BIGINT) AS pairs, count(DISTINCT a.person_id) AS people
    FROM c a JOIN c b ON a.person_id = b.person_id AND a.metric = b.metric AND a.video_id <> b.video_id
    WHERE abs(a.value - b.value) >= 3.0 GROUP BY a.metric""",
)
def price_conflicts(v):
    """Pairs per metric among values of many decimals."""
    claims = v.table("lineitem").select(
        F.col("l_suppkey").alias("person_id"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_orderkey").alias("video_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
    )
    return conflicts.conflict_totals(claims)


@register(
    "conflict_partners",
    "number_claims",
    """WITH picked AS (SELECT person_id, metric, arg_max(value, struct_pack(value, start)) AS a_value,
        arg_max(video_id, struct_pack(value, start)) AS a_video_id, arg_max(start, struct_pack(value, start)) AS a_start
      FROM number_claims GROUP BY person_id, metric)
    SELECT person_id, metric, a_value, a_video_id, a_start, value AS b_value, video_id AS b_video_id, start AS b_start
    FROM picked JOIN number_claims USING (person_id, metric)
    WHERE a_video_id <> video_id AND abs(a_value - value) >= 3.0""",
)
def conflict_partners(v):
    """All partners of each person's highest claim per metric."""
    claims = v.number_claims()
    top = F.max(F.struct("value", "start", "video_id")).alias("t")
    picked = claims.groupBy("person_id", "metric").agg(top).select("person_id", "metric", "t.value", "t.video_id", "t.start")
    return conflicts.partners_of(picked, claims)


@register(
    "percent_claims",
    "segments",
    r"""WITH q AS (SELECT person_id, video_id, CAST(round_even(start, 0) AS BIGINT) AS start, trim(text) AS quote FROM segments
        WHERE contains(text, '%')),
      m AS (SELECT *, CASE WHEN regexp_matches(quote, 'und') THEN 'and' WHEN regexp_matches(quote, 'th.{0,6}er') THEN 'th' END AS metric,
        TRY_CAST(nullif(regexp_extract(quote, '(\d{1,3}(?:\.\d)?)\s*(?:%|percent)', 1), '') AS DOUBLE) AS value FROM q)
    SELECT person_id, video_id, start, metric, value FROM m WHERE metric IS NOT NULL AND value IS NOT NULL""",
)
def percent_claims(v):
    """Segments with a percentage of a metric (few in the driver's corpus)."""
    metrics = [("und", "and"), ("th.{0,6}er", "th")]
    return conflicts.percent_claims(v.segments(), metrics).select("person_id", "video_id", "start", "metric", "value")


# --- search --------------------------------------------------------------------------
LINES = "l AS (SELECT * REPLACE (trim(text) AS text) FROM segments WHERE trim(text) <> '')"


@register(
    "search_segments",
    "segments",
    f"WITH {LINES} SELECT person_id, video_id, pos, CAST(format('{{:.1f}}', start) AS DOUBLE) AS start, text FROM l",
)
def search_segments(v):
    """Flat search index: one row per non-blank segment."""
    return corpus.search_segments(v.interviews()).select("person_id", "video_id", "pos", "start", "text")


@register(
    "search_index",
    "segments interviews",
    f"""WITH {LINES}, h AS (SELECT video_id, row_number() OVER (ORDER BY CAST(person_id AS VARCHAR),
        coalesce(published_at, '') DESC, video_id) - 1 AS interview_no FROM interviews)
    SELECT interview_no, pos, CAST(format('{{:.1f}}', start) AS DOUBLE) AS start, text FROM l JOIN h USING (video_id)""",
)
def search_index(v):
    """Segments with the dense number of their interview."""
    return corpus.search_index(v.interviews())[1]


ORACLE_SEARCH = f"""WITH {LINES} SELECT person_id, name, video_id, title, pos, CAST(format('{{:.1f}}', start) AS DOUBLE) AS start, text,
  url || '&t=' || CAST(floor(CAST(format('{{:.1f}}', start) AS DOUBLE)) AS BIGINT) AS link,
  printf('%02d:%02d', CAST(floor(CAST(format('{{:.1f}}', start) AS DOUBLE) / 60) AS BIGINT),
    CAST(floor(CAST(format('{{:.1f}}', start) AS DOUBLE)) AS BIGINT) % 60) AS clock
FROM l WHERE contains(text, 'heed') ORDER BY CAST(person_id AS VARCHAR), coalesce(published_at, '') DESC, video_id, pos
LIMIT 200"""


@register("segment_search", "segments", ORACLE_SEARCH)
def segment_search(v):
    """The first 200 hits of a search in index order, with deep links."""
    return corpus.search(corpus.search_segments(v.interviews()), "heed")


ORACLE_HITS = f"""WITH {LINES} SELECT person_id, video_id, count(*) AS hits, min(CAST(format('{{:.1f}}', start) AS DOUBLE)) AS first_start
FROM l WHERE contains(text, 'ing') GROUP BY ALL"""


@register("person_hits", "segments", ORACLE_HITS)
def person_hits(v):
    """Hits per interview for a profile search."""
    return corpus.person_hits(corpus.search_segments(v.interviews()), "ing")


def _posted(v):
    """A stored posting index of all segments, with a bucket for about 4,000 of them, 4,096 at most."""
    segments = cut_lineage(corpus.search_segments(v.interviews()))
    return postings.write_postings(segments, buckets=min(4096, max(8, segments.count() // 4000)))


@register("segment_search_posted", "segments", ORACLE_SEARCH)
def segment_search_posted(v):
    """The same search through the stored postings."""
    return corpus.search(postings.candidates(_posted(v), "heed"), "heed")


@register("person_hits_posted", "segments", ORACLE_HITS)
def person_hits_posted(v):
    """The same hits per interview through the stored postings."""
    return corpus.person_hits(postings.candidates(_posted(v), "ing"), "ing")


# --- reports ----------------------------------------------------------------------------
@register(
    "person_index",
    "actors interviews",
    """SELECT *, row_number() OVER (ORDER BY interview_count DESC, name, person_id) AS position FROM (
      SELECT a.person_id, a.name, a.party, count(video_id) AS interview_count,
        CAST(coalesce(sum(n_segments), 0) AS BIGINT) AS segment_count FROM actors a LEFT JOIN interviews USING (person_id)
      GROUP BY a.person_id, a.name, a.party)""",
)
def person_index(v):
    """Every roster person with interview and segment counts."""
    return with_position(corpus.person_index(v.actors(), v.interviews()))


@register(
    "index_totals",
    "actors interviews",
    """WITH i AS (SELECT a.person_id, count(video_id) AS n, coalesce(sum(n_segments), 0) AS s
      FROM actors a LEFT JOIN interviews USING (person_id) GROUP BY a.person_id)
    SELECT count(*) AS people, count_if(n > 0)::BIGINT AS with_interviews, CAST(sum(n) AS BIGINT) AS interviews,
      CAST(sum(s) AS BIGINT) AS segments FROM i""",
)
def index_totals(v):
    """Corpus totals of the home page."""
    return corpus.index_totals(corpus.person_index(v.actors(), v.interviews()))


@register(
    "interview_cards",
    "interviews",
    """SELECT person_id, video_id, title, published_at, CAST(floor(duration_sec / 60 + 0.5) AS INTEGER) AS minutes,
      CAST(n_segments AS INTEGER) AS segment_count,
      row_number() OVER (ORDER BY person_id, coalesce(published_at, '') DESC, video_id) AS position FROM interviews""",
)
def interview_cards(v):
    return with_position(corpus.interview_cards(v.interviews()))


@register(
    "people_with_interviews",
    "actors interviews",
    "SELECT * FROM actors WHERE person_id IN (SELECT person_id FROM interviews)",
)
def people_with_interviews(v):
    return corpus.people_with_interviews(v.actors(), v.interviews())


@register(
    "post_index",
    "posts",
    "SELECT person_id, handle, count(*) AS posts FROM posts WHERE trim(text) <> '' GROUP BY ALL",
)
def post_index(v):
    return corpus.post_index(v.posts())


@register(
    "latest_posts",
    "posts",
    """SELECT person_id, pos, url, CAST(rn AS INTEGER) AS post_no FROM (SELECT *, row_number() OVER (PARTITION BY person_id
      ORDER BY pos) AS rn FROM posts) WHERE rn <= 15""",
)
def latest_posts(v):
    """The first fifteen posts of every profile."""
    return listings.latest_posts(v.posts(), 15).select("person_id", "pos", "url", "post_no")


@register(
    "corpus_status",
    "interviews findings",
    """SELECT count(*) AS transcripts, count(DISTINCT person_id) AS people_with_interviews,
      (SELECT count(*) FROM findings) AS total,
      (SELECT count(*) FROM findings WHERE outcome = 'contradicted') AS contradicted,
      (SELECT count(*) FROM findings WHERE outcome = 'consistent') AS consistent,
      (SELECT count(*) FROM findings WHERE status = 'confirmed') AS confirmed,
      (SELECT CAST(format('{:.1f}', (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 60) AS DOUBLE) FROM events)
        AS last_activity_min,
      (SELECT epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) < 600 FROM events) AS active FROM interviews""",
)
def corpus_status(v):
    """Corpus size, finding counters and harvest activity at a reference time."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return corpus.corpus_status(v.interviews(), v.findings(), v.table("events").select("ts"), now)


@register(
    "transcript_text",
    "",
    """WITH RECURSIVE s AS (SELECT doc_id AS video_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
      w AS (SELECT video_id, CAST(1 AS BIGINT) AS i, 0 AS part_no, t AS part FROM s WHERE i = 1
        UNION ALL SELECT w.video_id, s.i, CASE WHEN length(w.part) + 1 + length(s.t) <= 14000 THEN part_no ELSE part_no + 1 END,
          CASE WHEN length(w.part) + 1 + length(s.t) <= 14000 THEN w.part || ' ' || s.t ELSE s.t END
        FROM w JOIN s ON s.video_id = w.video_id AND s.i = w.i + 1)
    SELECT video_id, CAST(part_no AS INTEGER) AS part_no, md5(arg_max(part, i)) AS part_md5 FROM w GROUP BY video_id, part_no""",
)
def transcript_text(v):
    """Whole transcript texts, cut into the parts one prompt carries."""
    parts = v.interviews().select(
        "video_id", F.posexplode(transcript_parts(F.col("segments"))).alias("part_no", "part")
    )
    return parts.select("video_id", "part_no", F.md5("part").alias("part_md5"))


@register(
    "query_union",
    "segments",
    """WITH a AS (SELECT video_id, min(pos) AS pos, 0 AS q FROM segments WHERE contains(text, 'heed') GROUP BY 1
      UNION ALL SELECT video_id, min(pos), 1 FROM segments WHERE contains(text, 'und ') GROUP BY 1
      UNION ALL SELECT video_id, min(pos), 2 FROM segments WHERE contains(text, 'the ') GROUP BY 1)
    SELECT video_id, arg_min(pos, q) AS pos, CAST(min(q) AS INTEGER) AS query_no FROM a GROUP BY video_id""",
)
def query_union(v):
    """Three result lists united by video; the earliest list wins."""
    s = v.segments()
    lists = [
        s.filter(F.col("text").contains(w)).groupBy("video_id").agg(F.min("pos").alias("pos"))
        for w in ("heed", "und ", "the ")
    ]
    return union_first(lists, "video_id")


@register(
    "duration_cap",
    "interviews",
    "SELECT video_id, duration_sec FROM interviews WHERE duration_sec <= 600",
)
def duration_cap(v):
    """Items no longer than the cap."""
    from factledger.sources.landed import within_duration

    return within_duration(v.interviews(), 600).select("video_id", "duration_sec")
