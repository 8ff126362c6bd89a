"""The registered queries of the training-data operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import centroid_clustering, conversation_trie, exact_dedup, line_cleaning, line_dedup, mixing, near_dedup, packing, repeated_spans, rule_ensemble, sharding, suffix_tree, url_cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules of the page query.
URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_rule_ensemble")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register(
    "op2_url_cascade",
    """
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages
    ), parts AS (
      SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut
    ), rules(rule_host, rule_path, verdict) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), fitting AS (
      SELECT page_id, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS place,
        host, path
      FROM (SELECT DISTINCT page_id, host, path FROM parts) p
      JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN fitting f
      ON f.place = 1 AND f.page_id = p.page_id AND f.host = p.host AND f.path = p.path
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_cascade.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


@register("op3_suffix_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(documents(spark, sf_dir))


@register(
    "op4_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
      FROM documents
    ), keyed AS (
      SELECT doc_id, line, place, translate(trim(line, E' \t\n\x0b\x0c\r'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines
    ), common AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
      SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped FROM keyed k LEFT JOIN common c USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select(
        "doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2("cleaned.text", 256).alias("kept_sha256")
    )


@register(
    "op5_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), shingles AS (
      SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), links AS (
      SELECT a.doc_id AS a, b.doc_id AS b
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n
      HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ), reach AS (
      SELECT doc_id AS node, doc_id AS component FROM documents
      UNION
      SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node
    ), least AS (
      SELECT node, min(component) AS component_id FROM reach GROUP BY node
    )
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.node = d.doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@register("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@register(
    "op7_line_cleaning",
    r"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
    placed AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM words
    ), windows AS (
      SELECT doc_id, place, {'a': word, 'b': lead(word) OVER w, 'c': lead(word, 2) OVER w} AS win, lead(word, 2) OVER w AS third
      FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place)
    ), again AS (
      SELECT doc_id, place FROM windows WHERE third IS NOT NULL
      QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
    ), covered AS (
      SELECT doc_id, count(DISTINCT spot) AS n_repeat_words
      FROM (SELECT doc_id, unnest([place, place + 1, place + 2]) AS spot FROM again) GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS place
      FROM docs
    ), counted AS (
      SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS repeats,
        len(regexp_extract_all(line, '[#*$%&<>]')) AS symbols, len(regexp_extract_all(line, '[|>•»]')) AS separators,
        len(regexp_extract_all(line, '[!?]{2}([\x20\x09-\x0D]|$)')) AS shouts,
        regexp_matches(line, '[.!?…:;"”’'')\]][\x20\x09-\x0D]*$') AS ends,
        regexp_matches(lower(line), 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use cookies|enable javascript|click here|sign up|log in|subscribe to|share this|skip to content|back to top|read more') AS phrase
      FROM lines
    ), judged AS (
      SELECT doc_id, count(*) FILTER (repeats) AS n_dup_lines,
        sum(n) FILTER (repeats OR 2 * symbols >= n OR (separators >= 3 AND 3 * separators >= n)
          OR (n < 4 AND NOT ends) OR 3 * shouts >= n OR (n <= 25 AND phrase)) AS lost
      FROM counted WHERE n > 0 GROUP BY doc_id
    ), figures AS (
      SELECT w.doc_id, len(w.words)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(j.n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(j.lost, 0) AS lost
      FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN judged j USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept
    FROM figures
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_cleaning.clean_lines(documents(spark, sf_dir))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return done.select("doc_id", *[f"cleaning.{f}" for f in figures])


@register(
    "op8_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, ''))), 1, 15) AS hash
      FROM documents
    ), totals AS (
      SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM sized GROUP BY source
    ), levels AS (
      SELECT *, 2 * source_size AS cap,
        (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2 * source_size) OVER earlier, 0)::DOUBLE)
          / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level,
        row_number() OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST) AS place
      FROM totals
      WINDOW earlier AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), final AS (
      SELECT level FROM levels WHERE weight * level <= cap ORDER BY place LIMIT 1
    ), targets AS (
      SELECT t.source, t.source_size, least(t.weight * f.level, t.cap::DOUBLE) AS target FROM levels t, final f
    ), plan AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
    ), cells AS (
      SELECT source, hash, sum(size)::BIGINT AS words,
        sum(sum(size)) OVER (PARTITION BY source ORDER BY hash)::BIGINT AS upto
      FROM sized GROUP BY source, hash
    ), extra AS (
      SELECT c.source, c.hash,
        CASE WHEN c.upto < p.target - p.copies * p.source_size THEN 1
             WHEN c.upto - c.words < p.target - p.copies * p.source_size
              AND 2 * (p.target - p.copies * p.source_size - (c.upto - c.words)) >= c.words THEN 1
             ELSE 0 END AS more
      FROM cells c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source
    )
    SELECT s.doc_id, s.size, p.source_size, p.target, (s.size * (p.copies + e.more))::BIGINT AS taken
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
      JOIN extra e ON s.source IS NOT DISTINCT FROM e.source AND s.hash = e.hash
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf_dir))


@register(
    "op9_sharding",
    r"""
    WITH crc AS (
      SELECT list_transform(range(256), lambda n: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c
        WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS tab
    ), bytes AS (
      SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
      FROM documents
    ), sums AS (
      SELECT doc_id, key, size::BIGINT AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]),
        4294967295), 4294967295)::BIGINT AS text_crc32,
        list_transform(range(17), lambda i: md5(key || '#' || i)[1:13]) AS draws
      FROM bytes, crc
    ), placed AS (
      SELECT *, list_position(draws[1:16], list_max(draws[1:16])) - 1 AS shard, list_position(draws, list_max(draws)) - 1 AS grown
      FROM sums
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY md5(key || '#' || text_crc32 || '#' || size)[1:3],
        doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
      grown::INTEGER AS grown_shard
    FROM placed
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@register(
    "op10_exact_dedup",
    r"""
    WITH bodies AS (
      SELECT doc_id, length(coalesce(text, '')) AS size,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
      FROM documents
    ), grouped AS (
      SELECT *, first_value(doc_id) OVER best AS keep_id, first_value(size) OVER best AS keep_size,
        count(*) OVER (PARTITION BY body) AS group_size
      FROM bodies
      WINDOW best AS (PARTITION BY body ORDER BY size DESC, doc_id NULLS LAST)
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND size = keep_size AS kept,
      sha256(body) AS text_sha256
    FROM grouped
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


CENTROIDS, CENTROID_ROUNDS, CENTROID_DIM, CENTROID_SCALE, CENTROID_SEED = 40, 5, 64, 256, "2:"


def _rounds_sql(rounds: int) -> str:
    """Assignments and moved centroids, round by round, one component a row."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
    near_{r} AS MATERIALIZED (
      SELECT row_no, arg_min(c, (square, c)) AS cluster, min(square) AS square
      FROM (
        SELECT p.row_no, m.c, sum((p.x - m.x) * (p.x - m.x)) AS square
        FROM places p JOIN centre_{r} m ON p.i = m.i GROUP BY p.row_no, m.c
      ) GROUP BY row_no
    )""")
        if r < rounds:
            parts.append(f"""
    centre_{r + 1} AS MATERIALIZED (
      SELECT o.c, o.i, coalesce(s.x, o.x) AS x
      FROM centre_{r} o LEFT JOIN (
        SELECT n.cluster AS c, p.i, (sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
        FROM near_{r} n JOIN places p ON p.row_no = n.row_no GROUP BY n.cluster, p.i
      ) s ON s.c = o.c AND s.i = o.i
    )""")
    return ",".join(parts)


@register(
    "op11_centroid_clustering",
    f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, row_number() OVER (ORDER BY hash_key, v) AS row_no, v
      FROM (
        SELECT vec_id, sha256('{CENTROID_SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS hash_key,
          list_transform(embedding, lambda x: CAST(floor({CENTROID_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {CENTROID_DIM}
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {CENTROID_DIM}
      )
    ), places AS MATERIALIZED (
      SELECT row_no, unnest(range({CENTROID_DIM})) AS i, unnest(v) AS x FROM kept
    ), centre_0 AS MATERIALIZED (
      SELECT row_no - 1 AS c, i, x FROM places WHERE row_no <= {CENTROIDS}
    ),{_rounds_sql(CENTROID_ROUNDS)},
    named AS (
      SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
      FROM centre_{CENTROID_ROUNDS} GROUP BY c
    )
    SELECT k.vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(n.square AS BIGINT) AS distance,
      CAST(sum(n.square) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(n.square) OVER () AS BIGINT) AS inertia, m.centroid_sha256
    FROM kept k JOIN near_{CENTROID_ROUNDS} n ON n.row_no = k.row_no JOIN named m ON m.c = n.cluster
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroid_clustering.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), CENTROID_DIM, CENTROID_SCALE)
    found = centroid_clustering.cluster_vectors(rows, CENTROID_DIM, CENTROIDS, CENTROID_ROUNDS, CENTROID_SEED)
    figures = [
        (c, inertia, sum(found.inertia), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, (centroid, inertia) in enumerate(zip(found.centroids.tolist(), found.inertia, strict=True))
    ]
    named = spark.createDataFrame(figures, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row per centroid: k of them
    return found.assigned.join(F.broadcast(named), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@register(
    "op12_conversation_trie",
    r"""
    WITH crc AS (
      SELECT list_transform(range(256), lambda n: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c
        WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS tab
    ), turns AS (
      SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS body,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
          sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
      FROM conversations WHERE conv_id IS NOT NULL
    ), whole AS (
      SELECT conv_id, list({'body': body, 'words': words} ORDER BY place) AS own FROM turns GROUP BY conv_id
    ), drawn AS (
      SELECT conv_id, own, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 4 END AS h
      FROM whole, crc
    ), rebuilt AS MATERIALIZED (
      SELECT d.conv_id, coalesce(f.own[1:d.h], []) || d.own[d.h + 1:] AS turns
      FROM drawn d LEFT JOIN whole f ON f.conv_id = d.conv_id - d.conv_id % 20
    ), steps AS MATERIALIZED (
      SELECT conv_id, len(turns) AS size, d AS depth, coalesce(turns[d].words, 0) AS words,
        array_to_string(list_transform(turns[1:d], lambda t: t.body), ' ') AS name,
        CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda t: t.body), ' ') END AS above
      FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
    ), nodes AS MATERIALIZED (
      SELECT name, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
      FROM steps GROUP BY name, depth
    ), shaped AS MATERIALIZED (
      SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.name = n.above AND p.depth = n.depth - 1
      LEFT JOIN (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM nodes GROUP BY above, depth) c
        ON c.above = n.name AND c.depth = n.depth
    ), sums AS (
      SELECT u.name, u.depth, sum(v.saved) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
      FROM shaped v JOIN steps w ON w.conv_id = v.conv_id AND w.depth <= v.depth
      JOIN shaped u ON u.name = w.name AND u.depth = w.depth GROUP BY u.name, u.depth
    )
    SELECT s.conv_id, s.depth, s.parent_conv_id, s.n_convs, s.n_children::BIGINT AS n_children, t.n_leaves,
      t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
    FROM shaped s JOIN sums t ON t.name = s.name AND t.depth = s.depth
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@register(
    "op13_repeated_spans",
    r"""
    WITH docs AS MATERIALIZED (
      SELECT doc_id, row_number() OVER () AS row_no, hex(encode(coalesce(text, ''))) AS h,
        octet_length(encode(coalesce(text, ''))) AS n
      FROM documents
    ), starts AS (
      SELECT row_no, s, md5_number(substr(h, CAST(2 * s + 1 AS BIGINT), 400)) AS w
      FROM (SELECT row_no, h, unnest(range(n - 199)) AS s FROM docs WHERE n >= 200)
    ), again AS MATERIALIZED (
      SELECT row_no, s FROM (SELECT row_no, s, count(*) OVER (PARTITION BY w) AS times FROM starts) WHERE times > 1
    ), runs AS (
      SELECT row_no, run, min(s) AS lo, max(s) + 200 AS hi
      FROM (
        SELECT row_no, s, sum(opens) OVER (PARTITION BY row_no ORDER BY s) AS run
        FROM (SELECT row_no, s, CASE WHEN s - lag(s) OVER (PARTITION BY row_no ORDER BY s) <= 200 THEN 0 ELSE 1 END AS opens FROM again)
      ) GROUP BY row_no, run
    ), cuts AS (
      SELECT row_no, list({'lo': lo, 'hi': hi} ORDER BY lo) AS spans, sum(hi - lo) AS gone FROM runs GROUP BY row_no
    )
    SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(c.gone, 0)::BIGINT AS n_removed, coalesce(len(c.spans), 0)::BIGINT AS n_spans,
      sha256(unhex(CASE WHEN c.spans IS NULL THEN d.h ELSE
        substr(d.h, 1, 2 * c.spans[1].lo) || array_to_string(list_transform(range(1, len(c.spans) + 1),
          lambda i: substr(d.h, 2 * c.spans[i].hi + 1, 2 * (coalesce(c.spans[i + 1].lo, d.n) - c.spans[i].hi))), '') END)) AS kept_sha256
    FROM docs d LEFT JOIN cuts c ON c.row_no = d.row_no
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(documents(spark, sf_dir))
