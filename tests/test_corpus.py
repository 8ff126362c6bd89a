"""Topic map, ranking claims, conflicting numbers and search, with Hebrew text."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from factledger.plans import conflicts, corpus

SEGMENTS = "person_id bigint, speaker_name string, video_id string, start double, text string"
POSTS = "person_id bigint, handle string, url string, text string"


def test_topic_map(spark, rows):
    data = [
        (1, "א", "v1", 0.0, "האבטלה ויוקר המחיה"),
        (1, "א", "v1", 1.0, "שיעור האבטלה, אבטלה ומובטלים"),  # counted once for the topic
        (1, "א", "v2", 2.0, "יוקר המחיה"),
        (2, "ב", "v3", 0.0, "אבטלה"),  # below the threshold
        (None, None, "v4", 0.0, "אבטלה"),
        (3, "ג", "v5", 0.0, None),
    ]
    segments = spark.createDataFrame(data, SEGMENTS)
    edges = corpus.topic_edges(segments)
    assert rows(edges) == [(1, "inflation", 2), (1, "unemployment", 2)]
    roster = spark.createDataFrame([(2, "אחר", "p")], "person_id bigint, name string, party string")
    speakers = segments.select("person_id", "speaker_name").distinct()
    assert rows(corpus.topic_people(edges, roster, speakers), "person_id", "name", "party", "weight")[0] == (1, "א", "", 2)
    latest = spark.createDataFrame(
        [("inflation", "מדד", "%", 2024, 3.1, "למס", "https://x")],
        "key string, label string, unit string, year int, value double, source_org string, source_url string",
    )
    summary = {r.topic: r for r in corpus.topic_summary(edges, latest).collect()}
    assert len(summary) == 19
    assert (summary["inflation"].people, summary["inflation"].latest_value, summary["inflation"].bar) == (1, 3.1, 100)
    assert (summary["crime"].people, summary["crime"].latest_year, summary["crime"].keyword) == (0, None, "פשיעה")
    assert corpus.topic_totals(edges).collect()[0] == (19, 1, 2)


def test_ranking_claims(spark, rows):
    segments = spark.createDataFrame(
        [
            (1, "א", "v1", 2.5, "\tהאבטלה הכי גבוהה בארץ "),
            (1, "א", "v1", 3.5, "האבטלה גבוהה"),
            (1, "א", "v1", 4.0, "מקום ראשון בשירה"),
        ],
        SEGMENTS,
    )
    posts = spark.createDataFrame(
        [(2, "h", "u1", " RT @x האבטלה הנמוכה ביותר"), (2, "h", "u2", "הפשיעה במקום ראשון"), (2, "h", "u3", None)], POSTS
    )
    got = rows(corpus.ranking_claims(segments, posts), "source", "video_id", "start", "url", "quote")
    assert got == [
        ("interview", "v1", 2, None, "האבטלה הכי גבוהה בארץ"),
        ("tweet", None, None, "u2", "הפשיעה במקום ראשון"),
    ]
    assert rows(corpus.count_by(corpus.ranking_claims(segments, posts), "source")) == [("interview", 1), ("tweet", 1)]


def brute_pairs(claims, gap):
    out = []
    for (i, a), (j, b) in itertools.combinations(list(enumerate(claims)), 2):
        if a[0] == b[0] and a[1] == b[1] and a[3] != b[3] and abs(a[2] - b[2]) >= gap:
            out.append((i, j))
    return out


CLAIMS = "person_id bigint, metric string, value double, video_id string, start bigint"


def test_conflicts_of_any_decimals(spark):
    cases = {"a": [10.04, 13.04, 13.02, 12.96], "b": [1.05, 4.04, 4.06], "c": [0.1 + 3.0, 0.1, 0.3, 3.3, 0.1 + 0.2, 1e9, 1e9 + 3]}
    data = [(1, m, float(x), f"v{i}", i) for m, values in cases.items() for i, x in enumerate(values)]
    claims = spark.createDataFrame(data, "person_id long, metric string, value double, video_id string, start long")
    got = {(r.metric, r.start): r.conflicts for r in conflicts.conflict_queue(claims).collect()}
    for m, values in cases.items():
        for i, x in enumerate(values):
            assert got.get((m, i), 0) == sum(abs(x - y) >= 3.0 for k, y in enumerate(values) if k != i)


def test_conflicts_match_brute_force(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        # one person holds most claims, one video holds most of theirs, null videos occur
        person = 1 if rng.random() < 0.6 else rng.randint(2, 4)
        video = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        data.append((person, rng.choice(["m", "n"]), rng.randint(0, 120) / 10, video, i))
    claims = spark.createDataFrame(data, CLAIMS)
    pairs = brute_pairs(data, 3.0)
    count = [0] * len(data)
    partners = {}
    for i, j in pairs:
        for x, y in ((i, j), (j, i)):
            count[x] += 1
            partners.setdefault(x, []).append(data[y][2])
    got = {r.start: r for r in conflicts.conflict_queue(claims).collect()}
    assert set(got) == {i for i, n in enumerate(count) if n}
    for i, row in got.items():
        assert row.conflicts == count[i]
        low, high = min(partners[i]), max(partners[i])
        assert row.lowest_partner == (low if data[i][2] - low >= 3.0 else None)
        assert row.highest_partner == (high if high - data[i][2] >= 3.0 else None)
    totals = {r.metric: r.pairs for r in conflicts.conflict_totals(claims).collect()}
    for metric in ("m", "n"):
        assert totals[metric] == sum(1 for i, _ in pairs if data[i][1] == metric)
    assert conflicts.conflicting_people(claims).collect()[0][0] == len({data[i][0] for i, _ in pairs})
    opened = conflicts.partners_of(claims.filter("start < 20"), claims)
    assert opened.count() == sum(count[:20])


def test_exact_gap_is_judged_on_the_doubles(spark):
    # 5.1 - 2.1 is just below 3 as a double, 3.3 - 0.3 is not
    data = [(1, "m", 2.1, "a", 0), (1, "m", 5.1, "b", 1), (2, "m", 0.3, "a", 2), (2, "m", 3.3, "b", 3)]
    got = sorted(r.start for r in conflicts.conflict_queue(spark.createDataFrame(data, CLAIMS)).collect())
    assert got == [i for i in range(4) if any(i in p for p in brute_pairs(data, 3.0))]


def test_percent_claims(spark, rows):
    segments = spark.createDataFrame(
        [
            (1, "א", "v1", 10.5, " האבטלה ירדה ל-12.5 אחוז וגם 40% "),
            (1, "א", "v1", 11.0, "האבטלה ירדה"),
            (1, "א", "v2", 12.0, "100% בטוח"),
            (1, "א", "v3", 13.0, "אחוז גיוס גבוה"),
            (None, None, "v4", 1.0, "אבטלה 5%"),
        ],
        SEGMENTS,
    )
    got = rows(conflicts.percent_claims(segments), "metric", "value", "video_id", "start")
    assert got == [("אבטלה", 12.5, "v1", 10)]


INTERVIEWS = (
    "person_id bigint, name string, video_id string, url string, title string, published_at string, "
    "duration_sec double, segments array<struct<start:double,text:string>>"
)


def interviews(spark):
    return spark.createDataFrame(
        [
            (10, "י", "a", "http://v/a", "t1", None, 90.0, [(0.0, " שלום עולם "), (1.25, "  "), (61.06, "שלום שוב")]),
            (10, "י", "b", "http://v?v=b", "t2", "2024-05-01", 0.0, [(5.0, "שלום")]),
            (2, "ב", "c", None, "t3", "2024-01-01", None, [(None, "אין")]),
            (3, "ג", "d", "u", "t4", "2024-01-01", 30.0, []),
        ],
        INTERVIEWS,
    )


def test_search(spark, rows):
    segments = corpus.search_segments(interviews(spark))
    assert segments.count() == 4
    hits = corpus.search(segments, " שלום ").collect()
    assert [(h.video_id, h.pos, h.start, h.clock) for h in hits] == [
        ("b", 0, 5.0, "00:05"),
        ("a", 0, 0.0, "00:00"),
        ("a", 2, 61.1, "01:01"),
    ]
    assert hits[0].link == "http://v?v=b&t=5" and hits[2].link == "http://v/a?t=61"
    assert corpus.search(segments, "ש").count() == 0
    assert corpus.search(segments, "אין").collect()[0].link == "#"
    assert rows(corpus.person_hits(segments, "שלום"), "video_id", "hits") == [("a", 2), ("b", 1)]


def test_search_index_numbers(spark, rows):
    heads, segments = corpus.search_index(interviews(spark))
    # persons by id as text, newest first, missing dates last
    assert rows(heads, "interview_no", "video_id") == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]
    assert rows(segments, "interview_no", "start", "text") == [
        (0, 5.0, "שלום"),
        (1, 0.0, "שלום עולם"),
        (1, 61.1, "שלום שוב"),
        (2, 0.0, "אין"),
    ]


def test_person_index_keeps_everyone(spark):
    roster = spark.createDataFrame([(10, "י", "p"), (4, "ד", None)], "person_id bigint, name string, party string")
    index = corpus.person_index(roster, interviews(spark))
    assert [tuple(r) for r in index.collect()] == [(10, "י", "p", 2, 4), (4, "ד", "", 0, 0)]
    assert tuple(corpus.index_totals(index).collect()[0]) == (2, 1, 2, 4)
    assert [r.person_id for r in corpus.people_with_interviews(roster, interviews(spark)).collect()] == [10]


def test_interview_cards(spark):
    got = [(r.video_id, r.minutes, r.segment_count) for r in corpus.interview_cards(interviews(spark)).collect()]
    assert got == [("c", None, 1), ("d", 1, 0), ("b", None, 1), ("a", 2, 3)]


def test_status(spark):
    findings = spark.createDataFrame([("contradicted", "confirmed"), ("consistent", "x")], "outcome string, status string")
    activity = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    now = F.lit("2024-01-01 00:09:59").cast("timestamp")
    r = corpus.corpus_status(interviews(spark), findings, activity, now).collect()[0]
    assert (r.transcripts, r.people_with_interviews, r.total, r.contradicted, r.confirmed) == (4, 3, 2, 1, 1)
    assert r.active and r.last_activity_min == 10.0


def conflicts_by_hand(data, gap):
    """start -> (conflicts, lowest, highest) of (person, metric, value, video, start) rows, by all pairs."""
    out = {}
    for p, m, v, video, start in data:
        if v is None or math.isnan(v):
            continue
        others = [w for q, n, w, other, _ in data if (q, n) == (p, m) and other != video and w is not None and not math.isnan(w)]
        far = [w for w in others if not math.isnan(v - w) and abs(v - w) >= gap]
        if far:
            below, above = [w for w in far if w < v], [w for w in far if w > v]
            out[start] = (len(far), min(below, default=None), max(above, default=None))
    return out


def number_rows(spark, data):
    return spark.createDataFrame(data, "person_id long, metric string, value double, video_id string, start long")


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_between_numbers_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    odd = [float("nan"), float("inf"), float("-inf"), 1e18, -1e18, 1e308, -1e308, 5e-324, 0.0, -0.0, None, 3.0, 3.0000000000000004]
    near = [0.1 * i for i in range(80)] + [2.9999999999999996, 1e-17, 1e-9, 3 + 1e-9, 1e18 + 128, 6.0, -3.0]
    data = [(rng.randrange(2), "m", rng.choice(odd + near * 2), f"v{rng.randrange(6)}", i) for i in range(260)]
    found = conflicts.conflict_queue(number_rows(spark, data), 3.0).collect()
    got = {r.start: (r.conflicts, r.lowest_partner, r.highest_partner) for r in found}
    assert got == conflicts_by_hand(data, 3.0)


def test_another_persons_nan_or_outlier_changes_nothing(spark):
    own = [(1, "m", 10.0, "a", 1), (1, "m", 20.0, "b", 2), (1, "m", 11.0, "c", 3)]
    for other in (float("nan"), 1e18, float("inf")):
        claims = number_rows(spark, own + [(2, "x", other, "d", 4)])
        assert {r.start: r.conflicts for r in conflicts.conflict_queue(claims).collect()} == {1: 1, 2: 2, 3: 1}
        assert [r.pairs for r in conflicts.conflict_totals(claims).collect()] == [2]
        assert conflicts.conflicting_people(claims).first()[0] == 1


def test_a_hot_person_is_counted_without_pairs(spark):
    n = 20000
    data = spark.range(n).selectExpr("1 AS person_id", "'m' AS metric", "CAST(id % 100 AS DOUBLE) AS value", "CAST(id % 7 AS STRING) AS video_id", "id AS start")
    total = conflicts.conflict_totals(data.union(data.limit(1).selectExpr("1", "'m'", "1e18D", "'x'", "-1L"))).first().pairs
    kinds = {}
    for i in range(n):
        kinds[i % 100, i % 7] = kinds.get((i % 100, i % 7), 0) + 1
    want = sum(a * b for (v, x), a in kinds.items() for (w, y), b in kinds.items() if x != y and abs(v - w) >= 3) // 2
    assert total == want + n


def test_the_gap_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        conflicts.conflict_totals(number_rows(spark, []), 0.0)


def test_conflict_totals_sum_the_cells_without_a_join_back_to_claims(spark):
    import random

    from factledger.plans import conflicts

    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice("ab"), rng.randrange(4), rng.choice([0.0, 2.5, 5.5, 5.6, 9.0, float("inf")])) for _ in range(300)]
    claims = spark.createDataFrame([*rows, (1, "a", 0, None), (1, "a", 1, float("nan"))], "person_id int, metric string, video_id int, value double")
    ends = {(r.person_id, r.metric): r.ends for r in conflicts.conflict_ends(claims).collect()}
    want: dict = {}
    for person, metric, video, x in rows:
        n = sum((q, label) == (person, metric) and w != video and abs(x - y) >= 3.0 for q, label, w, y in rows)
        if person is not None and n:
            want[person, metric] = want.get((person, metric), 0) + n
    assert ends == want
    assert conflicts.conflicting_people(claims).first()[0] == len({p for p, _ in want})
