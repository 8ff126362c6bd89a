"""Findings store, review, leaderboards, fact-check and evidence."""

import json

import pytest
from pyspark.sql import functions as F

from factledger.constants import CHECKED_TOPICS
from factledger.plans import evidence, factcheck, review

F_SCHEMA = "id string, pos int, person_id bigint, speaker_name string, video_id string, url string, quote string, outcome string, status string"


def finding(pos, person=1, video="v", quote="q", status="confirmed", outcome="contradicted", id=None, name="n"):
    return (id, pos, person, name, video, None, quote, outcome, status)


def test_merge_findings(spark, rows):
    stored = spark.createDataFrame([finding(0, id="F-0007"), finding(1, video=None, quote="x", id="F-12345")], F_SCHEMA)
    new = spark.createDataFrame(
        [
            finding(10),  # stored already
            finding(11, video=None, quote="x"),  # stored, null video
            finding(12, quote="new"),
            finding(13, quote="new"),  # duplicate of the one before
            finding(14, quote="gone"),  # retracted
            finding(15, quote="weak", status="rejected"),
            finding(16, video=None, quote="y"),
        ],
        F_SCHEMA,
    )
    retracted = spark.createDataFrame([(1, "v", "gone")], "person_id bigint, video_id string, quote string")
    out = review.merge_findings(stored, new, retracted)
    assert rows(out, "id", "pos", "url") == [
        ("F-0007", 0, None),
        ("F-12345", 1, None),
        ("F-12346", 12, "https://www.youtube.com/watch?v=v"),
        ("F-12347", 16, "https://www.youtube.com/watch?v=None"),
    ]
    again = review.merge_findings(out, new, retracted)
    assert again.count() == 4


def test_ids_start_at_one(spark, rows):
    out = review.assign_ids(spark.createDataFrame([finding(5), finding(3)], F_SCHEMA))
    assert rows(out, "id", "pos") == [("F-0001", 3), ("F-0002", 5)]


def test_decisions(spark, rows):
    findings = spark.createDataFrame(
        [finding(i, id=f"F-000{i}", quote=f"q{i}") for i in range(4)] + [finding(9, quote="no id")], F_SCHEMA
    )
    decisions = spark.createDataFrame(
        [(0, "F-0000", "confirm", ""), (1, "F-0000", "reject", ""), (2, "F-0001", "confirm", "ok"), (3, "F-0002", "reject", ""),
         (4, "F-0002", "confirm", ""), (5, None, "reject", "")],
        "pos int, id string, decision string, note string",
    )
    kept, rejected = review.apply_decisions(findings, decisions)
    assert rows(kept, "pos", "affirmed", "review_note") == [
        (1, True, "ok"),
        (2, True, None),
        (3, None, None),
        (9, None, None),
    ]
    blocklist = review.extend_blocklist(rejected, rejected)
    assert rows(blocklist) == [(1, "v", "q0")]


def test_findings_leaderboard(spark):
    findings = spark.createDataFrame(
        [
            finding(0, person=1, name="old"),
            finding(1, person=1, name="last"),
            finding(2, person=1, status="candidate"),
            finding(3, person=2, outcome="consistent"),
            finding(4, person=3, status="reviewed"),
            finding(5, person=30, status="published"),
            finding(6, person=None),
        ],
        F_SCHEMA,
    )
    roster = spark.createDataFrame(
        [(0, 3, "x", "p"), (1, 3, "שם", None)], "pos int, person_id bigint, name string, party string"
    )
    got = [tuple(r) for r in review.findings_leaderboard(findings, roster).collect()]
    assert got == [("person-1", "last", "", 2), ("person-3", "שם", None, 1), ("person-30", "n", "", 1)]
    bars = [r.bar for r in review.with_bars(review.findings_leaderboard(findings, roster)).orderBy("slug").collect()]
    assert bars == [100, 50, 50]
    candidates = findings.withColumn("status", F.lit("candidate"))
    assert review.findings_leaderboard(candidates, roster).count() == 0


def test_profile_and_order(spark):
    df = spark.createDataFrame(
        [(0, 7, "consistent", None), (1, 7, "contradicted", None), (2, 7, None, "self_contradiction"), (3, 8, "contradicted", None)],
        "pos int, person_id bigint, outcome string, type string",
    )
    assert [r.pos for r in review.profile_findings(df, "7").orderBy("pos").collect()] == [1, 2]
    assert [r.pos for r in review.contradictions_first(df).collect()] == [1, 3, 0, 2]


STATS = (
    "pos int, metric string, dimension_value string, value double, unit string, period string, source_org string, "
    "source_url string, confirm_quote string"
)


def stats(spark):
    return spark.createDataFrame(
        [
            (0, "cpi_annual_inflation_pct", "2022", 5.3, "%", "2022", "למס", "https://g", "2022 = 5.3%"),
            (1, "Unemployment_rate", "2022", 3.7, "%", "2022", "למס", "https://g", ""),
            (2, "home_index", None, 100.0, None, None, None, None, None),
            (3, "consumer_cost", "x", 1.0, "", "", "", "u", ""),
        ],
        STATS,
    )


def test_topic_lists(spark, rows):
    out = factcheck.topic_statistics(stats(spark))
    assert rows(out, "topic_key", "stat_index", "pos") == sorted(
        [("אבטל", 0, 1), ("דיור", 0, 2), ("יוקר", 0, 0), ("יוקר", 1, 3), ("תעסוק", 0, 1)]
    )
    keys = spark.createDataFrame([("יוקר המחיה ואבטלה",), ("שלום",), (None,)], "t string")
    assert [r[0] for r in keys.select(factcheck.topic_key(F.col("t"))).collect()] == ["יוקר", None, None]
    assert list(CHECKED_TOPICS)[0] == "גיוס"


def test_stat_lists_keep_every_line(spark):
    lists = factcheck.stat_lists(stats(spark), max_lines=1).filter("topic_key = 'יוקר'").orderBy("list_no").collect()
    assert [r.stat_lines for r in lists] == [
        "0: cpi_annual_inflation_pct | 2022 = 5.3 % (2022) — מקור: למס",
        "1: consumer_cost | x = 1.0  () — מקור: ",
    ]


def test_gate(spark, rows):
    claims = spark.createDataFrame(
        [
            (0, "יוקר המחיה", "contradicted", 0),
            (1, "יוקר המחיה", "consistent", 1),
            (2, "יוקר המחיה", "contradicted", 2),  # out of range
            (3, "יוקר המחיה", "contradicted", None),
            (4, "יוקר המחיה", "contradicted", -1),
            (5, "יוקר המחיה", "unverifiable", 0),
            (6, "שלום", "contradicted", 0),
        ],
        "n int, topic string, outcome string, stat_index bigint",
    )
    out = factcheck.gate_findings(claims, stats(spark))
    assert rows(out, "n", "stat.source_url", "status") == [(0, "https://g", "candidate"), (1, "u", "candidate")]
    assert factcheck.gate_findings(claims, stats(spark).limit(0)).count() == 0


TRANSCRIPTS = "person_id bigint, mk_name string, video_id string, url string, title string, segments array<struct<start:double,text:string>>"


def fact_check(spark, outcome):
    transcripts = spark.createDataFrame(
        [
            (42, "ח״כ", "vid", "u", "t", [(0.0, "האינפלציה אפס אחוז")]),
            (43, "ב", "bad", "u", "t", [(0.0, "BROKEN")]),
        ],
        TRANSCRIPTS,
    )

    def gen(prompt):
        if prompt.startswith("ADJ"):
            return 'reason: {"outcome": "%s", "stat_index": 0, "confidence": 0.9, "reason": "r"}' % outcome
        if "BROKEN" in prompt:
            raise RuntimeError("quota")
        claim = {"quote": "אפס", "topic": "יוקר המחיה", "claim": "0%", "approx_seconds": 3}
        return "```json\n" + json.dumps({"claims": [claim]}, ensure_ascii=False) + "\n```"

    return factcheck.fact_check(
        transcripts, stats(spark), gen, "EXTRACT {topics} FROM {transcript}", "ADJ {claim} {quote}\n{stats}", ["יוקר"]
    )


def test_fact_check(spark):
    findings, failed = fact_check(spark, "contradicted")
    out = findings.collect()
    assert len(out) == 1
    assert (out[0].person_id, out[0].video_id, out[0].quote, out[0].status) == (42, "vid", "אפס", "candidate")
    assert out[0].stat.metric == "cpi_annual_inflation_pct" and out[0].stat.value == 5.3
    assert [r.video_id for r in failed.collect()] == ["bad"]
    assert fact_check(spark, "unverifiable")[0].count() == 0


@pytest.mark.parametrize(
    "answer,expected",
    [
        ('{"k": 1}', 1),
        ('```json\n{"k": 2}\n```', 2),
        ('```\n{"k": 3}\n``` tail', 3),
        ('well, {"k": 4} I think', 4),
        ("no json here", None),
        ("", None),
        (None, None),
        ("{broken", None),
    ],
)
def test_json_recovery(spark, answer, expected):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(factcheck.parse_json(F.col("a"), "struct<k:int>")["k"]).collect()[0][0] == expected


def test_parse_segments(spark):
    text = '```json\n[{"start": 0, "end": "1.5", "text": " a "}, {"start": "x", "end": 1, "text": "b"}, {"end": 1}]\n```'
    df = spark.createDataFrame([(text,), ('[{"start": 1, "end": 2, "text": "c"}]',)], "a string")
    got = [[tuple(s) for s in r[0]] for r in df.select(factcheck.parse_segments(F.col("a"))).collect()]
    assert got == [[(0.0, 1.5, "a")], [(1.0, 2.0, "c")]]


STATEMENTS = "statement_id bigint, person_id bigint, claim string, source_url string"


def test_record_candidates(spark, rows):
    votes = spark.createDataFrame(
        [(1, 5, 50, "for", "v5"), (1, 6, 60, None, "v6"), (1, 7, 70, "against", ""), (2, 8, 50, "for", "v8")],
        "person_id bigint, vote_id bigint, event_id bigint, stance string, source_url string",
    )
    events = spark.createDataFrame([(50, "חוק")], "event_id bigint, title string")
    actions = spark.createDataFrame(
        [(1, 3, "policy", None, "a3"), (1, 1, None, "title", "a1")],
        "person_id bigint, action_id bigint, action_type string, title string, source_url string",
    )
    ev = evidence.gather_evidence(votes, events, actions)
    statements = spark.createDataFrame([(100, 1, " " + "x" * 201, "s1"), (101, 9, "y", "s2")], STATEMENTS)
    first = evidence.record_candidates(statements, ev, 3)
    assert rows(first, "candidate_no", "evidence_kind", "evidence_id", "n_candidates") == [
        (1, "vote", 5, 4),
        (2, "vote", 6, 4),
        (3, "action", 1, 4),
    ]
    texts = [r.rationale for r in first.orderBy("candidate_no").collect()]
    assert "record (vote (for) on 'חוק')" in texts[0] and "record (vote (na))" in texts[1] and "(title)" in texts[2]
    assert 'claim: "' + "x" * 200 + '...".' in texts[0]
    rest = evidence.record_candidates(statements, ev, 3, after=("action", 1))
    assert rows(rest, "evidence_kind", "evidence_id") == [("action", 3)]
    unsourced = evidence.record_candidates(statements, ev, 10, require_source=False)
    assert unsourced.count() == 5
    assert evidence.contract_breaches(first).count() == 0
    assert evidence.contract_breaches(first.withColumn("human_verdict", F.lit("lie"))).count() == 3


def test_nearest_evidence_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    items, queries = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    items[7] = 0.0
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "evidence_id bigint, embedding array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "claim_id bigint, embedding array<double>")
    got = {(r.claim_id, r.place): r.evidence_id for r in evidence.nearest_evidence(c, e.repartition(6), 4).collect()}
    norms = np.linalg.norm(items, axis=1)
    norms[7] = 1.0
    sims = np.round((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (items / norms[:, None]).T, 6)
    for q in range(5):
        best = sorted(range(300), key=lambda i: (-sims[q, i], i))[:4]
        assert [got[(q, p)] for p in range(1, 5)] == best


def test_embedding_provider(spark):
    def provider(texts):
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), (None,)], "text string")
    out = evidence.embed_with(provider)(df).collect()
    assert [list(r.embedding) for r in out] == [[3.0, 1.0], [0.0, 1.0]]


def test_only_json_integers_are_indexes(spark):
    answers = ['{"outcome": "consistent", "stat_index": %s}' % x for x in ("1", '"1"', "1.5", "null", "true", "[1]", "-1")]
    df = spark.createDataFrame(list(enumerate([*answers, "no json", "[1]"])), "i int, answer string")
    got = {r.i: r.stat_index for r in factcheck.parse_verdicts(df).collect()}
    assert got == {0: 1, 1: None, 2: None, 3: None, 4: None, 5: None, 6: -1, 7: None, 8: None}


def test_one_verdict_per_claim(spark):
    rows = [(1, "unverifiable", 0.99, 0), (1, "consistent", 0.6, 1), (1, "contradicted", 0.9, 2), (1, "consistent", 0.9, 3), (2, "unverifiable", None, 0)]
    df = spark.createDataFrame(rows, "claim int, outcome string, confidence double, list_no int")
    got = sorted(tuple(r) for r in factcheck.one_verdict(df, ["claim"]).collect())
    assert got == [(1, "contradicted", 0.9), (2, "unverifiable", None)]


def test_nearest_evidence_in_blocks(spark):
    rng = __import__("numpy").random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(60)]
    e = spark.createDataFrame(vectors, "evidence_id bigint, embedding array<float>").repartition(3)
    c = e.withColumnRenamed("evidence_id", "claim_id")
    whole, blocks = (sorted(map(tuple, evidence.nearest_evidence(c, e, 3, block=b).collect())) for b in (4096, 7))
    assert whole == blocks and len(whole) == 180
    assert evidence.nearest_evidence(c.limit(0), e, 3).count() == 0


def test_answers_are_parsed_once(spark):
    answers = spark.createDataFrame([(1, 'so: {"outcome": "consistent", "stat_index": 3, "reason": "r"} end')], "i int, answer string")
    verdicts = factcheck.parse_verdicts(answers).filter("outcome <> 'unverifiable' AND stat_index > 0 AND reason <> ''")
    assert [(r.outcome, r.stat_index, r.reason) for r in verdicts.collect()] == [("consistent", 3, "r")]
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json") + plan.lower().count("jsontostructs") == 1
    assert plan.lower().count("parse_json") <= 2
