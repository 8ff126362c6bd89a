"""Claims against peer sets, the gate, and the verdict leaderboard."""

import pytest

from factledger.plans import adjudication as adj

STAT = (
    "stat_id bigint, metric string, dimension_type string, dimension_value string, value double, source_url string"
)
CLAIM = (
    "statement_id bigint, politician_id bigint, metric string, dimension_type string, dimension_value string, "
    "assertion string, claimed_value double, source_type string, source_url string"
)


def stats(spark, values, metric="rate"):
    return spark.createDataFrame([(i, metric, "city", d, float(v), f"https://s/{i}") for i, d, v in values], STAT)


def claim(spark, assertion, dim, value=None, metric="rate", statement=1, source="manual"):
    return spark.createDataFrame(
        [(statement, 1, metric, "city", dim, assertion, value, source, "https://c/1")], CLAIM
    )


def judge(claims, statistics):
    return adj.adjudicate(adj.match_statistics(claims, statistics)).collect()[0]


CITIES = [(i, f"עיר-{i}", i * 5) for i in range(1, 12)] + [(99, "תל אביב", 58)]


def test_false_minimum_is_inconsistent(spark):
    v = judge(claim(spark, "superlative_min", "תל אביב"), stats(spark, CITIES))
    assert (v.outcome, v.confidence, v.official_statistic_id, v.numeric_gap) == ("inconsistent", 0.97, 99, 53.0)
    assert v.statistic_url == "https://s/99" and v.n_peers == 12
    assert v.rationale == (
        "הטענה אינה תואמת נתונים רשמיים: תל אביב אינו הנמוך ביותר; ערכו 58.0 לעומת הקיצון 5.0 (מתוך 12 ערכים)."
    )


def test_true_minimum_is_consistent(spark):
    v = judge(claim(spark, "superlative_min", "עיר-1"), stats(spark, CITIES))
    assert (v.outcome, v.confidence, v.numeric_gap) == ("consistent", 0.9, 0.0)


def test_maximum(spark):
    v = judge(claim(spark, "superlative_max", "תל אביב"), stats(spark, CITIES))
    assert v.outcome == "consistent"
    v = judge(claim(spark, "superlative_max", "עיר-11"), stats(spark, CITIES))
    assert (v.outcome, v.numeric_gap) == ("inconsistent", -3.0)
    assert v.confidence == round(1 - 10 / 11, 4)


def test_small_peer_set_lowers_confidence(spark):
    v = judge(claim(spark, "superlative_min", "a"), stats(spark, [(1, "a", 1)]))
    assert (v.outcome, v.confidence) == ("consistent", 0.54)
    v = judge(claim(spark, "superlative_min", "b"), stats(spark, [(1, "a", 1), (2, "b", 2)]))
    assert (v.outcome, v.confidence) == ("inconsistent", 0.2)


def test_tie_at_the_minimum_goes_to_the_lower_id(spark):
    tied = [(1, "a", 1), (2, "b", 1), (3, "c", 9)]
    assert judge(claim(spark, "superlative_min", "a"), stats(spark, tied)).outcome == "consistent"
    v = judge(claim(spark, "superlative_min", "b"), stats(spark, tied))
    assert (v.outcome, v.confidence, v.numeric_gap) == ("inconsistent", 0.15, 0.0)


@pytest.mark.parametrize(
    "claimed,actual,outcome,confidence,gap",
    [
        (20.0, 70.0, "inconsistent", 0.97, -50.0),
        (105.0, 100.0, "consistent", 0.9, 5.0),
        (105.01, 100.0, "unverifiable", 0.5, 5.01),
        (125.0, 100.0, "inconsistent", 0.85, 25.0),
        (1.0, 0.0, "inconsistent", 0.97, 1.0),
        (0.0, 0.0, "consistent", 0.9, 0.0),
    ],
)
def test_value_claims(spark, claimed, actual, outcome, confidence, gap):
    v = judge(claim(spark, "value", "a", claimed), stats(spark, [(5, "a", actual)]))
    assert (v.outcome, v.confidence, v.numeric_gap, v.official_statistic_id) == (outcome, confidence, gap, 5)


def test_value_claim_uses_the_first_listed_period(spark):
    v = judge(claim(spark, "value", "a", 10.0), stats(spark, [(7, "a", 1), (3, "a", 10), (9, "a", 5)]))
    assert (v.outcome, v.official_statistic_id) == ("consistent", 3)


def test_unverifiable(spark):
    v = judge(claim(spark, "superlative_min", "a", metric="other"), stats(spark, CITIES))
    assert (v.outcome, v.confidence, v.official_statistic_id, v.n_peers) == ("unverifiable", 0.0, None, 0)
    v = judge(claim(spark, "superlative_min", "nowhere"), stats(spark, CITIES))
    assert (v.outcome, v.confidence, v.numeric_gap, v.statistic_url) == ("unverifiable", 0.0, None, None)
    assert v.n_peers == 12
    assert judge(claim(spark, "value", "עיר-1"), stats(spark, CITIES)).outcome == "unverifiable"
    assert judge(claim(spark, "value", None, 5.0), stats(spark, CITIES)).outcome == "unverifiable"


def test_matcher_stays_inside_metric_and_dimension_type(spark):
    other = stats(spark, [(500, "תל אביב", 1)], metric="elsewhere")
    v = judge(claim(spark, "superlative_min", "תל אביב"), stats(spark, CITIES).unionByName(other))
    assert v.n_peers == 12


def gate(spark, outcome, confidence, source="manual", blocked=()):
    df = spark.createDataFrame([(outcome, confidence, source)], "outcome string, confidence double, source_type string")
    r = adj.publish_gate(df, transcription_sources=blocked).collect()[0]
    assert r.published == r.auto_published
    return r.published, r.review_status


def test_publish_gate(spark):
    assert gate(spark, "inconsistent", 0.85) == (True, "approved")
    assert gate(spark, "consistent", 0.9) == (True, "approved")
    assert gate(spark, "inconsistent", 0.8499) == (False, "pending")
    assert gate(spark, "unverifiable", 0.99) == (False, "pending")
    assert gate(spark, "inconsistent", 0.99, "manual", ["manual"]) == (False, "pending")
    assert gate(spark, "inconsistent", 0.99, None, ["manual"]) == (True, "approved")


def test_verify_rejects_claims_without_statement(spark):
    both = claim(spark, "superlative_min", "תל אביב").unionByName(
        claim(spark, "superlative_min", "תל אביב", statement=None)
    )
    verdicts, rejects, _ = adj.verify(both, stats(spark, CITIES))
    v = verdicts.collect()
    assert len(v) == 1 and rejects.count() == 1
    assert v[0].published and v[0].statement_url == "https://c/1" and v[0].statistic_url == "https://s/99"


def test_verdict_leaderboard(spark):
    rows = [(i, "inconsistent", True) for i in (1, 1, 2)] + [(1, "inconsistent", False), (1, "consistent", True)]
    verdicts = spark.createDataFrame(rows, "politician_id bigint, outcome string, published boolean")
    people = spark.createDataFrame(
        [(1, 900, "א", "p"), (2, 0, "ב", "q")], "person_id bigint, official_id bigint, full_name string, party string"
    )
    got = [tuple(r) for r in adj.verdict_leaderboard(verdicts, people).collect()]
    assert got == [("person-900", 1, "א", "p", 2), ("person-2", 2, "ב", "q", 1)]


def test_considered_statistics_of_any_size(spark, rows):
    verdicts, _, members = adj.verify(claim(spark, "superlative_min", "תל אביב"), stats(spark, CITIES))
    pairs = adj.considered_statistics(verdicts, stats(spark, CITIES))
    assert rows(pairs) == sorted(((1, s[0]) for s in CITIES), key=repr)
    places = sorted((r.place, r.stat_id) for r in members.collect())
    assert [i for _, i in places] == [s[0] for s in sorted(CITIES, key=lambda s: (s[2], s[0]))]


def test_claims_are_not_shuffled_when_the_catalog_is_small(spark):
    claims = spark.range(100).selectExpr(
        "id AS statement_id", "1L AS politician_id", "if(id < 90, 'rate', 'x') AS metric",
        "if(id < 95, 'city', 'y') AS dimension_type", "if(id < 50, 'תל אביב', 'z') AS dimension_value", "'value' AS assertion", "58D AS claimed_value", "'manual' AS source_type",
        "'u' AS source_url",
    )
    text = adj.match_statistics(claims, stats(spark, CITIES))._jdf.queryExecution().executedPlan().toString()
    claims_side = text[: text.index("Range (0, 100")].splitlines()
    depth = len(claims_side[-1]) - len(claims_side[-1].lstrip(" :+-"))
    above = [line for line in claims_side if len(line) - len(line.lstrip(" :+-")) < depth]
    assert sum("BroadcastHashJoin" in line for line in above) == 2
    assert not any("Exchange hash" in line or "SortMergeJoin" in line for line in above)
