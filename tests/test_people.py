"""Scorecards, listings, identity and the entity graph."""

import pytest
from pyspark.sql import functions as F

from factledger.plans import graph, listings, people, scorecard


def test_participation(spark):
    data = [(1, "for"), (1, "against"), (1, "absent"), (1, "na"), (2, "na"), (3, "absent")]
    votes = spark.createDataFrame(data, "person_id bigint, stance string")
    got = {r.person_id: r for r in scorecard.participation(votes).collect()}
    assert (got[1].cast, got[1].absent, got[1].eligible, got[1].score) == (2, 1, 3, 66.7)
    assert got[1].by_stance == {"for": 1, "against": 1, "absent": 1, "na": 1}
    assert (got[2].eligible, got[2].score) == (0, None)
    assert got[3].score == 0.0


def cards(spark, weights=None, **change):
    persons = spark.createDataFrame([(1,), (2,)], "person_id bigint")
    votes = spark.createDataFrame([(1, "for"), (1, "absent")], "person_id bigint, stance string")
    bills = spark.createDataFrame([(1, True), (1, None)], "person_id bigint, is_initiator boolean")
    args = [weights] if weights else []
    return scorecard.dimension_table(persons, votes, bills, *args)


def test_scorecard(spark):
    dims = cards(spark)
    assert dims.count() == 10
    one = {r.key: r for r in dims.filter("person_id = 1").collect()}
    assert one["participation"].score == 50.0 and one["legislative_activity"].raw == {
        "bills_sponsored": 2,
        "as_lead_initiator": 1,
    }
    assert not one["integrity"].available and one["legislative_activity"].score is None
    index = {r.person_id: r for r in scorecard.composite_index(dims).collect()}
    assert (index[1].index_value, index[1].coverage_scored, index[1].coverage_total) == (50.0, 1, 5)
    assert index[1].label == "preliminary" and index[1].weights_used == {"participation": 1.0}
    assert index[1].note == "Index reflects 1 of 5 dimensions; the rest await Phase 2 data sources."
    assert one["participation"].pending_reason is None and one["integrity"].label_en == "Integrity & legal proceedings"
    two = {r.key: r.pending_reason for r in dims.filter("person_id = 2").collect()}
    assert two["participation"] == "no roll-call votes ingested yet"
    assert (index[2].index_value, index[2].included) == (None, [])


def test_index_renormalises_and_splits_evenly(spark):
    dims = cards(spark, {"participation": 0.3, "legislative_activity": 0.1})
    scored = dims.withColumns(
        {
            "scorable": F.col("key").isin("participation", "legislative_activity"),
            "score": F.when(F.col("key") == "participation", 50.0).when(F.col("key") == "legislative_activity", 90.0),
        }
    )
    one = scorecard.composite_index(scored).filter("person_id = 1").collect()[0]
    assert (one.index_value, one.label) == (60.0, "partial")
    even = scorecard.composite_index(scored.withColumn("weight", F.lit(0.0))).filter("person_id = 1").collect()[0]
    assert even.index_value == 70.0
    full = dims.withColumns({"available": F.lit(True), "scorable": F.lit(True), "score": F.lit(10.0)})
    assert scorecard.composite_index(full).collect()[0].label == "full"


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"2024-01-{i:02d}") for i in range(1, 10)], "id int, d string")
    order = listings.newest_first("d", "id")
    assert [r.id for r in listings.page(df, order, 3).collect()] == [9, 6, 3]
    assert [r.id for r in listings.page(df, order, 3, 3).collect()] == [1, 2, 4]
    out = listings.envelope(df, order, 2, 8).collect()
    assert [(r.id, r.total, r.limit, r.offset) for r in out] == [(8, 9, 2, 8)]
    assert [r.id for r in listings.page_after(df, "id", 7).collect()] == [8, 9]
    for bad in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            listings.page(df, order, *bad)


def test_filters(spark, rows):
    df = spark.createDataFrame([("Dana", "x_1"), ("dan", None), (None, "xy1")], "name string, topic string")
    assert rows(df.filter(listings.like_any("DAN", "name"))) == [("Dana", "x_1"), ("dan", None)]
    assert rows(df.filter(listings.like_any("x_1", "name", "topic")), "topic") == [("x_1",), ("xy1",)]
    assert df.filter(listings.like_any("", "name")).count() == 3
    roster = df.withColumnRenamed("topic", "party")
    assert rows(listings.directory_filter(roster, "xy"), "party") == [("xy1",)]


def test_child_counts(spark, rows):
    persons = spark.createDataFrame([(1,), (2,)], "person_id bigint")
    kids = spark.createDataFrame([(1,), (1,), (3,)], "person_id bigint")
    got = rows(listings.child_counts(persons, {"roles": kids, "votes": kids.limit(0)}))
    assert got == [(1, 2, 0), (2, 0, 0)]


def test_profile_lists(spark, rows):
    sponsorships = spark.createDataFrame(
        [(1, 10, False, 1), (1, 11, True, None), (1, 12, True, 2), (1, 99, True, 1)],
        "person_id bigint, bill_id bigint, is_initiator boolean, ordinal int",
    )
    bills = spark.createDataFrame([(i, f"b{i}", 25, "u") for i in (10, 11, 12)], "bill_id bigint, name string, term_num int, source_url string")
    # the missing bill takes part in the cut, then drops out
    assert rows(listings.sample_bills(sponsorships, bills, 3), "bill_no", "bill_id") == [(2, 12), (3, 11)]
    votes = spark.createDataFrame([(1, 5, 5, "for", None), (1, 6, 6, "na", "own")], "person_id bigint, vote_id bigint, event_id bigint, stance string, source_url string")
    events = spark.createDataFrame([(5, "t", "e5")], "event_id bigint, title string, source_url string").withColumn(
        "vote_date", F.lit("2024-01-01").cast("date")
    )
    assert rows(listings.recent_votes(votes, events, 2), "recent_no", "event_title", "source_url") == [
        (1, None, "own"),
        (2, "t", "e5"),
    ]
    nested = listings.votes_with_event(votes, events).orderBy("vote_id").collect()
    assert nested[0].event_title == "t" and nested[1].event is None


def test_parties(spark):
    roster = spark.createDataFrame([("א",), ("א ",), (None,), ("",), ("ב",)], "party string")
    assert [tuple(r) for r in listings.party_sizes(roster).collect()] == [("א", 2), ("ללא סיעה", 2), ("ב", 1)]


def test_reconcile(spark, rows):
    persons = spark.createDataFrame(
        [(1, "בנימין", " נתניהו ", {}), (2, "a", "b", {"votes_mk_id": "5", "x": "1"}), (3, "no", "one", None), (4, None, None, {}), (5, "E", "F", {})],
        "person_id bigint, first_name string, last_name string, external_ids map<string,string>",
    )
    columns = (
        "mk_individual_name string, mk_individual_first_name string, mk_individual_name_eng string, "
        "mk_individual_first_name_eng string, LastName string, FirstName string, vip_id string, mk_id string, Id string, "
        "mk_individual_id int, pos int"
    )
    directory = spark.createDataFrame(
        [
            ("נתניהו", "בנימין", None, None, None, None, "bad", None, None, 90, 0),
            ("נתניהו", "בנימין", None, None, None, None, " 965 ", None, None, 90, 1),
            ("נתניהו", "בנימין", None, None, None, None, "966", None, None, 91, 2),
            ("b", "a", None, None, None, None, "7", None, None, 92, 3),
            (None, None, "F", "E", None, None, None, "9", None, 93, 4),
            ("F", "E", None, None, None, None, None, "8", None, 94, 5),
        ],
        columns,
    )
    out, missing = people.reconcile(persons, directory)
    ids = {r.person_id: r.external_ids for r in out.collect()}
    assert ids == {1: {"votes_mk_id": "965"}, 2: {"votes_mk_id": "5", "x": "1"}, 3: {}, 4: {}, 5: {"votes_mk_id": "8"}}
    assert rows(missing, "person_id") == [(3,), (4,)]
    forced, _ = people.reconcile(persons, directory, force=True)
    assert {r.person_id: r.external_ids for r in forced.collect()}[2] == {"votes_mk_id": "7", "x": "1"}


def test_accounts(spark, rows):
    schema = "person_id bigint, name string, pos int, username string, display_name string, bio string, followers bigint, verified boolean, government boolean"
    data = [
        (1, "דנה לוי", 0, "parody", "דנה לוי", "צחוקים", 10, False, False),
        (1, "דנה לוי", 1, "real", "ח״כ דנה-לוי", "חברת הכנסת", 10, False, False),
        (1, "דנה לוי", 2, "later", "דנה לוי", "", 9999, False, False),
        (2, "אבי", 0, "other", "משה", "שר האוצר", 10**6, True, True),
        (3, "!!", 0, "empty", "x", "", 10**6, True, False),
        (4, "רון כהן", 0, "big", "כהן", None, 5000, None, None),
    ]
    assert rows(people.match_accounts(spark.createDataFrame(data, schema))) == [(1, "real", 1), (4, "big", 0)]


def test_ministers(spark):
    roles = spark.createDataFrame(
        [
            (1, " שר האוצר", "אוצר", True, "2022"),
            (2, "שרת החינוך ", "חינוך", True, "2021"),
            (3, "חבר ועדה", "אוצר", True, "2021"),
            (4, "שר הפנים", None, True, "2021"),
            (5, "שר לשעבר", "x", False, "2021"),
        ],
        "person_id bigint, position_desc string, ministry_name string, is_current boolean, start_date string",
    ).withColumn("source_url", F.lit("u"))
    roster = spark.createDataFrame([(0, 1, "א")], "pos int, person_id bigint, name string")
    persons = spark.createDataFrame([(2, "ב")], "person_id bigint, full_name string")
    got = [(r.person_id, r.name, r.position) for r in people.ministers(roles, roster, persons).collect()]
    assert got == [(1, "א", "שר האוצר"), (2, "ב", "שרת החינוך")]


def test_graph(spark, rows):
    companies = spark.createDataFrame([("c1", "Old", 1)], "registration_id string, name string, at int")
    new = spark.createDataFrame([("c1", None, 2), ("c2", "Two", 2), (None, "x", 2)], "registration_id string, name string, at int")
    merged = graph.upsert_nodes(companies, new, "registration_id", ["at"], keep_present=["name"])
    assert rows(merged) == [("c1", "Old", 2), ("c2", "Two", 2)]
    assert graph.duplicate_keys(merged, "registration_id").count() == 0
    related = spark.createDataFrame([(965, "brother", "D"), (965, "son", "E"), (1, "son", "Z")], "person_key bigint, relation string, name string")
    links = spark.createDataFrame([("D", "c1", False), ("D", "c2", True), ("E", "c1", None)], "name string, registration_id string, controls boolean")
    owned = graph.ownership_edges(links)
    awarded = spark.createDataFrame([("c1", "t1"), ("c1", "t2"), ("c1", "t2")], "registration_id string, tender_id string")
    paths = graph.award_paths(related, owned, awarded)
    assert rows(paths, "person_key", "relative", "rel_type", "tender_id") == [
        (965, "D", "OWNS", "t1"),
        (965, "D", "OWNS", "t2"),
        (965, "E", "OWNS", "t1"),
        (965, "E", "OWNS", "t2"),
    ]
    assert rows(graph.path_counts(related, owned, awarded)) == [(965, 4, 2)]
    nodes = graph.add_missing(companies, graph.endpoints(owned, "registration_id", "registration_id"), "registration_id")
    assert rows(nodes, "registration_id", "name") == [("c1", "Old"), ("c2", None)]
