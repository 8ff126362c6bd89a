"""Landed files, mappers, idempotent ingest and sinks."""

import datetime
import json

from pyspark.sql import functions as F

from factledger.schemas import TABLES, split_sourced, split_vocabulary
from factledger.sources import ingest, landed, mappers, sinks

FEED = "https://feed.example/v4/Person"


def write(path, payload):
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False), encoding="utf-8")


def pages(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    first = {"Id": 1, "FirstName": " דנה ", "LastName": "לוי", "IsCurrent": True}
    write(folder / "p1.json", {"value": [first, {"Id": 2, "LastName": "כהן"}], "@odata.nextLink": "p2"})
    write(folder / "p2.json", {"value": [first, {"ID": "965.0", "first_name": "א", "IsCurrent": "no"}, {"x": 1}]})
    return str(folder)


def test_pages(spark, tmp_path, rows):
    got = landed.read_pages(spark, pages(tmp_path), FEED, "knesset_odata")
    assert rows(got, "source_record_id", "source_url") == sorted(
        [("1", FEED + "(1)"), ("2", FEED + "(2)"), ("965.0", FEED + "(965.0)"), (None, FEED)], key=repr
    )
    assert landed.read_pages(spark, pages_again(tmp_path), FEED, "knesset_odata", max_records=2).count() == 2
    assert landed.count_rows(got).collect()[0][0] == 4


def pages_again(tmp_path):
    return str(tmp_path / "pages")


def test_map_people(spark, tmp_path):
    got = {r.person_id: r for r in mappers.map_people(landed.read_pages(spark, pages(tmp_path), FEED, "knesset_odata")).collect()}
    assert got[1].full_name == "דנה לוי" and got[1].is_current and got[1].source_name == "knesset_odata"
    assert got[2].full_name == "כהן" and got[2].first_name is None and got[2].is_current is False
    assert got[965].first_name == "א" and json.loads(got[965].raw_payload)["ID"] == "965.0"
    assert got[None].full_name == ""


def stamped(spark, payloads, at="2024-01-01"):
    df = spark.createDataFrame([(json.dumps(p, ensure_ascii=False),) for p in payloads], "payload string")
    return landed.stamp(df.withColumn("fetched_at", F.lit(at).cast("timestamp")), FEED, "knesset_odata")


def test_map_roles_bills_and_votes(spark):
    role = mappers.map_roles(
        stamped(spark, [{"PersonID": 1, "DutyDesc": "שר", "StartDate": "2023-12-31T00:30:00+02:00", "FinishDate": None, "IsCurrent": 1}])
    ).collect()[0]
    assert role.start_date == datetime.date(2023, 12, 31) and role.finish_date is None and role.is_current
    bills = mappers.map_bills(
        stamped(spark, [{"Id": 5, "Name": "חוק", "StatusID": 118}, {"BillID": 6, "StatusDesc": "עבר", "StatusID": 1}])
    ).orderBy("bill_id").collect()
    assert [(b.bill_id, b.status_desc) for b in bills] == [(5, "118"), (6, "עבר")]
    events = mappers.map_vote_events(
        stamped(
            spark,
            [
                {"vote_id": 1, "sess_item_dscr": "s", "vote_item_dscr": "v", "is_accepted": 1, "session_id": 7},
                {"vote_id": 2, "sess_item_dscr": "s", "is_accepted": "0", "session_num": 8, "session_id": 7},
                {"vote_id": 3},
            ],
        )
    ).orderBy("event_id").collect()
    assert [(e.title, e.result, e.session_num) for e in events] == [("v", "passed", 7), ("s", "failed", 8), (None, "unknown", None)]
    shadow = stamped(spark, [{"vote_id": 1, "vote_result": 4}, {"vote_result": 1}]).withColumn("kmmbr_id", F.lit("000000965"))
    ids = spark.createDataFrame([(1, 965), (2, 966)], "person_id bigint, votes_id bigint")
    votes = mappers.map_votes(landed.roll_call(ids, shadow)).collect()
    assert [(v.person_id, v.event_id, v.stance) for v in votes] == [(1, 1, "absent")]


def test_ingest_is_idempotent(spark, rows):
    first = mappers.map_people(stamped(spark, [{"Id": 1, "FirstName": "a", "LastName": "b", "Email": "e"}]))
    empty = spark.createDataFrame([], TABLES["people"])
    once = ingest.ingest_people(empty, first)
    twice = ingest.ingest_people(once, first)
    assert rows(twice, "person_id", "full_name") == [(1, "a b")]
    later = mappers.map_people(stamped(spark, [{"Id": 1}, {"x": 1}], "2024-02-01"))
    r = ingest.ingest_people(twice.withColumn("external_ids", F.create_map(F.lit("k"), F.lit("v"))), later).collect()
    assert len(r) == 1 and r[0].full_name == "a b" and r[0].email is None and r[0].external_ids == {"k": "v"}
    assert r[0].fetched_at == datetime.datetime(2024, 2, 1)


def test_sponsorships_of_unknown_bills_are_rejected(spark, rows):
    new = mappers.map_sponsorships(
        stamped(spark, [{"PersonID": 1, "BillID": 5, "IsInitiator": True}, {"PersonID": 1, "BillID": 6}, {"PersonID": 1}])
    )
    bills = spark.createDataFrame([(5,)], "bill_id bigint")
    out, rejects = ingest.ingest_sponsorships(spark.createDataFrame([], TABLES["sponsorships"]), new, bills)
    assert rows(out, "bill_id", "is_initiator") == [(5, True)] and rows(rejects, "bill_id") == [(6,)]


def test_headers(spark, rows):
    votes = spark.createDataFrame([(1,), (1,), (2,)], "event_id bigint")
    kept, warnings = landed.with_headers(votes, spark.createDataFrame([(2,)], "event_id bigint"))
    assert rows(kept) == [(2,)] and rows(warnings, "event_id", "rows") == [(1, 2)]
    stored = spark.createDataFrame([(1, "old")], "event_id bigint, title string")
    new = spark.createDataFrame([(1, "new", 1), (2, "b", 1)], "event_id bigint, title string, fetched_at int")
    assert rows(ingest.ingest_vote_events(stored, new)) == [(1, "old"), (2, "b")]


def catalog(tmp_path, rows):
    path = tmp_path / "catalog.json"
    write(path, {"metric": "rate", "dimension_type": "city", "rows": rows})
    return str(path)


def test_catalog(spark, tmp_path, rows):
    data = [
        {"dimension_value": "_TEMPLATE", "value": 0, "source_url": "https://x"},
        {"dimension_value": "ג", "value": 60, "source_url": "  "},
        {"dimension_value": "ד", "value": 65.5, "source_url": " https://d "},
        {"dimension_value": "ה", "value": 1, "period": "2022"},
    ]
    good, rejected = landed.read_catalog(spark, catalog(tmp_path, data))
    assert rows(good, "dimension_value", "value", "source_url", "source_type") == [("ד", 65.5, "https://d", "manual")]
    assert rows(rejected, "dimension_value", "reject_reason") == [("ג", "no source_url"), ("ה", "no source_url")]


def test_catalog_load_twice_with_null_period(spark, tmp_path, rows):
    good, _ = landed.read_catalog(spark, catalog(tmp_path, [{"dimension_value": "א", "value": 50, "source_url": "https://a"}]))
    wide = good.select(
        "metric", "dimension_type", "dimension_value", "period", "value", "unit", "notes", "source_url", "source_type", "pos"
    )
    stored = ingest.ingest_statistics(wide.drop("pos").limit(0), wide)
    again = ingest.ingest_statistics(stored, wide.withColumns({"value": F.lit(51.0), "source_type": F.lit("cbs")}))
    assert rows(again, "dimension_value", "period", "value", "source_type") == [("א", None, 51.0, "manual")]


def test_unknown_source_type_is_rejected(spark, tmp_path):
    path = tmp_path / "c.json"
    write(path, {"metric": "m", "dimension_type": "d", "source_type": "rumour", "rows": [{"dimension_value": "a", "value": 1, "source_url": "u"}]})
    good, rejected = landed.read_catalog(spark, str(path))
    assert good.count() == 0 and rejected.collect()[0].reject_reason == "unknown source_type: rumour"


def test_splits(spark):
    df = spark.createDataFrame([("u", "for"), (None, "maybe"), ("", None)], "source_url string, stance string")
    assert split_sourced(df)[0].count() == 2 and split_sourced(df, blank_is_missing=True)[0].count() == 1
    good, bad = split_vocabulary(df, "stance")
    assert good.count() == 2 and bad.collect()[0].reject_reason == "unknown stance: maybe"


def test_transcripts(spark, tmp_path, rows):
    folder = tmp_path / "transcripts" / "person-1"
    folder.mkdir(parents=True)
    write(folder / "a.json", {"person_id": 1, "mk_name": "א", "video_id": "a", "segments": [{"start": 0, "end": 1.5, "text": "שלום"}, {"start": 2}]})
    write(folder / "b.json", {"person_id": 1, "video_id": "b"})
    write(folder / "c.json", "{broken")
    good, bad = landed.read_transcripts(spark, str(tmp_path / "transcripts" / "*"))
    assert rows(good, "video_id") == [("a",), ("b",)] and bad.count() == 1
    assert rows(landed.segments_of(good), "video_id", "pos", "start", "text") == [("a", 0, 0.0, "שלום"), ("a", 1, 2.0, "")]
    done = spark.createDataFrame([("a",)], "video_id string")
    assert rows(landed.unseen(good.select("video_id"), done, "video_id")) == [("b",)]


def test_posts_and_other_files(spark, tmp_path, rows):
    write(tmp_path / "person-1.json", {"person_id": 1, "handle": "h", "tweets": [{"text": " "}, {"text": "a", "likes": 3}, {}]})
    assert rows(landed.read_posts(spark, str(tmp_path / "person-*.json")), "pos", "text", "likes") == [(1, "a", 3)]
    write(tmp_path / "roster.json", [{"person_id": 1, "name": "א"}, {"person_id": 2, "name": "ב"}])
    assert rows(landed.read_roster(spark, str(tmp_path / "roster.json")), "pos", "name") == [(0, "א"), (1, "ב")]
    write(tmp_path / "series.json", {"series": {"b": {"label": "B", "points": [{"year": 2020, "value": 1}]}, "a": {"label": "A"}}})
    assert rows(landed.read_series(spark, str(tmp_path / "series.json")), "pos", "key", "label") == [(0, "b", "B"), (1, "a", "A")]
    write(tmp_path / "min.json", {"ministers": [{"person_id": 1, "position": "שר"}]})
    assert rows(landed.read_ministers(spark, str(tmp_path / "min.json")), "pos", "position") == [(0, "שר")]
    write(tmp_path / "dec.json", {"decisions": [{"id": "F-0001", "decision": "reject"}]})
    assert rows(landed.read_decisions(spark, str(tmp_path / "dec.json")), "id", "decision") == [("F-0001", "reject")]
    write(tmp_path / "points.json", {"data_points": [{"metric": "m", "value": 2, "verified": True}]})
    assert rows(landed.read_data_points(spark, str(tmp_path / "points.json")), "metric", "value") == [("m", 2.0)]


def test_csv_package(spark, tmp_path, rows):
    folder = tmp_path / "members"
    folder.mkdir()
    write(folder / "datapackage.json", {"resources": [{"name": "positions", "path": "positions.csv"}]})
    write(folder / "positions.csv", 'mk_individual_id,name\n 90 ,"לוי, דנה"\n90,second\n91,x\n')
    got = landed.read_dataset(spark, str(folder), "positions")
    assert rows(got, "source_record_id", "name") == [("90", "second"), ("90", "לוי, דנה"), ("91", "x")]
    assert landed.read_dataset(spark, str(folder), "missing") is None
    numbered_rows = got.select("mk_individual_id", "name", F.monotonically_increasing_id().alias("pos"))
    first = landed.first_enrichment(numbered_rows)
    assert {r.individual_id: json.loads(r.payload)["name"] for r in first.collect()} == {"90": "לוי, דנה", "91": "x"}


def test_find_persons(spark):
    df = spark.createDataFrame([(1, "כהן", "א"), (2, "כהן", "ב"), (3, "לוי", "א")], "id int, last_name string, first_name string")
    assert landed.find_persons(df, "כהן").count() == 2 and landed.find_persons(df, "כהן", "ב").count() == 1


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "person_id bigint, text string")
    sinks.write_by_person(df, str(tmp_path / "people"))
    assert sorted(p.name for p in (tmp_path / "people").glob("pid=*")) == ["pid=1", "pid=2"]
    sinks.write_index(df, str(tmp_path / "index"))
    assert all(p.name.endswith(".gz") for p in (tmp_path / "index").glob("part-*"))
    findings = spark.createDataFrame([("F-0001", "confirmed"), ("F-0002", "candidate")], "id string, status string")
    sinks.write_findings(findings, str(tmp_path / "store"), str(tmp_path / "public"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert rows(spark.read.json(str(tmp_path / "public")), "id") == [("F-0001",)]


def test_report(spark, rows):
    df = spark.range(3)
    assert rows(ingest.report(people=df, bills=df.limit(0))) == [("bills", 0), ("people", 3)]


def test_catalog_documents_are_bounded(spark, tmp_path, monkeypatch):
    """One brand's rows are dealt over several documents, and all come back."""
    from factledger.bindings import Views
    from factledger.queries import files

    part = spark.range(3000).selectExpr(
        "id AS p_partkey", "'n' || id AS p_name", "'Brand#1' AS p_brand", "CAST(id AS DOUBLE) AS p_retailprice", "CAST(id % 4 AS INT) AS p_size"
    )
    part.write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(files, "CATALOG_ROWS", 500)
    seen = []
    read = files.landed.read_catalog
    monkeypatch.setattr(files.landed, "read_catalog", lambda s, path: seen.append(path) or read(s, path))
    out = files.catalog_file(Views(spark, str(tmp_path)))
    assert out.count() == 3000
    longest = spark.read.option("multiLine", True).json(seen[0]).selectExpr("max(size(rows)) AS n").first()["n"]
    assert longest < 700
