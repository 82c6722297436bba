"""The weekly job on a handful of records: new content only, and a repeated week."""

import json

import pytest

from catascope.plans.weekly import Warehouse, harvest

API = "http://portal.org/api"


def records(spark, docs):
    rows = [("p", k, json.dumps(d)) for k, d in docs.items()]
    return spark.createDataFrame(rows, "portalid string, id string, raw string")


def ckan(key, **more):
    return {"id": key, "name": f"n-{key}", "title": f"T {key}", "resources": [{"id": "r", "url": f"http://x.org/{key}", "format": "csv"}], **more}


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    wh = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    portals = spark.createDataFrame([("p", "CKAN", API)], "id string, software string, apiuri string")
    runs = spark.createDataFrame([("p", None, None, None)], "portalid string, start_ts timestamp, end_ts timestamp, exc string")
    one = {k: ckan(k) for k in "abcd"}
    two = {**{k: ckan(k) for k in "ab"}, "c": ckan("c", notes="new"), "e": ckan("e")}
    for snapshot, docs in [(1601, one), (1602, two), (1602, two)]:
        harvest(wh, records(spark, docs), portals, runs, snapshot)
    return wh


def test_change_rows(wh):
    got = {r.snapshot: (r.added, r.deleted, r.updated, r.static, r.union_size) for r in wh.read("dynamics").collect()}
    assert got == {1601: (4, 0, 0, 0, 4), 1602: (1, 1, 1, 2, 5)}


def test_content_is_kept_once_under_its_first_week(wh):
    got = {(r.snapshot, r.title) for r in wh.read("content").collect()}
    assert got == {(1601, "T a"), (1601, "T b"), (1601, "T c"), (1601, "T d"), (1602, "T c"), (1602, "T e")}
    assert wh.read("quality").count() == 6 and wh.read("resources").count() == 6


def test_datasets_and_runs(wh):
    assert sorted((r.snapshot, r.id, r.title) for r in wh.read("datasets").collect())[-1] == (1602, "e", "T e")
    assert {(r.snapshot, r.datasetsfetched, r.resourcecount, r.status) for r in wh.read("runs").collect()} == {(1601, 4, 4, 200), (1602, 4, 4, 200)}
    assert {(r.snapshot, r.datasets) for r in wh.read("portal_quality").collect()} == {(1601, 4), (1602, 4)}


def test_formats_and_freshness(wh):
    formats = {(r.snapshot, r.level, r.grouping, r.format): r["count"] for r in wh.read("format_dist").collect()}
    assert formats[1601, "portal", "p", "csv"] == 4 and formats[1602, "software", "CKAN", "csv"] == 4
    assert wh.read("freshness").where("snapshot = 1602").count() == wh.read("history").where("snapshot = 1602").select("uri", "md5").distinct().count()


def test_freshness_of_checked_resources(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    portals = spark.createDataFrame([("p", "CKAN", API)], "id string, software string, apiuri string")
    runs = spark.createDataFrame([("p", None, None, None)], "portalid string, start_ts timestamp, end_ts timestamp, exc string")
    for i in range(2):
        header = {"Last-Modified": [f"0{i + 1} Jan 2016 10:00:00 GMT"]}
        lookups = spark.createDataFrame([("http://x.org/a", 1601 + i, header)], "uri string, snapshot int, header map<string,array<string>>")
        harvest(wh, records(spark, {"a": ckan("a")}), portals, runs, 1601 + i, lookups)
    assert sorted((r.snapshot, str(r.modified)) for r in wh.read("history").where("source = 'header'").collect()) == [(1601, "2016-01-01"), (1602, "2016-01-02")]
    row = wh.read("freshness").where("snapshot = 1602").first()
    assert row.uri == "http://x.org/a" and row.mark1_header is None  # too short a history for an estimate


def test_supplied_documents(spark, tmp_path):
    from catascope.operators import mapping as ma
    from pyspark.sql import functions as F

    folder = tmp_path / "software=CKAN"
    folder.mkdir()
    (folder / "doc-1.json").write_text(json.dumps(ckan("a")))
    docs = ma.read_documents(spark, str(tmp_path)).withColumn("apiuri", F.lit(API))
    row = ma.to_dcat(docs, ["CKAN"]).first()
    assert row.id == "doc-1" and row.title == ["T a"] and row.uri == API + "/dataset/a"


def test_weeks_repeated_with_fewer_records_and_without_any(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    portals = spark.createDataFrame([("p", "CKAN", API), ("q", "Socrata", API)], "id string, software string, apiuri string")
    runs = spark.createDataFrame([("p", None, None, None)], "portalid string, start_ts timestamp, end_ts timestamp, exc string")
    take = lambda docs, sn: harvest(wh, records(spark, docs), portals, runs, sn)
    ids = lambda name: sorted((r.snapshot, r.title) for r in wh.read(name).collect())
    take({}, 1600)
    take({"a": {"title": "no resources"}}, 1600)
    take({k: ckan(k) for k in "ab"}, 1601)
    take({k: ckan(k) for k in "ac"}, 1602)
    take({"b": ckan("b")}, 1601)
    assert ids("datasets") == [(1600, "no resources"), (1601, "T b"), (1602, "T a"), (1602, "T c")]
    assert ids("content") == [(1600, "no resources"), (1601, "T a"), (1601, "T b"), (1602, "T c")]  # week 1602 still uses a
    take({}, 1602)
    assert ids("datasets")[-1] == (1601, "T b") and (1602, "T c") not in ids("content")
    assert wh.read("portal_quality").where("snapshot = 1602").count() == 0


def test_a_job_that_ends_between_two_tables_leaves_the_old_week(spark, tmp_path, monkeypatch):
    from catascope.plans import weekly
    from catascope.sources import folders

    portals = spark.createDataFrame([("p", "CKAN", API)], "id string, software string, apiuri string")
    runs = spark.createDataFrame([("p", None, None, None)], "portalid string, start_ts timestamp, end_ts timestamp, exc string")
    wh = lambda: Warehouse(spark, str(tmp_path))
    harvest(wh(), records(spark, {k: ckan(k) for k in "ab"}), portals, runs, 1601)
    tables = ["bronze", "content", "datasets", "quality", "resources", "runs", "dynamics", "freshness", "summary"]
    state = lambda: {n: sorted(map(str, wh().read(n).collect())) for n in tables}
    before = state()

    def broken(*args):
        raise RuntimeError("the cluster is gone")

    with monkeypatch.context() as m:
        m.setattr(weekly, "aggregate", broken)
        with pytest.raises(RuntimeError):
            harvest(wh(), records(spark, {"c": ckan("c")}), portals, runs, 1601)
    assert state() == before
    harvest(wh(), records(spark, {"c": ckan("c")}), portals, runs, 1601)
    assert [r.id for r in wh().read("datasets").collect()] == ["c"]
    assert all(len(folders.names(spark, f"{tmp_path}/{n}/snapshot=1601")) == 1 for n in tables)
