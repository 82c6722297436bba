import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from catascope.llm import warc
from catascope.session import scratch

PAGES = "page_id long, url string, html string"


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["html"] or "", []).append(r["page_id"])
    out = []
    for text, ids in groups.items():
        data = text.encode()
        known = [i for i in ids if i is not None]
        last = max(known) if known and len(data) >= 1000 and len(ids) > 1 else None
        for i in ids:
            again = last is not None and i != last
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<p>é</p>\r\n\r\n" * 20_000
    rows = [
        (1, None, None), (2, "http://a b/\r\nX: y", ""), (3, "http://a/", "x" * 999), (4, "http://a/", "x" * 999),
        (5, "http://b/", "y" * 1000), (6, "http://b/", "y" * 1000), (6, "http://b/", "y" * 1000), (None, "http://b/", "y" * 1000),
        (None, None, "z" * 2000), (None, None, "z" * 2000), (7, "http://c/é", long), (8, None, long), (9, "u", "é" * 500), (10, "u", "é" * 500),
    ]
    df = spark.createDataFrame(rows, PAGES)
    return df.withColumns({c: F.lit(c) for c in ("digest", "file", "offset", "last", "n", "probe", "revisit")})


def test_round_trip(spark, sf, odd_pages):
    for df in (spark.read.parquet(f"{sf}/pages.parquet"), odd_pages):
        got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
        assert got == plain(df.collect())
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_sql_says_the_same(spark, odd_pages):
    con = duckdb.connect()
    con.register("pages", odd_pages.toPandas()[["page_id", "url", "html"]].astype({"page_id": "Int64"}))
    con.execute("create view typed as select page_id::bigint as page_id, url, html from pages")
    got = con.execute(warc.ORACLE.replace("from pages", "from typed")).fetchall()
    assert sorted(got, key=str) == plain(odd_pages.collect())


def test_files_are_archives_and_the_index_finds_records(spark, odd_pages):
    folder = scratch(spark, "warc-test")
    index = warc.written(odd_pages.repartition(3), folder)
    rows = index.collect()
    assert len(rows) == 14
    for r in rows:
        store, path = warc.opened(r["file"])
        with store.open_input_file(path) as f:
            data = gzip.decompress(f.read_at(r["length"], r["offset"]))
        found = warc.parsed(data)
        assert data.startswith(b"WARC/1.1\r\n") and found["payload_digest"] == r["digest"] and found["page_id"] == r["page_id"]
    for file in {r["file"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["file"] == file)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))  # records follow each other


def test_selected_records_come_by_few_reads(spark, odd_pages):
    index = warc.written(odd_pages, scratch(spark, "warc-test"))
    some = warc.read(index.where("page_id in (3, 7, 8)"), run_bytes=500).collect()
    payload = {r["page_id"]: r["html"].encode() for r in odd_pages.where("page_id is not null").collect() if r["html"]}
    assert sorted(r["page_id"] for r in some) == [3, 7, 8]
    assert all(r["payload"] == payload[r["page_id"]] for r in some if r["record_type"] == "response")
    assert {r["page_id"] for r in some if r["payload"] is None} == {7}


def test_runs_join_neighbours():
    assert warc.runs([0, 10, 100, 1000], [10, 20, 5, 1], gap=70) == [(0, 105), (1000, 1)]
    assert warc.runs([0, 2], [50, 3], gap=0) == [(0, 50)]


def test_wrong_digest_is_an_error():
    data = gzip.decompress(warc.record(1, "u", b"abc", "0" * 40, None, False))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(data)
