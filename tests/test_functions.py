import datetime as dt

import pytest
from pyspark.sql import functions as F

from catascope.functions import cells, documents, licenses, ratios, snapshot, status, text, urls


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_snapshot_ids(spark):
    days = [dt.date(2016, 1, 1), dt.date(2024, 12, 30), dt.date(2020, 12, 31), None]
    assert values(spark, days, snapshot.snapshot_of, "date") == [1553, 2501, 2053, None]


def test_week_bounds_follow_the_iso_rule(spark):
    for fn, day in [(snapshot.monday_of, 1), (snapshot.thursday_of, 4), (snapshot.sunday_of, 7)]:
        for sn in (1801, 1901, 2001, 2401, 1553, 2053, 801):
            want = dt.date.fromisocalendar(2000 + sn // 100, sn % 100, day)
            assert values(spark, [sn], fn, "int") == [want]


def test_neighbour_weeks_cross_years(spark):
    assert values(spark, [1553, 1601, 2053], snapshot.next_snapshot, "int") == [1601, 1602, 2101]
    assert values(spark, [1601, 1553, 2101], snapshot.previous_snapshot, "int") == [1553, 1552, 2053]


def test_snapshots_between_leaves_the_end_out(spark):
    start = F.lit(dt.date(2016, 1, 1))
    row = spark.range(1).select(
        snapshot.snapshots_between(start, F.lit(dt.date(2016, 1, 15))).alias("a"),
        snapshot.snapshots_between(start, start).alias("b"),
    ).first()
    assert row.a == [1553, 1601] and row.b == []


def test_week_labels(spark):
    assert values(spark, [1627], snapshot.week_label, "int") == ["W27-'16"]
    assert values(spark, [1627], snapshot.week_span, "int") == ["Jul 4 - Jul 10, 2016"]


def test_partial_timestamp(spark):
    rows = ["2016", "201607", "20161", "20160704123059", "20169901", "201", "abc", None, "201607041230599"]
    got = values(spark, rows, text.partial_timestamp)
    assert got == [
        dt.datetime(2016, 1, 1), dt.datetime(2016, 7, 1), dt.datetime(2016, 1, 1), dt.datetime(2016, 7, 4, 12, 30, 59), None, None, None, None, None,
    ]


def test_formats_and_media_types(spark):
    assert values(spark, [" .CSV ", "text/CSV", None, "..x"], text.normalise_format) == ["csv", "text/csv", None, ".x"]
    assert values(spark, ["text/html; charset=utf-8", None], text.mime_or_missing) == ["text/html", "missing"]


def test_lenient_datetime(spark):
    rows = ["2011-01-01T00:00:00.123", "2011-01-01", "2011-01-01T00:00:00Z", "2011-01-01T00:00:00.5+02:00", "01/02/2011", "", None, "2011-01-01T00:00:00 or so", "2011-01-01."]
    assert values(spark, rows, text.lenient_datetime) == [dt.datetime(2011, 1, 1)] * 4 + [None] * 5


def test_free_text_dates(spark):
    rows = {
        "Mon, 04 Jul 2016 10:00:00 GMT": "2016-07-04T10:00:00",
        "2016-07-04T10:00:00+02:00": "2016-07-04T08:00:00",
        "2016-07-04T23:30:00.25-0130": "2016-07-05T01:00:00",
        "1 January 2015": "2015-01-01T00:00:00",
        "Thursday, 01 January 2015 10:00:00 GMT": "2015-01-01T10:00:00",
        "September 9, 2015": "2015-09-09T00:00:00",
        " " * 70 + "2015-01-01": "2015-01-01T00:00:00",
        "x" * 70 + "2015-01-01": "x" * 70 + "2015-01-01",
        "1 Sometime 2015": "1 Sometime 2015",
        "2016-07-04 10:00": "2016-07-04T10:00:00",
        "20160704": "2016-07-04T00:00:00",
        "4.7.2016": "2016-07-04T00:00:00",
        "Jul 4, 2016": "2016-07-04T00:00:00",
        "2016-13-45": "2016-13-45",
        "soon": "soon",
        "": "",
    }
    assert values(spark, list(rows), text.iso_or_text) == list(rows.values())


def test_urls(spark):
    rows = ["http://a.b/c", "nourl", "mailto:a@b.c", "http:// http://a.b", None]
    assert values(spark, rows, urls.url_valid) == [True, False, False, True, False]
    assert values(spark, ["http:// http://a.b", "http:// \thttp://a.b"], urls.repair_url) == ["http://a.b", "http://a.b"]
    assert values(spark, ["mailto:a@b.c", "http://a b", "http://[::1]/x?y#z", "no"], urls.uri_valid) == [True, False, True, False]
    given = ["HTTP://A.b:80", "https://x.org/a b?q=ü", "https://u:P@Ho.st:443#f", " nourl "]
    assert values(spark, given, urls.normalise_url) == ["http://a.b/", "https://x.org/a%20b?q=%C3%BC", "https://u:P@ho.st/#f", "nourl"]


def test_portal_id(spark):
    assert values(spark, ["http://data.a.org/", "http://a.org/x/y"], urls.portal_id) == ["data_a_org", "a_org_x_y"]


def test_emails_match_at_the_start_only(spark):
    assert values(spark, ["a@b.c", "a@b.c trailing", "x a@b.c", None], urls.email_valid) == [True, True, False, False]


CELLS = {
    "": "EMPTY", "null": "EMPTY", None: "EMPTY", "a@b.c": "EMAIL", "http://x/y.pdf": "RESOURCE", "1999": "YEAR",
    "201101": "YEAR_MONTH", "20110101": "DATE", "2011/01/01": "DATE", "2011-01-01": "DATE", "12.25": "FLOAT",
    "7": "INTEGER", "ja": "YES_NO", "105mm": "UNKNOWN", "Gebiet/Distrikt": "ALPHA", "12 34": "UNKNOWN", "99999999999999999999": "INTEGER",
}


def test_cell_types(spark):
    assert values(spark, list(CELLS), cells.cell_type) == list(CELLS.values())


def test_strict_dates(spark):
    rows = ["2011-01-31", "20110131", "1999/12/01", "12/31/2010", "12/31/2010 noon", "1.2.2011", "31.12.99", "2011-01", "3011-01-01", "13/01/2010x", "", None]
    assert values(spark, rows, cells.is_strict_date) == [True, True, True, True, True, True, True, False, False, False, False, None]
    from catascope.plans.registry import all_sql

    assert " as strict_dates" in all_sql()["cell_predicates"]


def test_cell_labels(spark):
    rows = ["1", " -1.5e3 ", "1d", "nan", "2011-01-01T00:00:00", "2011-13-01T00:00:00", "", None, "x"]
    assert values(spark, rows, cells.cell_label) == ["number", "number", "any", "number", "datetime", "any", "empty", "empty", "any"]


def test_clean_text(spark):
    assert values(spark, ["'a  b'", '"x', "'", "a\n b"], text.clean_text) == ["a b", '"x', "", "a b"]


def test_sizes_and_lists(spark):
    assert values(spark, ["12.7", "x", None, "1e3"], text.byte_size) == [12, None, None, 1000]
    assert values(spark, ['["a","b"]', "a,b", "a", "", None, "[broken"], text.list_items) == [["a", "b"], ["a", "b"], ["a"], [], [], ["[broken"]]
    assert values(spark, ['{"label":"L"}', '{"label"', "x"], text.unwrap_label) == ["L", '{"label"', "x"]


LICENSES = [
    (("x", "cc-by", None), ("CC-BY-4.0", "approved")),
    (("Creative Commons CCZero", None, None), ("CC0-1.0", "approved")),
    ((None, None, "https://opendatacommons.org/licenses/by"), ("ODC-BY-1.0", "approved")),
    (("t", "bar", "u"), ("bar", "not found")),
    ((None, "cc-nc", None), ("cc-nc", "not found")),
    (("Other (Open)", "", ""), ("other-open", "not reviewed")),
    (("MIT License", "nope", None), ("MIT", "not reviewed")),
    ((None, None, None), (None, "not found")),
]


def test_licenses_as_expression_and_as_join(spark):
    df = spark.createDataFrame([(i, *g) for i, (g, _) in enumerate(LICENSES)], "i int, t string, l string, u string")
    one = df.select("i", licenses.map_license(F.col("t"), F.col("l"), F.col("u")).alias("m")).orderBy("i").collect()
    assert [tuple(r.m) for r in one] == [w for _, w in LICENSES]
    registry = spark.createDataFrame(licenses.REGISTRY, "id string, title string, url string, conformance string")
    two = licenses.map_licenses(df, registry, "t", "l", "u").orderBy("i").collect()
    assert [(r.license, r.conformance) for r in two] == [w for _, w in LICENSES]


def test_status_codes(spark):
    names = ["requests.exceptions.ConnectTimeout", "ReadTimeout", "odd.Error"]
    assert values(spark, names, status.exception_code) == [702, 704, 600]
    assert values(spark, ["twisted.internet.error.DNSLookupError"], status.transport_code) == [606]
    assert values(spark, [200, 404, 400, 600, 301], status.status_class, "int") == ["ok", "error", "other", "other", "other"]
    assert values(spark, [702, 200], status.status_label, "int") == ["Connection Error", "200"]


def test_extras_as_list_and_as_object(spark):
    raws = [
        '{"extras":[{"key":"a","value":"1"},{"key":"a","value":"2"},{"novalue":1}],"title":""}',
        '{"extras":{"dcat_issued":"2015-01-02","title":"T"}}',
        "{}",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").select("i", F.try_parse_json("r").alias("v"))
    df = df.withColumn("e", documents.extras_map(F.col("v"))).orderBy("i")
    assert [r.e for r in df.collect()] == [{"a": "2"}, {"dcat_issued": "2015-01-02", "title": "T"}, {}]
    got = df.select(documents.field(F.col("v"), F.col("e"), "title").alias("t"), documents.field(F.col("v"), F.col("e"), "issued").alias("d")).collect()
    assert [(r.t, r.d) for r in got] == [("", None), ("T", "2015-01-02"), (None, None)]


def test_content_hash_ignores_key_order(spark):
    raws = ['{"a":1,"b":{"d":2,"c":[1,2]}}', '{ "b": {"c":[1, 2],"d":2}, "a":1 }', '{"a":1,"b":{"d":2,"c":[2,1]}}']
    a, b, c = values(spark, raws, ratios.content_hash)
    assert a == b and a != c


@pytest.mark.parametrize("seconds,label", [(3723.456, "01:02:03.46"), (59.0, "00:00:59.00")])
def test_duration_label(spark, seconds, label):
    assert spark.range(1).select(text.duration_label(F.lit(seconds))).first()[0] == label
