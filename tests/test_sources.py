import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catascope.operators import profile as pr
from catascope.sources import csvfiles as cf
from catascope.sources import harvest as ha
from catascope.sources import lookups as lo
from catascope.sources import portals as po
from catascope.sources import registries as rg
from catascope.sources import sinks, tables


def test_portal_registry(spark, tmp_path):
    f = tmp_path / "portals.csv"
    f.write_text("http://data.a.org/,http://data.a.org/cat/,CKAN,GBR\nhttp://b.org/x,,Socrata,de\nhttp://data.a.org/,,CKAN,GBR\n")
    got = {r.id: r for r in po.read_portals(spark, str(f)).collect()}
    assert got["data_a_org"].apiuri == "http://data.a.org/cat/" and got["data_a_org"].iso == "GB"
    assert got["b_org_x"].apiuri == "http://b.org/x" and got["b_org_x"].iso == "DE" and len(got) == 2
    more = po.add_portal(po.read_portals(spark, str(f)), "http://c.org", "http://c.org/api", "CKAN", "AT")
    assert more.count() == 3 and po.add_portal(more, "http://c.org", "x", "CKAN", "AT").count() == 3


def pages(spark, bodies):
    return spark.createDataFrame([("p", 1601, i, json.dumps(b)) for i, b in enumerate(bodies)], "portalid string, snapshot int, page int, body string")


def test_ckan_pages_and_single_records(spark):
    listed = pages(spark, [{"result": {"results": [{"id": "a", "name": "an", "v": 1}, {"id": "b", "name": "bn"}]}}, {"result": {"results": [{"id": "a", "name": "an", "v": 2}]}}])
    singles = pages(spark, [{"result": {"id": "c", "name": "cn"}}, {"result": {"id": "b", "name": "bn"}}, {"result": {"id": "z", "name": "an"}}])
    got = {r.id: json.loads(r.raw) for r in ha.ckan_records(listed, singles).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["v"] == 1


def test_completing_moves_no_documents_for_ids(spark):
    listed = pages(spark, [{"result": {"results": [{"id": "a", "name": "an"}]}}])
    singles = pages(spark, [{"result": {"id": "c", "name": "cn"}}, {"result": {"id": "z", "name": "an"}}, {"result": {"id": "y"}}])
    ids = ha.ckan_records(listed, singles).select("portalid", "snapshot", "id")
    assert {r.id for r in ids.collect()} == {"a", "c", "y"}
    assert "raw#" not in ids._jdf.queryExecution().optimizedPlan().toString()


def test_landed_pages_share_files(spark, tmp_path):
    bodies = [json.dumps({"data": [{"id": f"d{i}", "title": 'a\nb "c" \u2028ü'}, {"id": f"d{i + 1}"}]}) for i in range(300)] + ["{", ""]
    rows = [(p, 1601, i, b) for p in ("007", "q") for i, b in enumerate(bodies)]
    listed = spark.createDataFrame(rows, "portalid string, snapshot int, page int, body string").repartition(2)
    ha.write_pages(listed, str(tmp_path / "pages"))
    again = ha.read_pages(spark, str(tmp_path / "pages"), lines=True)
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    assert len(list((tmp_path / "pages").rglob("*.json"))) <= 4
    assert ha.data_gouv_fr_records(again).count() == 602 and ha.rejected_pages(again, "DataGouvFr").count() == 4


def test_socrata_keeps_tabular_views(spark):
    listed = pages(spark, [[{"id": "a"}, {"id": "b", "viewType": "geo"}, {"viewType": "tabular"}, {"id": "c", "viewType": "tabular"}]])
    dcat = spark.createDataFrame([("p", 1601, "a", '<x a="1"/>')], "portalid string, snapshot int, id string, dcat string")
    got = {r.id: json.loads(r.raw) for r in ha.socrata_records(listed, dcat).collect()}
    assert got == {"a": {"dcat": '<x a="1"/>', "view": {"id": "a"}}, "c": {"dcat": None, "view": {"id": "c", "viewType": "tabular"}}}


def test_lookup_rows(spark):
    when = dt.datetime(2024, 1, 1)
    rows = [
        ("u2", "u1", 1601, when, 200, None, None, False, {"Content-Type": ["text/html; x"], "Content-Length": ["12"]}),
        ("v", None, 1601, when, 200, None, None, None, {}),
        ("w", None, 1601, when, 404, None, None, None, {"content-length": ["5"]}),
        ("x", None, 1601, when, None, None, None, True, None),
        ("y", None, 1601, when, None, "a.b.ReadTimeout", "slow", None, None),
    ]
    got = {r.uri: (r.status, r.mime, r["size"], r.exc) for r in lo.lookup_rows(spark.createDataFrame(rows, lo.LOOKUP)).collect()}
    assert got == {
        "u1": (200, "text/html", 12, None), "v": (200, "missing", 0, None), "w": (404, "missing", None, None),
        "x": (666, None, None, None), "y": (704, None, None, "a.b.ReadTimeout:slow"),
    }


def test_media_type_registry(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "text.csv").write_text("Name,Template,Reference\nCSV ,text/CSV,[x]\nmesh,,[y]\n")
    (tmp_path / "suffix.json").write_text('[{".csv": "text/csv"}, {".doc": "application/msword"}]')
    got = {r.token for r in rg.read_media_types(spark, str(tmp_path / "csv"), str(tmp_path / "suffix.json")).collect()}
    assert got == {"csv", "text/csv", "mesh"}


def test_new_content_once_per_hash(spark):
    rows = [(1601, "p", "a", "m1", "x"), (1601, "p", "b", "m1", "x"), (1601, "p", "c", "m2", "y"), (1601, "p", "d", None, None)]
    df = spark.createDataFrame(rows, "snapshot int, portalid string, id string, md5 string, raw string")
    stored = spark.createDataFrame([("m2",)], "md5 string")
    assert [(r.md5, r.id, r.raw) for r in tables.new_content(df, stored).collect()] == [("m1", "a", "x")]
    assert tables.new_content(df, None).count() == 2


def test_repeated_write_replaces_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "snapshot int, v string")
    tables.append(df, path)
    tables.replace_partitions(df.where("snapshot = 2").withColumn("v", F.lit("c")), path)
    assert {(r.snapshot, r.v) for r in tables.read(spark, path).collect()} == {(1, "a"), (2, "c")}
    assert tables.read(spark, str(tmp_path / "none")) is None


def test_stored_result_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.stored_or_computed(spark, str(tmp_path / "s"), compute).count() == 3
    assert calls == [1]


def test_json_rows_with_and_without_empty_fields(spark):
    df = spark.createDataFrame([("a", None)], "id string, title string")
    assert sinks.json_rows(df).first().value == '{"id":"a"}' and sinks.json_rows(df, False).first().value == '{"id":"a","title":null}'


@pytest.fixture
def csv_files(tmp_path):
    (tmp_path / "a.csv").write_text("name;when;n\n" + "".join(f'"x;{i}";2020-01-0{i % 9 + 1}T00:00:00;{i}\n' for i in range(150)))
    (tmp_path / "b.csv").write_bytes("# note\n1,\xe4\n2,b\n".encode("latin-1"))
    return str(tmp_path)


def test_csvw(spark, csv_files):
    records = cf.csv_records(spark, csv_files + "/a.csv")
    assert sorted(r.row for r in records.collect()) == list(range(151))
    got = pr.csvw(records).orderBy("pos").collect()
    assert [(r.name, r.datatype, r.delimiter, r.header) for r in got] == [
        ("name", "anyAtomicType", ";", True), ("when", "datetime", ";", True), ("n", "number", ";", True),
    ]


def test_csvw_types_need_all_lines(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(20_000)) + "x,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.name: r.datatype for r in pr.csvw(cf.csv_records(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a": "anyAtomicType", "b": "number"}


def test_csv_normalisation(spark, csv_files):
    rows = cf.normalise_csv(spark, csv_files).collect()
    b = [(r.header, r.value) for r in sorted(rows, key=lambda r: r.row) if r.file.endswith("b.csv")]
    assert b == [(True, "col1,col2"), (False, "1,ä"), (False, "2,b")]
    changes = {r.file[-5:]: set(r.modifications) for r in rows}
    assert changes == {"a.csv": {"DefaultDelimiter"}, "b.csv": {"Utf8Encoding", "DropCommentLines", "GenericHeader"}}
    assert sum(r.file.endswith("a.csv") for r in rows) == 151


def test_csv_normalisation_keeps_quoted_lines_and_long_fields(spark, tmp_path):
    import csv
    import io

    csv.field_size_limit(1 << 20)
    long = "x" * 200_000
    given = [["k", "text"], ["a", "two\n#lines"], ["b", 'say "hi", you'], ["c", ""], ["d", long], ["e", "1"]]
    text = io.StringIO()
    csv.writer(text, delimiter=";").writerows(given)
    (tmp_path / "q.csv").write_text(text.getvalue())
    rows = sorted(cf.normalise_csv(spark, str(tmp_path)).collect(), key=lambda r: r.row)
    assert [next(csv.reader(io.StringIO(r.value))) for r in rows] == given
    assert [r.header for r in rows] == [True] + [False] * 5


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def parsed(text, delimiter):
    import csv
    import io

    csv.field_size_limit(1 << 24)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and not r[0].startswith("#")]


def test_records_go_on_across_blocks(spark, tmp_path, small_blocks):
    """Quoted line ends, doubled quotes, stray quotes and comments, in blocks much smaller than a record."""
    import random

    rng, files = random.Random(3), {}
    cells = ["a", "", "7", '"x\ny"', '"say ""hi"", you"', '"#no comment"', '5" pipe', '"' + "long\n" * 60 + '"', '"p;q,r|s"', "it's"]
    for k in range(6):
        delimiter = ",;|\t"[k % 4]
        lines = [delimiter.join(("k", "text", "more"))]
        for _ in range(60):
            if rng.random() < 0.1:
                lines.append('# a "comment')
            lines.append(delimiter.join(c if delimiter not in c or c[0] == '"' else "b" for c in ("id", rng.choice(cells), rng.choice(cells))))
        files[f"f{k}.csv"] = ("\n".join(lines) + "\n", delimiter)
        (tmp_path / f"f{k}.csv").write_text(files[f"f{k}.csv"][0])
    records = cf.csv_records(spark, str(tmp_path)).where("not comment")
    fields = records.select("file", "row", cf.csv_fields(F.col("value"), F.col("delimiter")).alias("v")).collect()
    for name, (text, delimiter) in files.items():
        got = [r.v for r in sorted(fields, key=lambda r: r.row) if r.file.endswith(name)]
        assert got == parsed(text, delimiter), name
    rows = sorted(cf.normalise_csv(spark, str(tmp_path)).collect(), key=lambda r: r.row)
    for name, (text, delimiter) in files.items():
        assert [parsed(r.value, ",")[0] for r in rows if r.file.endswith(name)] == parsed(text, delimiter)


def test_many_quotes_in_a_line_and_a_quote_that_never_ends(spark, tmp_path):
    many = ",".join(['"a,""b"'] * 20_000)
    (tmp_path / "many.csv").write_text("x,y\n" + many + "\n1,2\n")
    (tmp_path / "open.csv").write_text('k,v\n1,a\n2,"b\n3,c\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.csv").write_text("# only\n# notes\n")
    rows = cf.csv_records(spark, str(tmp_path)).where("not comment")
    sizes = rows.select(F.regexp_extract("file", "([a-z]+).csv", 1).alias("f"), "row", F.size(cf.csv_fields(F.col("value"), F.col("delimiter"))).alias("n")).collect()
    assert sorted((r.row, r.n) for r in sizes if r.f == "many") == [(0, 2), (1, 20_000), (2, 2)]
    assert sorted(r.row for r in sizes if r.f == "open") == [0, 1, 2, 3] and {r.f for r in sizes} == {"many", "open"}
    assert cf.normalise_csv(spark, str(tmp_path / "empty.csv")).count() == 0


def test_column_types_of_records_with_line_ends(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note\n1,"two\nlines, 3"\n2,plain\n')
    assert {r.name: r.datatype for r in pr.csvw(cf.csv_records(spark, str(tmp_path))).collect()} == {"id": "number", "note": "anyAtomicType"}


def test_encodings(spark, tmp_path, small_blocks):
    text = "name;n\n" + "".join(f"Zoë {i};{i}\n" for i in range(60))
    given = {
        "UTF-8": text.encode(), "ISO-8859-1": text.encode("latin-1"), "Windows-1252": text.replace("name", "€ “name”").encode("cp1252"),
        "UTF-16LE": b"\xff\xfe" + text.replace("ë", "ਊ").encode("utf-16-le"), "UTF-16BE": text.encode("utf-16-be"), "UTF-8 marked": b"\xef\xbb\xbf" + text.encode(),
        "UTF-16LE broken": text.encode("utf-16-le") + b"\x00",
    }
    for name, data in given.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows = cf.csv_records(spark, str(tmp_path)).collect()
    for name in given:
        own = sorted((r.row, r.value, r.encoding) for r in rows if r.file.endswith(f"/{name.replace(' ', '%20')}.csv"))
        assert {e for _, _, e in own} == {name.split()[0]}, name
        want = text.replace("name", "€ “name”") if name == "Windows-1252" else text.replace("ë", "ਊ") if name == "UTF-16LE" else text
        assert [v for _, v, _ in own][:61] == want.splitlines(), name


def test_column_types(spark):
    cols = {"n": ["1", "2.5", ""], "b": ["yes", "no", "yes"], "d": ["2020-01-01T00:00:00", "2020-01-02T00:00:00", None], "x": ["1", "a", "b c"]}
    rows = [("f", i, c, v) for c, vs in cols.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "file string, row int, col string, value string")
    assert {r.col: r.datatype for r in pr.column_type(df).collect()} == {"n": "number", "b": "binary", "d": "datetime", "x": "anyAtomicType"}


def test_tasks_follow_the_bytes_and_types_need_no_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cf, "TASK_BYTES", 10)
    files = spark.createDataFrame([("a", 1990), ("b", 6)], "file string, size long")
    assert cf.tasks_for(files) == 200 and cf.tasks_for(files.limit(0)) == spark.sparkContext.defaultParallelism
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f"{i},n{i}\n" for i in range(250)))
    records = cf.csv_records(spark, str(tmp_path))
    assert {r.name: r.datatype for r in pr.csvw(records).collect()} == {"id": "number", "note": "anyAtomicType"}
    plan = pr.csvw(records)._jdf.queryExecution().executedPlan().toString()
    size = (tmp_path / "a.csv").stat().st_size
    assert f", {-(-size // 10)}), REPARTITION_BY_NUM" in plan
    cells = spark.createDataFrame([("f", "c", "1")], "file string, col string, value string")
    assert "SortAggregate" not in pr.column_type(cells)._jdf.queryExecution().executedPlan().toString()


def test_runs_show_rejected_pages(spark):
    pages = spark.createDataFrame([("p", 1, 0, '{"datasets":[]}'), ("p", 1, 1, '{"datasets":['), ("q", 1, 0, " "), ("r", 1, 0, None), ("s", 1, 0, '{"datasets":[{}]}')], "portalid string, snapshot int, page int, body string")
    rejects = ha.rejected_pages(pages, "OpenDataSoft")
    assert sorted((r.portalid, r.page, r.reason) for r in rejects.collect()) == [("p", 1, "not JSON"), ("q", 0, "empty"), ("r", 0, "empty")]
    runs = spark.createDataFrame([("p", 1, None), ("q", 1, "Timeout: x"), ("s", 1, None)], "portalid string, snapshot int, exc string")
    got = {r.portalid: (r.rejected, r.exc) for r in ha.runs_with_rejects(runs, rejects).collect()}
    assert got == {"p": (1, "ValueError: not JSON"), "q": (1, "Timeout: x"), "s": (0, None)}
