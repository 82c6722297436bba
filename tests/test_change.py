"""Change, windows and points in time against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catascope.operators import dynamics as dy
from catascope.operators import joins as jo
from catascope.operators import stats as sa
from catascope.operators import timetravel as tt
from catascope.operators import windows as wi


@pytest.fixture(scope="module")
def world(spark):
    """Three portals; q misses a week, r has a run without datasets."""
    rng = random.Random(3)
    weeks = {"p": [1550, 1551, 1552, 1553, 1601], "q": [1551, 1553, 1601], "r": [1550, 1551, 1552]}
    rows = []
    for portal, sns in weeks.items():
        for sn in sns:
            if portal == "r" and sn == 1551:
                continue
            for i in range(30):
                if rng.random() < 0.7:
                    rows.append((portal, f"d{i}", sn, f"c{i}-{rng.randint(0, 1)}"))
    runs = [(p, sn) for p, sns in weeks.items() for sn in sns]
    return (
        spark.createDataFrame(rows, "portalid string, id string, snapshot int, md5 string"),
        spark.createDataFrame(runs, "portalid string, snapshot int"),
        rows,
        weeks,
    )


def expected(rows, weeks):
    out = {}
    for portal, sns in weeks.items():
        past = []
        for i, sn in enumerate(sns):
            cur = {r[1]: r[3] for r in rows if r[0] == portal and r[2] == sn}
            prev = {r[1]: r[3] for r in rows if i and r[0] == portal and r[2] == sns[i - 1]}
            added = sum(d not in prev for d in cur)
            updated = sum(d in prev and prev[d] != m for d, m in cur.items())
            deleted = sum(d not in cur for d in prev)
            union = len(set(cur) | set(prev))
            past.append((added + updated + deleted) / union if union else 0.0)
            n, index = len(past), 0
            for k, e in enumerate(sorted(past, reverse=True)):
                if 100 * ((k + 1) / n) >= int(e * 100):
                    index = int(e * 100)
                    break
            out[portal, sn] = (added, deleted, updated, len(cur) - added - updated, len(cur), union, sum(x > 0 for x in past) / n, index)
    return out


def test_dynamicity(world):
    datasets, runs, rows, weeks = world
    got = {
        (r.portalid, r.snapshot): (r.added, r.deleted, r.updated, r.static, r["size"], r.union_size, r.changefrequ, r.dindex)
        for r in dy.dynamicity(datasets, runs).collect()
    }
    want = expected(rows, weeks)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:6] == w[:6] and abs(got[k][6] - w[6]) < 1e-9 and got[k][7] == w[7], k


def test_counts_add_up(world):
    datasets, runs, _, _ = world
    for r in dy.dynamicity(datasets, runs).collect():
        assert r.added + r.updated + r.static == r["size"] and r["size"] + r.deleted == r.union_size


def test_index_of_known_ratios(spark):
    cases = {(0.9, 0.5, 0.4, 0.1): 50, (0.0, 0.0): 0, (1.0,): 100}
    for ratios, want in cases.items():
        col = F.array(*[F.lit(x) for x in ratios])
        assert spark.range(1).select(dy.index_of(col)).first()[0] == want


def test_previous_value_with_a_hot_key(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        uri = "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 40)}"
        when = start + dt.timedelta(seconds=rng.randint(0, 3_000))
        status = rng.choice([200, 200, 404])
        rows.append((uri, when, i, status, f"c{rng.randint(0, 2)}" if status == 200 else None))
    df = spark.createDataFrame(rows, "uri string, timestamp timestamp, event_id bigint, status int, digest string")
    got = {r.event_id: r.contentchanged for r in wi.content_changed(df).collect()}
    last, want = {}, {}
    for uri, _, i, status, digest in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = -1 if status != 200 else int(last.get(uri) != digest)
        if status == 200:
            last[uri] = digest
    assert got == want


def test_a_hot_key_lies_in_many_partitions(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    parts = wi.ranged(rows, ["k"], ["id"]).groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == "hot").alias("hot")).collect()
    assert sum(p.n for p in parts) == 9000 and sum(p.hot > 0 for p in parts) > 1
    assert max(p.hot for p in parts) < 3000


def test_numbers_are_dense_within_a_hot_domain(spark):
    uris = [(f"http://{'hot' if i % 3 else f'd{i % 20}'}.org/{i}",) for i in range(2000)]
    rows = wi.crawl_waves(spark.createDataFrame(uris, "uri string"), delay_seconds=5)
    for r in rows.groupBy("domain").agg(F.sort_array(F.collect_list("wave")).alias("w")).collect():
        assert r.w == list(range(1, len(r.w) + 1))
    assert rows.where("earliest_start <> (wave - 1) * 5").count() == 0


def test_as_of_join(spark):
    rng = random.Random(11)
    versions = sorted({("p", f"d{rng.randint(0, 5)}", rng.randint(1, 50)) for _ in range(60)})
    have = [(p, d, s, f"{d}@{s}") for p, d, s in versions]
    asked = [(i, "p", "d0" if i % 3 == 0 else f"d{rng.randint(0, 7)}", rng.randint(0, 55)) for i in range(300)]
    v = spark.createDataFrame(have, "portalid string, id string, snapshot int, md5 string")
    q = spark.createDataFrame(asked, "no int, portalid string, id string, snapshot int")
    got = {r.no: (r.found, r.md5) for r in tt.as_of_join(q, v).collect()}
    want = {}
    for no, _, d, s in asked:
        older = [x for x in have if x[1] == d and x[2] <= s]
        if older:
            want[no] = (older[-1][2], older[-1][3])
    assert got == want and all(f <= next(a[3] for a in asked if a[0] == n) for n, (f, _) in got.items())


def test_top_n_with_rest(spark):
    rows = [("p", 1, v, c) for v, c in [("a", 5), ("b", 3), (None, 3), ("c", 1), ("d", 1)]] + [("q", 1, "a", 2)]
    dist = spark.createDataFrame(rows, "portalid string, snapshot int, license string, count bigint")
    got = {(r.portalid, r.value): (r["count"], round(r.perc, 3), r.distinct_values) for r in sa.top_n(dist, "license").collect()}
    assert got == {
        ("p", "a"): (5, 0.385, 5), ("p", "b"): (3, 0.231, 5), ("p", "missing"): (3, 0.231, 5), ("p", "Others"): (2, 0.154, 5), ("q", "a"): (2, 1.0, 1),
    }


def test_weighted_counts_equal_the_plain_join(spark):
    rng = random.Random(2)
    ds = spark.createDataFrame([("p", 1, f"d{i}", "hot" if rng.random() < 0.4 else f"m{i % 9}") for i in range(500)], "portalid string, snapshot int, id string, md5 string")
    mr = spark.createDataFrame([(f"u{i}", rng.choice(["hot"] + [f"m{k}" for k in range(9)]), rng.choice(["csv", None, "pdf"])) for i in range(80)], "uri string, md5 string, format string")
    plain = {(r.format, r["count"]) for r in ds.join(mr, "md5").groupBy("format").count().collect()}
    assert {(r.format, r["count"]) for r in sa.format_dist(ds, mr, ("snapshot",)).collect()} == plain


def test_version_that_returns(spark):
    rows = [("p", "d", s, m) for s, m in [(1, "a"), (2, "a"), (3, "b"), (4, "a")]]
    df = spark.createDataFrame(rows, "portalid string, id string, snapshot int, md5 string")
    got = [(r.version, r.md5, r.sn_min, r.sn_max) for r in sa.version_islands(df).orderBy("version").collect()]
    assert got == [(1, "a", 1, 2), (2, "b", 3, 3), (3, "a", 4, 4)]


def test_snapshot_pairs_with_empty_documents(spark):
    rows = [("p", "a", 1, None), ("p", "a", 2, None), ("p", "b", 2, None), ("p", "c", 1, None), ("p", "d", 1, None), ("p", "d", 2, "x"), ("p", "e", 1, "x"), ("p", "e", 2, None), ("p", "f", 1, "y"), ("p", "f", 2, "y")]
    df = spark.createDataFrame(rows, "portalid string, id string, snapshot int, md5 string")
    got = {r.id: r.change for r in jo.snapshot_pairs(df, 2, 1).collect()}
    assert got == {"a": "static", "b": "added", "c": "deleted", "d": "updated", "e": "updated", "f": "static"}
