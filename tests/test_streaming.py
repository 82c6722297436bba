"""A stream over many small files must end with the rows of the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catascope.operators.windows import content_changed
from catascope.session import scratch
from catascope.sources import folders
from catascope.streaming import crawllog as cl
from catascope.streaming import tiers


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Results in order of time, six files, one uri with nearly half of them."""
    rng, start, rows = random.Random(9), dt.datetime(2024, 1, 1), []
    for i in range(1200):
        uri = "http://hot.org/x" if rng.random() < 0.4 else f"http://d{rng.randint(0, 5)}.org/{rng.randint(0, 30)}"
        status = rng.choice([200, 200, 404])
        when = start + dt.timedelta(minutes=7 * i)
        y, w, _ = when.isocalendar()
        rows.append((uri, (y % 100) * 100 + w, when, status, f"c{rng.randint(0, 2)}" if status == 200 else None, uri.split("/")[2], f"loc{i}", i))
    path = str(tmp_path_factory.mktemp("log"))
    for k in range(6):
        part = spark.createDataFrame(rows[k * 200 : (k + 1) * 200], cl.LOG)
        part.coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, cl.LOG)


def stream(spark, path):
    return cl.read_log(spark, path, max_files=1)


def test_changed_flags(spark, log):
    path, batch = log
    out = scratch(spark, "flags")
    query = cl.changed_flags(stream(spark, path), out)
    query.awaitTermination()
    assert len(query.recentProgress) >= 6
    got = {r.event_id: r.contentchanged for r in spark.read.parquet(out + "/data").collect()}
    want = {r.event_id: r.contentchanged for r in content_changed(batch).collect()}
    assert got == want


def test_status_counts(spark, log):
    path, batch = log
    out = scratch(spark, "counts")
    cl.status_counts(stream(spark, path), out).awaitTermination()
    got = {tuple(r) for r in cl.counts(spark, out, ["window_start", "domain", "status"]).collect()}
    want = batch.groupBy(F.date_trunc("hour", "timestamp").alias("w"), "domain", "status").count()
    assert got == {tuple(r) for r in want.collect()}


def test_first_results(spark, log):
    path, batch = log
    out = scratch(spark, "first")
    cl.first_results(stream(spark, path), out).awaitTermination()
    got = sorted((r.uri, r.snapshot, r.event_id) for r in cl.firsts(spark, out).collect())
    want = {}
    for r in sorted(batch.collect(), key=lambda r: r.event_id):
        want.setdefault((r.uri, r.snapshot), r.event_id)
    assert got == sorted((*k, v) for k, v in want.items())


def test_results_of_files_in_any_order_all_count(spark, log, tmp_path):
    """Files with the latest results first: the others come weeks late."""
    _, batch = log
    path = str(tmp_path / "shuffled")
    for k in (4, 1, 5, 0, 3, 2):
        batch.where(f"event_id div 200 = {k}").coalesce(1).write.mode("append").parquet(path)
    counted, first = scratch(spark, "counts"), scratch(spark, "first")
    cl.status_counts(stream(spark, path), counted).awaitTermination()
    cl.first_results(stream(spark, path), first).awaitTermination()
    assert cl.counts(spark, counted, ["window_start"]).agg(F.sum("count")).first()[0] == batch.count()
    want = {(r.uri, r.snapshot): r.e for r in batch.groupBy("uri", "snapshot").agg(F.min("event_id").alias("e")).collect()}
    assert {(r.uri, r.snapshot): r.event_id for r in cl.firsts(spark, first).collect()} == want


def test_rates_since_start(spark, log):
    path, batch = log
    out = scratch(spark, "rates")
    cl.crawl_rate(stream(spark, path), out).awaitTermination()
    rows = sorted(cl.rates_since_start(cl.rates(spark, out)).collect(), key=lambda r: r.window_start)
    total = 0
    for r in rows:
        total += r["count"]
        seconds = (r.window_start - rows[0].window_start).total_seconds() + 3600
        assert r.total == total and abs(r.per_second_since_start - total / seconds) < 1e-12
    assert total == batch.count()


def test_ingest_is_partitioned(spark, log):
    path, batch = log
    out = scratch(spark, "ingest")
    cl.ingest(stream(spark, path), out).awaitTermination()
    rows = spark.read.parquet(out + "/data")
    assert rows.count() == batch.count()
    plan = rows.where("snapshot = 2401")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan


def test_tiers_have_few_folders_and_count_batches_once(spark, tmp_path):
    path = str(tmp_path / "tiers")
    merge = lambda rows: rows.groupBy("k").agg(F.sum("count").alias("count"))
    batch = lambda n: spark.createDataFrame([(n % 3, 1), (9, n)], "k int, count long").coalesce(1)
    for n in range(23):
        tiers.add(path, n, batch(n), merge, fan=3)
        tiers.add(path, n, batch(n), merge, fan=3)  # the batch comes again
        assert len(tiers.live(spark, path, 3)) <= 2 * 3
    assert tiers.live(spark, path, 3) == [(2, 0), (2, 1), (1, 6), (0, 21), (0, 22)]
    got = {r["k"]: r["n"] for r in tiers.read(spark, path, fan=3).groupBy("k").agg(F.sum("count").alias("n")).collect()}
    assert got == {0: 8, 1: 8, 2: 7, 9: sum(range(23))}
    # a folder whose job did not end does not count, and one that a merged folder covers neither
    batch(0).write.parquet(path + "/level=0/at=3")
    batch(0).write.parquet(path + "/level=0/at=23")
    folders.remove(spark, path + "/level=0/at=23/_SUCCESS")
    assert tiers.live(spark, path, 3) == [(2, 0), (2, 1), (1, 6), (0, 21), (0, 22)]
    tiers.add(path, 23, batch(23), merge, fan=3)
    assert tiers.live(spark, path, 3) == [(2, 0), (2, 1), (1, 6), (1, 7)]


def test_state_of_other_uris_is_not_written_again(spark, log, tmp_path):
    path, batch = log
    first, second = str(tmp_path / "log"), scratch(spark, "buckets")
    batch.where("event_id < 600").coalesce(1).write.parquet(first)
    cl.changed_flags(cl.read_log(spark, first), second).awaitTermination()
    batch.where("event_id >= 600 and uri = 'http://hot.org/x'").coalesce(1).write.mode("append").parquet(first)
    cl.changed_flags(cl.read_log(spark, first), second).awaitTermination()
    state = second + "/state/level=0/at="
    assert len(folders.names(spark, state + "0")) > 10
    assert [n for n in folders.names(spark, state + "1")] == [r["b"] for r in batch.where("uri = 'http://hot.org/x'").select(F.concat(F.lit("bucket="), cl._bucket()).alias("b")).distinct().collect()]
    rows = batch.where("event_id < 600 or uri = 'http://hot.org/x'")
    got = {r.event_id: r.contentchanged for r in spark.read.parquet(second + "/data").collect()}
    assert got == {r.event_id: r.contentchanged for r in content_changed(rows).collect()}
