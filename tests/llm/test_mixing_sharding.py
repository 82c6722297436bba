import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from catascope.llm import mixing, sharding


def plain_targets(sizes, weights):
    """Reshare what is above the limits until nothing is."""
    total, target, capped = 1.5 * sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(2 * sizes[i] for i in capped)
        target = [2.0 * sizes[i] if i in capped else rest * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        over = {i for i in free if target[i] > 2 * sizes[i]}
        if not over:
            return target
        capped |= over


def test_targets():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 20):
        sizes = rng.integers(0, 10_000, n).tolist()
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        if sum(sizes):
            assert np.allclose(mixing.targets(sizes, weights), plain_targets(sizes, weights))
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_quotas_split_every_block_once():
    blocks = np.array([1000, 3, 0, 57, 1])
    q = mixing.quotas(blocks, 16)
    assert (q.sum(0) == blocks).all() and q.sum(1).max() - q.sum(1).min() <= 4
    assert (mixing.quotas(blocks, 16) == q).all()
    assert mixing.quotas(np.array([5]), 3).sum() == 5


def check_mixture(df):
    rows = mixing.mixed(df, block_words=64).collect()
    docs = df.collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter((r["doc_id"], r["source"]) for r in docs)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    taken, blocks = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["pieces"])
        taken[r["source"]] += r["taken"]
        for p in r["pieces"]:
            assert 0 <= p["shard"] < 16 and 0 < p["words"] <= 64
            blocks[r["source"], p["block"], p["shard"]] += p["words"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert all(n <= 64 for n in blocks.values())
    assert len({k[:2] for k in blocks}) == len(blocks)  # no block in two shards
    per = Counter()
    for (_, _, shard), n in blocks.items():
        per[shard] += n
    return rows, per


def test_mixture_of_documents(documents, odd, none):
    rows, per = check_mixture(documents)
    assert max(per.values()) < 1.3 * min(per.values())
    again = mixing.mixed(documents.repartition(5), block_words=64).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"], str(r["pieces"])) for r in rs)
    assert key(rows) == key(again)
    check_mixture(odd)
    assert mixing.mixed(none).count() == 0


def test_whole_documents_near_targets(documents, odd, none):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    size = {r["doc_id"]: len(r["text"].split()) for r in documents.collect()}
    copies = Counter(r["doc_id"] for r in out.collect())
    assert max(copies.values()) <= 2
    target = {r["source"]: r["target"] for r in mixing.mixed(documents).select("source", "target").collect()}
    got, largest = defaultdict(int), defaultdict(int)
    for r in documents.collect():
        got[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    assert all(abs(got[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0


def test_the_tree_deals_shards_and_places(documents, odd, none):
    def rows_of(seed):
        return mixing.dealt(mixing.mixed(documents, block_words=64, seed=seed), seed).collect()

    rows = rows_of(mixing.SEED)
    places = defaultdict(list)
    for r in rows:
        assert (r["shard"] is None) == (r["taken"] == 0) == (r["place"] is None)
        if r["taken"]:
            places[r["shard"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and len(places) == 16
    other = {r["doc_id"]: r["shard"] for r in rows_of(7)}
    assert sum(other[r["doc_id"]] != r["shard"] for r in rows) > len(rows) / 2
    assert {r["doc_id"]: (r["shard"], r["place"]) for r in rows} == {r["doc_id"]: (r["shard"], r["place"]) for r in rows_of(mixing.SEED)}
    assert mixing.dealt(mixing.mixed(odd)).count() == odd.count() and mixing.dealt(mixing.mixed(none)).count() == 0


def test_documents_lie_in_the_order_of_their_shards(documents):
    out = mixing.mixed_documents(documents)
    want = {}
    placed = mixing.mixed(documents)
    for r in placed.select("doc_id", F.explode(mixing.copies(mixing.SEED)).alias("c")).select("doc_id", "c.*").collect():
        want.setdefault(r["doc_id"], []).append((r["shard"], r["order"]))
    got = out.select("doc_id", F.spark_partition_id().alias("p")).collect()
    runs = defaultdict(list)
    for r in got:
        runs[r["p"]].append(r["doc_id"])
    for ids in runs.values():  # a partition's rows can be read as rising (shard, order)
        last = (-1, 0)
        for i in ids:
            last = min(x for x in want[i] if x >= last)


def check_shards(df):
    rows = sharding.assignment(df).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_shards(documents, odd, none):
    rows = check_shards(documents)
    check_shards(odd)
    assert sharding.assignment(none).count() == 0
    again = sharding.assignment(documents.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_many_buckets_keep_rows_and_columns(documents, odd, none):
    for df in (documents, odd):
        out = sharding.sharded(df, bucket_bytes=2000)
        assert set(out.columns) == {*df.columns, "shard", "slot"}
        body = [c for c in df.columns if c not in ("shard", "slot")]
        assert Counter(map(str, out.select(*body).collect())) == Counter(map(str, df.select(*body).collect()))
        counts = [r["count"] for r in out.groupBy("shard").agg(F.count("*").alias("count")).collect()]
        assert max(counts) - min(counts) <= 1
        assert out.groupBy("shard").agg((F.max("slot") - F.count("*")).alias("d")).where("d != -1").count() == 0
    assert sharding.sharded(none).count() == 0


def test_order_is_shuffled(documents):
    rows = sharding.sharded(documents).select("doc_id", (F.col("slot") * 16 + F.col("shard")).alias("at")).collect()
    ids, at = zip(*rows)
    assert abs(np.corrcoef(ids, at)[0, 1]) < 0.3


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 16
