import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catascope.llm import decontamination as deco


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def shingles(ws, k):
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both)


def plain(docs, items, least=0.8):
    """The best similarity over all windows of an item's size, for each document and item."""
    out = {}
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            own = words(item)
            if not own:
                continue
            k = min(5, len(own))
            a, b = shingles(ws, k), shingles(own, k)
            m = min(len(a), len(b))
            best = max((jaccard(a[s : s + m], b) for s in range(len(a) - m + 1)), default=0) if m else 0
            if best >= least - 1e-9:
                out[d, i] = round(best, 9)
    return out


def found(docs, items):
    rows = deco.contaminated(docs, items).collect()
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows}
    return got, rows


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_documents(documents, benchmark):
    got, rows = found(documents, benchmark)
    assert len(got) == len(rows) > 0
    assert got == plain([(r["doc_id"], r["text"]) for r in documents.collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])


def test_edited_passages(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)] + ["die", "été"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([4, 5, 6, 9, 12, 30, 36, 36, 60, 300])] + [(10, ["a", "b"] * 20), (11, []), (12, ["solo"])]
    docs = []
    for d in range(150):
        i, own = items[d % len(items)]
        own = list(own)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if own:
                at = rnd.randrange(len(own))
                own[at : at + rnd.randrange(2)] = say(rnd.randrange(2))
        docs.append((d, " , ".join(say(rnd.randrange(20)) + own + say(rnd.randrange(20))).title()))
    docs += [(500, " ".join(items[5][1][:-3])), (501, " ".join(items[9][1] * 2)), (502, None), (503, "")]
    items = [(i, " ".join(w).upper() + "!") for i, w in items] + [(13, None)]
    got, _ = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain(docs, items) and len({i for _, i in got}) >= 11


def test_items_that_share_an_id_or_have_none(spark):
    rnd = random.Random(8)
    say = lambda n: [f"w{rnd.randrange(10_000)}" for _ in range(n)]
    docs, items, want = [], [], {}
    for i in range(60):
        own = say(80)
        near = own[:-12] + say(12)
        items += [(i if i % 3 else None, " ".join(x)) for x in rnd.sample([own, near], 2)]
        docs.append((i, " ".join(say(10) + own + say(10))))
    items += [(7, items[0][1]), (7, items[0][1])]  # one text under two ids
    for d, i, s in ((d, i, s) for d, t in docs for i, s in plain([(d, t)], [(k, x[1]) for k, x in enumerate(items)]).items()):
        key = d, items[i[1]][0]
        want[key] = max(want.get(key, 0), s)
    got, rows = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == want and len(rows) == len(want) >= 60


def test_a_shingle_that_is_everywhere(spark):
    line = "this very line is in all of them"
    docs = [(i, f"{line} " + " ".join(f"d{i}x{k}" for k in range(30))) for i in range(300)]
    items = [(i, f"{line} " + " ".join(f"i{i}x{k}" for k in range(20))) for i in range(50)]
    docs += [(1000 + i, f"before {items[i][1]} after") for i in range(10)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(d, b)[0] == plain(docs, items)
    own = deco.items_of(b).cache()
    spans = deco.windows(deco.shared_places(d, own, [5]), own, 0.8)
    assert spans.select("item", "key").distinct().count() == 10  # the line alone makes no window


def test_odd_rows(spark, odd, none, benchmark):
    item = spark.createDataFrame([(1, "hello hello hello"), (2, None), (3, "")], "item_id long, text string").withColumn("n", F.lit(1))
    got = deco.contaminated(odd, item)
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [3, 4, 4, None]
    kept = deco.clean(odd, item)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert deco.contaminated(none, benchmark).count() == 0 and deco.clean(none, benchmark).count() == 0
    empty = benchmark.limit(0)
    assert deco.contaminated(odd, empty).count() == 0 and deco.clean(odd, empty).count() == odd.count()


def test_probes_reach_the_radius():
    """Any two fingerprints within the radius have a block within the masks."""
    rnd = random.Random(4)
    for _ in range(2000):
        x = sum(1 << b for b in rnd.sample(range(64), deco.RADIUS))
        assert any((x >> 8 * i & 255) in deco.MASKS for i in range(deco.BLOCKS))


def test_plan_has_no_python(documents, benchmark):
    text = deco.contaminated(documents, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "NestedLoop" not in text
