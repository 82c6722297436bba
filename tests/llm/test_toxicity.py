import zlib

import pytest

from catascope.llm import toxicity


def auc(pairs):
    """Share of pairs of a toxic and another row in which the toxic one scores higher."""
    pos, neg = ([s for s, t in pairs if t == k] for k in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def middle(spark, sf):
    at = sf.replace("0.001", "0.1")
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_held_out_documents(middle):
    docs, labels = middle
    rows = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    own = [(rows[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    assert auc([(r["score"], t) for r, t in own]) > 0.95
    hit = sum(r["predicted"] == t for r, t in own) / len(own)
    assert hit > 0.97


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, documents, sf):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    same = lambda d, x: sorted(map(tuple, toxicity.scored(d, x).collect()))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = documents.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "features": F.lit(1), "toxic": F.lit(1), "raw": F.lit(2), "score": F.lit(3)})
    assert same(documents, labels) == same(other, turned)


def test_odd_rows(spark, odd, none, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = documents.unionByName(odd.select(*documents.columns))
    rows = toxicity.scored(both, labels).collect()
    assert len(rows) == both.count() and all(r["score"] is not None for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert toxicity.scored(none, labels).count() == 0
    unlabelled = toxicity.scored(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in unlabelled} == {(0.0, 0)} and len(unlabelled) == odd.count()
    null = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scored(odd, null).collect()} == {0.0}


def test_features_see_disguise_shouting_and_address():
    odds, starts = {"idiot": 3.0}, {"morro": 2.0}
    of = lambda t: dict(zip(toxicity.NAMES, toxicity.described(t, odds, starts)))
    assert of("you idiot!")["near_you"] == 1 and of("an idiot")["near_you"] == 0
    assert of("1d10t i.d.i.o.t idiooot")["disguised_hits"] == 3 and of("plain words")["disguised"] == 0
    assert of("LOUD words")["shouted"] == 0.5 and of("morrones")["start_hits"] == 1
    assert of(None) == of("") == of(" \n") and set(of("").values()) == {0.0}
