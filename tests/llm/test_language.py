from pyspark.sql import functions as F

from catascope.llm import language

FOUND = ["language", "probability", "accepted"]


def test_languages_of_documents(documents):
    rows = language.identified(language.of_documents(documents)).collect()
    right = sum(r["language"] == r["lang"] for r in rows) / len(rows)
    assert len(rows) == documents.count() and right > 0.97 and all(r["accepted"] for r in rows)


def test_text_alone_finds_the_language_of_texts_not_fitted_on(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fitted(docs.where("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    rest = docs.where("doc_id % 2 = 1 and length(text) > 200")
    rows = language.judged(rest, model, rest["text"], none, none, none, none).select("lang", "__language").collect()
    assert sum(a == b for a, b in rows) / len(rows) > 0.97


def test_odd_rows(odd, none):
    found = language.of_documents(odd)
    rows = language.identified(found).collect()
    assert len(rows) == odd.count()
    assert {r["text"] for r in rows if not r["accepted"]} >= {None, "", " \n\t "}
    assert [r for r in rows if r["text"] is None][0]["language"] == "und"
    assert sorted(c for c in language.identified(found).columns) == sorted({*odd.columns, *FOUND})
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and {r["language"] for r in kept.collect()} == {"language"}
    assert language.of_documents(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language.of_documents(unlabelled).where("__accepted").count() == 0


def test_weak_texts_follow_declaration_address_and_host(spark):
    """A text that says nothing takes the language of the other evidence, each kind by itself."""
    import numpy as np

    model = (["de", "en"], np.zeros((language.FEATURES, 3), dtype=np.float32))
    rows = [(0, "zz", "de-AT", None, "h0"), (1, "zz", "EN", None, "h0"), (2, "zz", None, "at", "h0"), (3, "zz", None, "uk", None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    flat = lambda: language.judged(df, (model[0], model[1] - 5), df["text"], df["declared"], df["suffix"], F.lit(None).cast("string"), df["host"])
    assert [r["__language"] for r in flat().orderBy("id").collect()] == ["de", "en", "de", "en"]


def test_host_priors_are_smoothed_towards_their_domain(spark):
    rows = [("d", "big", [0.9, 0.1, 0.0])] * 400 + [("d", "small", [0.0, 1.0, 0.0]), ("e", "far", [0.0, 1.0, 0.0])] + [(None, None, [0.0, 1.0, 0.0])] * 30
    df = spark.createDataFrame(rows, "__domain string, __host string, __p array<double>")
    got = {r["__host"]: [2.718281828459045**x for x in r["__prior"]] for r in language.priors(df, 3).collect()}
    assert all(abs(sum(p) - 1) < 1e-6 for p in got.values())
    assert got["big"][0] > got["small"][0] > got["far"][0]  # the domain's share pulls the small host, only the corpus's the far one
    assert got["small"][1] > 1 - got["big"][0] and got[None][1] > 0.5


def test_pages(spark, sf, documents):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = language.identified(language.of_pages(pages, documents)).collect()
    declared = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    want = {r[0]: r[1] for r in pages.select("page_id", declared).collect()}
    assert sum(r["language"] == want[r["page_id"]] for r in rows) / len(rows) > 0.9
    odd = spark.createDataFrame([(1, None, None), (2, "", "<html lang=xx>"), (2, "http://", "&amp;<script>a b c</script>"), (None, "ftp://h.de:80/x", "<p>x")], "page_id long, url string, html string")
    assert language.of_pages(odd, documents).count() == 4
