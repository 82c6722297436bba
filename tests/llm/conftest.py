import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the operators' own names, and of names they use inside.
EXTRA = ["key", "fp", "size", "shard", "slot", "tile", "language", "start", "bucket", "digest", "root", "count", "n", "features"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "Hello hello HELLO", "en", "a", 17),
        (4, "hello hello hello", "EN-gb", "b", 17),
        (4, "hello hello hello", "EN-gb", "b", 17),
        (None, "hello hello hello", None, "b", 17),
        (None, None, None, None, None),
        (5, long, "en", "a", len(long)),
        (6, long, "en", "ä", len(long)),
        (7, "x" * 5000, "de", "b", 5000),
        (8, "Été à l'ÉCOLE   \t\n ", "fr", "b", 20),
        (9, " \n\t ", "fr", None, 4),
        (10, "one two", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
