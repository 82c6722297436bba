"""Queries with SQL, against DuckDB on the same tables; and what every registered query must have."""

import duckdb
import pytest

import __spark_entry__ as entry
from catascope.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    order = [d[0] for d in cur.description]
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=str)
    assert got == sorted(cur.fetchall(), key=str) and sorted(df.columns) == sorted(order)


def test_one_query_per_operator_and_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


COLUMNS = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op2_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op4_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_mixture": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op11_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op12_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert COLUMNS[name] <= set(queries.QUERIES[name](spark, sf).columns)
