from collections import Counter

import pytest
from test_decontamination import plain as plain_leaks
from test_simhash import plain_similar

import corpus_pipeline
from catascope.llm import mixing
from catascope.llm.common import stored, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "stage-test"))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_against_its_own_input(spark, sf, stages):
    docs, known, single, clean, mix, last = stages
    assert all(df.columns == docs.columns for df in (known, single, clean, mix))
    assert ids(known) == ids(docs)  # all test documents are in a known language
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert ids(single) == Counter(i for i, c in plain_similar(rows) if i == c)
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    leaks = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in single.collect()], items)}
    assert leaks and ids(clean) == Counter(i for i in ids(single) if i not in leaks)
    want = ids(mixing.mixed_documents(clean))
    assert ids(mix) == want and set(want) <= set(ids(clean))
    assert ids(last) == want and set(last.columns) == {*docs.columns, "shard", "slot"}


def test_run_gives_the_rows_of_the_last_stage(spark, sf, stages):
    key = lambda df: Counter((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_stages_take_odd_and_empty_tables(spark, sf, odd, none):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
