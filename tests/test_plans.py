"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from catascope.operators import freshness as fr
from catascope.plans import registry
from catascope.plans.views import Catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return entry.queries()


NO_PYTHON = ["quality_existence", "quality_conformance", "quality_openness", "format_dist", "status_dist", "dynamicity", "content_changed", "freshness_scores", "ckan_to_dcat"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_products(spark, queries, name):
    text = plan(queries[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_quality_does_not_shuffle_stored_documents(spark, tmp_path):
    from catascope.operators import quality as qu
    from catascope.plans import rawdocs
    from catascope.operators import mapping as ma

    path = str(tmp_path / "silver")
    ma.ckan(rawdocs.records(Catalogue(spark, SF), "CKAN")).write.parquet(path)
    text = plan(qu.quality(spark.read.parquet(path)))
    assert "Exchange" not in text


def test_scores_shuffle_observations_once(spark):
    text = plan(fr.scores(spark.createDataFrame([], "uri string, md5 string, source string, snapshot int, modified date"), 2401))
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 2


def test_scans_read_only_the_columns_used(spark, queries):
    text = plan(queries["format_dist"](spark, SF))
    pages = [s for s in re.findall(r"ReadSchema: struct<[^>]*>", text) if "page_id" in s]
    assert pages and all("html" not in s for s in pages)


def test_every_sql_has_a_query():
    registry.load()
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["snapshot", "format", "count"] and df.count() > 0


def test_point_reads_open_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from catascope.sources import clustered

    rows = spark.range(20_000).select(F.concat(F.lit("u"), F.lpad((F.col("id") % 997).cast("string"), 4, "0")).alias("uri"), "id")
    hot = spark.range(10_000).select(F.lit("u0500").alias("uri"), "id")
    path = str(tmp_path / "log")
    clustered.write_clustered(rows.unionByName(hot), path, ["uri", "id"], files=20)
    found = clustered.read_key(spark, path, "uri", "u0003")
    assert found.count() == 21 and len(found.inputFiles()) <= 2
    assert "PushedFilters: [IsNotNull(uri), EqualTo(uri,u0003)]" in plan(found)
    assert clustered.read_key(spark, path, "uri", "u0500").count() == 10_020
    assert clustered.read_key(spark, path, "uri", "v").count() == 0


def test_records_are_not_aggregated_as_texts(spark):
    from catascope.plans import rawdocs
    from catascope.session import staged
    from catascope.sources import harvest as ha

    pages = staged(rawdocs.pages(Catalogue(spark, SF), "OpenDataSoft"), "pages")
    assert "SortAggregate" not in plan(ha.opendatasoft_records(pages))
