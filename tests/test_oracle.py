"""Registered queries against their SQL. CATASCOPE_ALL=1 runs every one of them."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from catascope.plans.views import TABLES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check_oracle import rows

SF = "/root/testdata/sf0.001"
SOME = [
    "week_bounds", "url_parts", "cell_type", "license_map", "format_dist", "status_dist", "format_dist_groupings", "portal_quality",
    "unfetched_resources", "top_organisations", "version_islands", "as_of_join", "content_changed", "time_map", "dynamicity", "change_list",
    "change_flags", "freshness_scores", "ckan_to_dcat", "resources_of_documents", "quality_openness", "organisation_report", "column_type",
    "sitemap", "stream_content_changed",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CATASCOPE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield c
    c.close()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert rows(df.columns, df.collect()) == rows(columns, want)
