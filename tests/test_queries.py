"""Every named query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import compare

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(TABLES)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, TABLES)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        assert compare.difference(df, con, sql) is None


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["c8_quake_maps", "enrich_by_url", "enrich_by_url_envelope"])
def test_pages_of_one_url(spark, tmp_path, name):
    """Several pages may have one URL and different text."""
    for t in compare.TABLES:
        if t != "pages":
            os.symlink(f"{TABLES}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = compare.connect(TABLES)
    con.execute(f"COPY (SELECT * REPLACE ('http://a/' || page_id // 2 AS url) FROM pages) TO '{tmp_path}/pages.parquet'")
    assert compare.difference(entry.queries()[name](spark, str(tmp_path)), compare.connect(tmp_path), entry.oracle_sql()[name]) is None
