"""Spatial queries against SQL where stations crowd: more suppliers than the small tables have."""

import duckdb
import pytest
from conftest import DATA
from oracle import compare

from dayspell.queries import ORACLES, QUERIES, views

STEP = 25170  # to a copy's suppliers: their stations lie about a degree north of the first ones', often in the same cell


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The tables of sf 0.01 eight times, each copy with suppliers of its own."""
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    for table, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        con.execute(f"COPY (SELECT t.* REPLACE (CAST({key} + i * {STEP} AS BIGINT) AS {key}) FROM '{DATA}/sf0.01/{table}.parquet' t, range(8) r(i)) "
                    f"TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["polygon_area_mean", "sites_in_any_polygon"])
def test_matches_sql_where_stations_crowd(spark, crowded, name):
    folder, con = crowded
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) == []


def test_periods_are_combined_in_parts_that_follow_the_rows(spark, crowded):
    folder, _ = crowded
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = views.table(spark, folder, "lineitem").count()
    assert views.parts(spark, folder, rows=n) == session
    assert views.parts(spark, folder, rows=n // 40) in (40, 41)
    dealt = views.days(spark, folder, 40)
    assert dealt.exceptAll(views.days(spark, folder)).isEmpty() and dealt.rdd.getNumPartitions() == 40
