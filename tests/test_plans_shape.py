"""Physical plans: no cross joins, one layout by unit, partial aggregation, skewed keys."""

import datetime as dt

import pytest
from conftest import DATA, plan_text, rows
from pyspark.sql import functions as F

from dayspell.operators import coverage, gridding, qc, records, spatial, spells
from dayspell.plans import heat
from dayspell.plans import records as plans
from dayspell.queries import QUERIES

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_collected_rows(spark, name):
    text = plan_text(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def _season(spark):
    return spark.createDataFrame([], "unit long, year int, doy int, day date, value double")


def test_heat_waves_need_one_shuffle(spark):
    text = plan_text(spells.heatwave_counts(_season(spark)))
    assert text.count("Exchange hashpartitioning(unit") == 1 and text.count("Exchange ") == 1


def test_the_lossless_screen_costs_no_shuffle(spark):
    screened = coverage.lossless_screen(_season(spark))
    assert plan_text(spells.heatwave_counts(screened, laid_out=True)).count("Exchange ") == 1


def test_records_need_one_shuffle(spark):
    text = plan_text(records.unit_record_counts(_season(spark)))
    assert text.count("Exchange ") == 1
    assert plan_text(plans.complete_unit_counts(_season(spark))).count("Exchange ") == 1


def test_first_row_uses_a_partial_hash_aggregate(spark):
    obs = spark.createDataFrame([], "unit long, day date, elem string, value int, qflag string, ord long")
    text = plan_text(qc.daily_panel(obs))
    assert "partial_min_by" in text and "SortAggregate" not in text and text.count("Exchange ") == 1


def test_nearest_ranks_are_cut_before_the_shuffle(spark):
    pairs = spark.createDataFrame([], "cell long, unit long, km double")
    values = spark.createDataFrame([], "unit long, year int, month int, value double")
    assert "WindowGroupLimit" in plan_text(gridding.nearest_idw(values, pairs)) and "Partial" in plan_text(
        gridding.nearest_idw(values, pairs))


def test_scan_reads_only_needed_columns(spark):
    text = plan_text(QUERIES["record_counts_by_unit"](spark, SF))
    assert "l_extendedprice" not in text and "l_tax" not in text


def test_a_third_of_all_rows_on_one_key(spark):
    """One station-day holds a third of the raw rows; the panel and records do not change."""
    n = 60_000
    base = spark.range(n).select(
        (F.col("id") % 20).alias("unit"), F.expr("date_add(DATE'2000-05-01', cast(id / 20 % 153 AS int))").alias("day"),
        F.lit("TMAX").alias("elem"), (F.col("id") * 7 % 400).cast("int").alias("value"), F.lit("").alias("qflag"),
        F.col("id").alias("ord"))
    hot = spark.range(n // 2).select(
        F.lit(3).cast("long").alias("unit"), F.lit(dt.date(2000, 6, 1)).alias("day"), F.lit("TMAX").alias("elem"),
        F.lit(999).alias("value"), F.lit("").alias("qflag"), (F.col("id") + n).alias("ord"))
    plain = rows(qc.daily_panel(base), "unit", "day")
    skewed = rows(qc.daily_panel(base.unionByName(hot)), "unit", "day")
    assert plain == skewed and len(plain) == 20 * 153


def test_a_crowded_bucket_keeps_every_pair(spark):
    """A third of all stations share one place; dealing it in parts changes nothing."""
    crowd = spark.range(3000).select(
        F.col("id").alias("unit"),
        F.when(F.col("id") < 1000, 40.0).otherwise(25.0 + F.col("id") % 240 / 10.0).alias("lat"),
        F.when(F.col("id") < 1000, -100.0).otherwise(-124.0 + F.col("id") % 570 / 10.0).alias("lon"))
    cells = spatial.two_degree_band().cells(spark)
    sizes = {s: spatial.near_pairs(cells, crowd, 150.0, per_task=s).agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("cell", "unit").cast("decimal(38,0)")).alias("h")).first() for s in (10_000, 150)}
    assert sizes[10_000] == sizes[150] and sizes[150]["n"] > 1000
    # k nearest from the crowd: ties on distance go to the smallest station
    values = crowd.select("unit", F.lit(2000).alias("year"), F.lit(1).alias("month"), F.col("unit").cast("double").alias("value"))
    near = spatial.near_pairs(cells, crowd, 150.0)
    out = {r["cell"]: r for r in rows(gridding.nearest_idw(values, near, k=8))}
    assert max(r["n_stations"] for r in out.values()) == 8


def test_a_crowded_network_is_summed_per_source_cell(spark):
    """A third of the stations share one cell; summed weights equal one pseudo station each."""
    grid = spatial.Grid(25.0, 2.0, 13, -124.0, 2.0, 30)
    cells = grid.cells(spark).select("cell", "lat", "lon")
    st = spark.range(600).select(
        F.col("id").alias("unit"), F.when(F.col("id") < 200, 39.0 + F.col("id") % 9 / 10).otherwise(25.0 + F.col("id") % 240 / 10.0).alias("lat"),
        F.when(F.col("id") < 200, -100.0 + F.col("id") % 7 / 10).otherwise(-124.0 + F.col("id") % 580 / 10.0).alias("lon"))
    counts = cells.select("cell", F.explode(F.sequence(F.lit(2000), F.lit(2002))).alias("year")).withColumn(
        "hw_days", F.when((F.col("cell") + F.col("year")) % 7 != 0, (F.col("cell") * 3 + F.col("year")) % 29))
    a = heat.reduce_at_network(counts, st, grid, cells, 150.0)
    b = heat.reduce_stations(heat.counts_at_network(counts, st, grid), st, cells, 150.0)
    for x, y in ((a.field, b.field), (a.series, b.series), (a.fixed_series, b.fixed_series)):
        left, right = (rows(t, *[c for c in ("cell", "year") if c in t.columns]) for t in (x, y))
        assert len(left) == len(right) > 0
        assert all(p["hw_days"] == pytest.approx(q["hw_days"]) and p.get("n_stations") == q.get("n_stations")
                   for p, q in zip(left, right))
