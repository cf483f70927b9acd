"""Cases that earlier SQL twins could not see."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_text, rows
from dayspell.functions.student import _beta_fraction
from dayspell.operators import anomaly, records, spatial
from dayspell.plans import records as record_plans
from dayspell.sources import fields, stations


def _square(poly, ring, corners):
    return [(poly, ring, i, float(x), float(y)) for i, (x, y) in enumerate(corners)]


def _edges(spark, vertices, hole=None):
    df = spark.createDataFrame(vertices, "poly int, ring int, seq int, lon double, lat double")
    return spatial.polygon_edges(df if hole is None else df.withColumn("hole", F.col("ring") == hole))


def test_halves_drawn_in_opposite_directions_add_up(spark):
    grid = spatial.Grid(0.5, 1.0, 1, 0.5, 1.0, 1)
    left, right = [(0, 0), (0.5, 0), (0.5, 1), (0, 1)], [(0.5, 0), (0.5, 1), (1, 1), (1, 0)]
    edges = _edges(spark, _square(1, 0, left) + _square(2, 0, right))
    assert [r["fraction"] for r in rows(spatial.cell_fractions(edges, grid))] == [pytest.approx(1.0)]


@pytest.mark.parametrize("turn", [1, -1])
def test_a_marked_hole_is_taken_away_whichever_way_it_runs(spark, turn):
    grid = spatial.Grid(0.5, 1.0, 1, 0.5, 1.0, 1)
    shell, hole = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)][::turn]
    edges = _edges(spark, _square(1, 0, shell) + _square(1, 1, hole), hole=1)
    assert [r["fraction"] for r in rows(spatial.cell_fractions(edges, grid))] == [pytest.approx(0.75)]


def test_a_point_in_two_polygons_is_inside(spark):
    edges = _edges(spark, _square(1, 0, [(0, 0), (4, 0), (4, 4), (0, 4)]) + _square(2, 0, [(1, 1), (5, 1), (5, 5), (1, 5)]))
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.5, 0.5), (3, 4.5, 4.5), (4, 6.0, 6.0)], "unit int, lat double, lon double")
    assert [r["inside"] for r in rows(spatial.points_inside(pts, edges), "unit")] == [True, True, True, False]


def test_windows_across_the_seam_and_year_partitions(spark, tmp_path):
    path = str(tmp_path / "field")
    data = [(10.0, lon, dt.date(y, 6, 1), 1.0, y) for lon in (175.0, -175.0, 0.0) for y in (1900, 2000)]
    spark.createDataFrame(data, "lat double, lon double, day date, value double, year int").write.partitionBy("year").parquet(path)
    for bounds in ((170, -170), (170, 190), (-190, -170)):
        got = rows(fields.read_field(spark, path, lon_bounds=bounds, years=(2000, 2001)))
        assert sorted(r["lon"] for r in got) == [-175.0, 175.0]
    plan = plan_text(fields.read_field(spark, path, years=(2000, 2001)))
    assert "PartitionFilters: []" not in plan and "year" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert fields.read_field(spark, path, lon_bounds=(-180, 180)).count() == 6


def test_a_panel_without_year_column_is_cut_by_day(spark, tmp_path):
    path = str(tmp_path / "panel")
    spark.createDataFrame([(1, dt.date(1900, 6, 1)), (1, dt.date(2000, 6, 1))], "unit int, day date").write.parquet(path)
    assert [r["day"].year for r in rows(fields.read_panel(spark, path, ["unit", "day"], years=(2000, 2000)))] == [2000]
    spark.createDataFrame([(1,)], "unit int").write.parquet(path + "0")
    with pytest.raises(ValueError, match="year or a day"):
        fields.read_panel(spark, path + "0", ["unit"], years=(2000, 2000))


def test_units_are_decided_file_by_file(spark):
    df = spark.createDataFrame([("a", 293.15), ("a", None), ("b", 20.0), ("b", 21.0), ("c", None)], "file string, value double")
    got = {(r["file"], r["value"]) for r in rows(fields.celsius_by_mean(df, by="file").withColumn("value", F.round("value", 6)))}
    assert got == {("a", 20.0), ("a", None), ("b", 20.0), ("b", 21.0), ("c", None)}


def test_silent_stations_stay_in_the_mean(spark):
    grid = spatial.Grid(0.0, 1.0, 2, 0.0, 1.0, 1)
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0)], "unit int, lat double, lon double")
    days = [dt.date(y, 6, 1) for y in (2000, 2001)]
    field = spark.createDataFrame([(c, d, float(d.year)) for c in (0, 1) for d in days], "cell long, day date, value double")
    reports = spark.createDataFrame([(1, d) for d in days], "unit int, day date")
    axis = spark.createDataFrame([(dt.date(2000, 12, 31),), (dt.date(2001, 6, 1),)], "day date")
    kept = spark.createDataFrame([(0,)], "cell long")  # the third site's cell was not kept
    full = axis.union(spark.createDataFrame([(dt.date(2001, 12, 31),)], "day date"))
    got = rows(record_plans.at_network_masked_series(field, sites, reports, grid, kept, full, (2000, 2001)), "year")
    assert [r["value"] for r in got] == [0.0, 0.5]
    cut = rows(record_plans.at_network_masked_series(field, sites, reports, grid, kept, axis, (2000, 2001)), "year")
    assert [r["value"] for r in cut] == [0.0, None]
    counts = spark.createDataFrame([(1, 2001, 1.0)], "unit int, year int, records double")
    assert [r["value"] for r in rows(records.record_series(counts, (2001, 2001), members=sites))] == [pytest.approx(1 / 3)]


def test_pairs_written_by_station_are_read_back(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs = spark.createDataFrame([("USC00011084", dt.date(2000, 6, d), float(d), d + 0.5) for d in (1, 2)] + [("X1", dt.date(2000, 6, 1), 3.0, 4.0)],
                                  "unit string, day date, raw double, adj double")
    named = pairs.selectExpr("unit", "date_format(day, 'yyyyMMdd') as date", "raw as tmax_raw_c", "adj as tmax_adj_c")
    named.write.partitionBy("unit").option("header", True).option("compression", "gzip").csv(path)
    got = stations.read_pair_csv(spark, f"{path}/*/*.csv.gz")
    key = lambda r: (r["unit"], r["day"])
    assert sorted(rows(got), key=key) == sorted(rows(pairs), key=key)


def test_the_first_file_wins_a_repeated_day(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text(f"S1,20000601,TMAX,{value},,,,\nS1,20000601,TMAX,9,,,,\n")
    got = stations.read_daily_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    first = got.groupBy("unit", "day").agg(F.min_by("value", "ord").alias("value"))
    assert [r["value"] for r in rows(first)] == [1.0]


def test_seasons_and_unsettled_fractions():
    assert anomaly.season_offsets((10, 11, 12, 1, 2)) == [-1, -1, -1, 0, 0]
    import numpy as np

    assert np.isfinite(_beta_fraction(np.array([5.0]), 0.5, np.array([0.3]))).all()


def test_repeated_and_missing_years_are_refused(spark):
    from pyspark.errors import PySparkException

    from dayspell.operators import series

    twice = spark.createDataFrame([("a", 2000 + i % 20, float(i)) for i in range(40)], "series string, year int, value double")
    with pytest.raises(PySparkException, match="repeats"):
        series.lowess(twice).collect()
    holes = spark.createDataFrame([("a", 1900 + i + (i > 30), float(i)) for i in range(60)], "series string, year int, value double")
    with pytest.raises(PySparkException, match="not unbroken"):
        series.end_revision(holes).collect()


def test_a_repeated_sample_does_not_hide_a_missing_one(spark):
    from dayspell.operators import localday

    hours = [0, 6, 12, 18, 24, 24, 30, 36]
    df = spark.createDataFrame([("c", 0.0, h, float(h)) for h in hours], "cell string, lon double, hours int, value double")
    got = rows(localday.local_days(df, 6), "day")
    assert [(r["n_samples"], r["tmax"]) for r in got] == [(4, 18.0), (4, None)]


def test_every_column_has_a_catalogue_row(spark):
    from dayspell.operators import tables

    held = spark.createDataFrame([("conus_records__era5", 2000, 1.0)], "series string, year int, value double")
    got = rows(tables.describe_columns(held, ["conus_records__era5", "band_hw_days__20cr"]), "series")
    assert [(r["domain"], r["n_years"], r["first_year"]) for r in got] == [("band", 0, None), ("conus", 1, 2000)]
