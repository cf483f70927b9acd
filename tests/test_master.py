"""The whole master table from prepared tables: every column, built lazily, one dataset at a time."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from dayspell.functions import dates
from dayspell.operators import guards, spatial, tables
from dayspell.plans import master
from dayspell.plans.inputs import Inputs, Rules
from dayspell.plans.master_builders import builders

GRID = spatial.Grid(35.0, 1.0, 3, -100.0, 1.0, 4)
FINE = spatial.Grid(34.75, 0.5, 6, -100.25, 0.5, 8)
COARSE = spatial.Grid(35.5, 2.0, 2, -99.5, 2.0, 2)
YEARS = (2000, 2007)


def _field(spark, grid, shift=0.0):
    days = dates.day_spine(spark, *YEARS, months=range(1, 13)).select("day")
    cells = grid.cells(spark).select("cell")
    noise = (F.pmod(F.xxhash64("cell", "day"), F.lit(1000)) / 100.0).cast("double")
    wave = 10.0 * F.sin((F.dayofyear("day") - 100) * 0.0172)
    return cells.crossJoin(days).select("cell", "day", (noise + wave + shift + 15.0).alias("value"))


def _cells(spark, grid):
    c = grid.cells(spark)
    return c.select("cell", "lat", "lon", F.lit(1.0).alias("fraction"), F.lit(True).alias("conus"),
                    (F.col("cell") % 5 != 4).alias("land"))


@pytest.fixture(scope="module")
def inputs(spark):
    grids = {"berkeley": GRID, "era5": FINE, "20cr": COARSE}
    daily = {(d, e): _field(spark, g, s) for d, g in grids.items()
             for e, s in (("tmax", 0.0), ("tmin", -9.0), ("tmean", -4.0)) if e != "tmean" or d == "20cr"}
    months = {k: v.groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.avg("value").alias("value")) for k, v in daily.items()}
    cells = {d: _cells(spark, g) for d, g in grids.items()}
    weights = {d: c.select("cell", F.lit(1.0).alias("weight")) for d, c in cells.items()}
    st = spark.createDataFrame([(f"s{i}", 35.0 + i % 3, -100.0 + i % 4) for i in range(6)], "unit string, lat double, lon double")
    site = GRID.snap(st).select("unit", "lat", "lon", "cell")
    days = site.join(daily["berkeley", "tmax"], "cell").filter(F.month("day").between(5, 9))
    pair = days.select("unit", "day", F.round("value", 1).alias("raw"), F.round(F.col("value") + 0.3, 1).alias("adj"))
    pm = days.groupBy("unit", "lat", "lon", F.year("day").alias("year"), F.month("day").alias("month")).agg(
        *[F.sum("value").alias(f"{e}_{g}_sum") for e in ("tmax", "tmin", "tavg") for g in ("raw", "adj")],
        *[F.count("value").alias(f"{e}_{g}_n") for e in ("tmax", "tmin", "tavg") for g in ("raw", "adj")])
    national = months["berkeley", "tmax"].groupBy("year", "month").agg(F.avg("value").alias("value"))
    return Inputs(months=months, weights=weights, daily=daily, cells=cells, national={"tmax": national},
                  pair_months=pm, pair_days=pair, pair_stations=st,
                  station_cells=_cells(spark, GRID).withColumn("weight", F.lit(1.0)), berkeley_grid=GRID)


RULES = Rules(
    season=dict(baseline=YEARS, min_base=2), record_years=YEARS, records=dict(min_years=5, min_share=0.5),
    stations=dict(baseline=YEARS, min_base_station=2, min_base_cell=2), smooth_years=5,
    band=dict(baseline=YEARS, min_base=2), heat=dict(percentile=60, min_pool=20, min_run=2), radius_km=115.0)


def test_builders_cover_every_column_of_the_datasets(inputs):
    made = set(builders(inputs, RULES))
    assert made <= set(master.all_columns())
    for section, datasets in master.SECTIONS.items():
        for ds in datasets:
            if ds in ("noaa", "crutem5", "era20c", "nclimdiv"):
                continue  # no table for them here, or one element only
            assert ({e.series for e in master.ENTRIES if (e.section, e.dataset) == (section, ds)}) <= made


@pytest.mark.parametrize("column", [
    "conus_jja_tmax_anom__ushcn_bc", "conus_jja_tavg_anom__era5", "conus_jja_tavgmean_anom__20cr",
    "conus_jja_tmax_anom__nclimdiv", "conus_records__ushcn", "conus_records__20cr", "conus_records__berkeley_at_ushcn",
    "conus_records__ushcn_bc_x_sampling", "band_jja_tavg_anom__berkeley", "band_jja_tmin_anom__era5",
    "band_jja_tavgmean_anom__20cr", "conus_hw_days__ushcn_bc", "conus_hw_days__berkeley_at_ushcn", "band_hw_days__era5"])
def test_columns_have_a_value_in_every_year(spark, inputs, column):
    long = master.build(None, builders(inputs, RULES), [column])
    out = {r["year"]: r["value"] for r in rows(long)}
    assert set(out) == set(range(YEARS[0], YEARS[1] + 1))
    if "anom" in column:  # anomalies against the whole span average to zero
        assert sum(out.values()) == pytest.approx(0.0, abs=1e-9)
    elif column.startswith("conus_records") and "sampling" not in column:
        assert sum(out.values()) == pytest.approx(153.0)


def test_wide_table_of_some_columns(spark, inputs):
    names = ["conus_records__ushcn", "conus_records__ushcn_bc"]
    wide = tables.long_to_wide(master.build(None, builders(inputs, RULES), names), names, (1999, 2008))
    out = rows(wide, "year")
    assert len(out) == 10 and out[0]["conus_records__ushcn"] is None and out[1]["conus_records__ushcn"] is not None


def test_refusals(spark, inputs):
    f = inputs.daily["berkeley", "tmax"]
    guards.require_empty(guards.missing_months(f, 2000, 2007, (6, 7, 8)), "partial")
    with pytest.raises(ValueError, match="partial"):
        guards.require_empty(guards.missing_months(f, 2000, 2008, (6, 7, 8)), "partial")
    with pytest.raises(ValueError, match="unexpected unit"):
        guards.require_units("K")
    guards.require_units("degC")
