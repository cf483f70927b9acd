"""Plans refuse broken input in the pass they make anyway; every stop can be switched off."""

import datetime as dt

import pytest
from conftest import plan_text, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dayspell.functions import dates
from dayspell.operators import anomaly, records, spatial, spells
from dayspell.plans import anomalies, heat, localday
from dayspell.plans import records as plans

YEARS = (2000, 2005)
RULE = dict(min_years=2, min_share=0.5)


def season(spark, units=3):
    days = dates.day_spine(spark, *YEARS).select("day")
    ids = spark.range(units).select(F.col("id").alias("unit"))
    value = F.pmod(F.xxhash64("unit", "day"), F.lit(400)) / 10.0
    return ids.crossJoin(days).withColumn("year", F.year("day")).withColumn("value", value)


def refuses(make, message):
    with pytest.raises(PySparkException, match=message):
        rows(make(True))
    assert rows(make(False))
    on, off = plan_text(make(True)), plan_text(make(False))
    assert on.count("Exchange ") == off.count("Exchange ") and on.count("Scan ") == off.count("Scan ")


def test_a_record_series_must_sum_to_the_season(spark):
    panel = season(spark)
    assert sum(r["value"] for r in rows(plans.network_series(panel, YEARS, **RULE))) == pytest.approx(153.0)
    short = panel.filter("date_format(day, 'MMdd') not in ('0601', '0602')")
    refuses(lambda on: plans.network_series(short, YEARS, check=on, **RULE), "must sum to 153")


def test_two_rows_for_one_day(spark):
    panel = season(spark)
    twice = panel.unionByName(panel.filter("unit = 1 and day = '2001-07-04'").withColumn("value", F.lit(1.0)))
    refuses(lambda on: records.unit_record_counts(twice, check=on), "two rows for one day")
    doy = twice.select("unit", "year", dates.season_day(F.col("day")).alias("doy"), "value")
    with pytest.raises(PySparkException, match="two rows for one day"):
        rows(spells.heatwave_counts(doy, min_pool=5))
    clean = panel.select("unit", "year", dates.season_day(F.col("day")).alias("doy"), "value")
    assert rows(spells.heatwave_counts(clean, min_pool=5))


def test_days_with_one_leg_only(spark):
    pairs = season(spark).select("unit", "day", F.col("value").alias("raw"), (F.col("value") + 0.5).alias("adj"))
    assert rows(plans.pair_series(pairs, YEARS, **RULE))
    lone = pairs.withColumn("adj", F.when(~((F.col("day") == "2002-08-01") & (F.col("unit") == 2)), F.col("adj")))
    refuses(lambda on: plans.pair_series(lone, YEARS, check=on, **RULE), "same days")


def test_stations_without_a_position(spark):
    grid = spatial.Grid(35.0, 1.0, 2, -100.0, 1.0, 2)
    counts = season(spark, 4).withColumnRenamed("unit", "cell")
    counts = records.unit_record_counts(counts, "cell")
    lost = spark.createDataFrame([("a", 35.0, -100.0), ("b", None, -99.0)], "unit string, lat double, lon double")
    refuses(lambda on: plans.at_network_series(counts, lost, grid, YEARS, check=on), "no position")
    cells = grid.cells(spark).withColumn("fraction", F.lit(1.0))
    refuses(lambda on: plans.at_network_cells_series(counts, lost, grid, cells, YEARS, check=on), "no position")
    hw = counts.select("cell", "year", F.lit(3).alias("hw_days"))
    with pytest.raises(PySparkException, match="no position"):
        rows(heat.reduce_at_network(hw, lost, grid, grid.cells(spark), 150.0).series)
    assert rows(heat.reduce_at_network(hw, lost, grid, grid.cells(spark), 150.0, check=False).station_mean)


def test_a_baseline_with_missing_months(spark):
    months = spark.createDataFrame([(c, y, m, 10.0 + c + y % 3) for c in range(2) for y in range(2000, 2010) for m in (6, 7, 8)],
                                   "cell long, year int, month int, value double")
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "cell long, weight double")
    rule = dict(baseline=(2000, 2005), min_base=2, years=(1998, 2011))
    out = {r["year"]: r["value"] for r in rows(anomalies.seasonal_anomaly_field(months, weights, **rule))}
    assert sorted(out) == list(range(1998, 2012))  # a row for every year of the span
    assert [y for y, v in out.items() if v is None] == [1998, 1999, 2010, 2011]
    hole = months.filter("not (year = 2003 and month = 7)")
    refuses(lambda on: anomalies.seasonal_anomaly_field(hole, weights, check=on, **rule), "missing in 2003")
    late = months.filter("not (year = 2008 and month = 7)")  # outside the baseline a NULL says enough
    assert {r["year"]: r["value"] for r in rows(anomalies.seasonal_anomaly_field(late, weights, **rule))}[2008] is None
    national = hole.filter("cell = 0").select("year", "month", "value")
    refuses(lambda on: anomalies.official_series(national, baseline=(2000, 2005), min_base=2, years=(2000, 2009), check=on), "missing in 2003")


def test_season_rows_of_a_span(spark):
    monthly = spark.createDataFrame([("a", 2001, m, 1.0) for m in (6, 7, 8)] + [("a", 2003, 6, 1.0), ("b", 2002, 7, 2.0)],
                                    "k string, year int, month int, value double")
    out = rows(anomaly.season_means(monthly, years=(2000, 2003), keys=("k",), spine=True), "k", "year")
    assert [(r["k"], r["year"], r["value"]) for r in out if r["value"] is not None] == [("a", 2001, pytest.approx(1.0))] and len(out) == 8
    winter = spark.createDataFrame([(2000, 12, 1.0), (2001, 1, 1.0), (2001, 2, 1.0)], "year int, month int, value double")
    assert [(r["year"], r["value"]) for r in rows(anomaly.season_means(winter, (12, 1, 2), (2000, 2002), spine=True), "year")] == [
        (2000, None), (2001, pytest.approx(1.0)), (2002, None)]


def samples(spark, drop=(), extra=(), value=15.0):
    start = (dt.date(2001, 6, 1) - dt.date(1970, 1, 1)).days * 24
    hours = [h for h in range(start, start + 240, 6) if h - start not in drop] + [start + h for h in extra]
    return spark.createDataFrame([(1, -90.0, 40.0, h, value) for h in hours], "cell long, lon double, lat double, hours long, value double")


@pytest.mark.parametrize("drop, extra, value, message", [
    ((108,), (), 15.0, "6 h apart"), ((), (108,), 15.0, "6 h apart"), ((), (109,), 15.0, "6 h apart"), ((), (), 288.0, "not degC")])
def test_samples_that_are_uneven_or_in_kelvin(spark, drop, extra, value, message):
    good = rows(localday.local_day_product(samples(spark), 6))
    assert sum(r["tmax"] is not None for r in good) == 9
    refuses(lambda on: localday.local_day_product(samples(spark, drop, extra, value), 6, check=on), message)
