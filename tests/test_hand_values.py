"""Small inputs with values worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from dayspell.functions import dates, geo
from dayspell.operators import (
    anomaly, coverage, gridding, guards, joins, localday, monthly, pairs, qc, records, series, spatial, spells,
    thresholds,
)


def test_season_labels():
    assert anomaly.season_offsets((12, 1, 2)) == [-1, 0, 0]
    assert anomaly.season_offsets((6, 7, 8)) == [0, 0, 0]
    assert anomaly.season_offsets((11, 12, 1)) == [-1, -1, 0]


def test_season_mean_is_day_weighted_and_strict(spark):
    data = [(y, m, v) for y in (2000, 2001) for m, v in ((6, 0.0), (7, 0.0), (8, 3.0))]
    data = [(y, m, None if (y, m) == (2001, 7) else v) for y, m, v in data]
    df = spark.createDataFrame(data, "year int, month int, value double")
    out = rows(anomaly.season_means(df), "year")
    assert out[0]["value"] == pytest.approx(93 / 92)
    assert out[1]["value"] is None


def test_winter_takes_december_of_the_year_before(spark):
    df = spark.createDataFrame(
        [(2000, 12, 1.0), (2001, 1, 1.0), (2001, 2, 1.0), (2001, 12, 5.0)], "year int, month int, value double")
    out = {r["year"]: r["value"] for r in rows(anomaly.season_means(df, (12, 1, 2)))}
    assert out == {2001: pytest.approx(1.0), 2002: None}


def test_field_equal_to_its_climatology_has_no_anomaly(spark):
    data = [(c, y, m, float(m + off)) for c, off in ((1, 10), (2, -5)) for y in range(1951, 1981) for m in range(1, 13)]
    df = spark.createDataFrame(data, "cell int, year int, month int, value double")
    out = anomaly.anomalies(df, ("cell", "month"))
    assert out.count() == 720
    assert out.filter("value != 0").count() == 0


def test_area_mean_and_fraction(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 3.0)], "cell int, weight double")
    f = spark.createDataFrame([(1, 2000, 1, 2.0), (2, 2000, 1, 6.0), (1, 2001, 1, 2.0), (2, 2001, 1, None)],
                              "cell int, year int, month int, value double")
    out = rows(anomaly.weighted_area_mean(f, w), "year")
    assert (out[0]["value"], out[0]["fraction"]) == (5.0, 1.0)
    assert (out[1]["value"], out[1]["fraction"]) == (2.0, 0.25)


def test_interpolation_reproduces_stations_on_cells(spark):
    cells = spark.createDataFrame([(i, la, lo) for i, (la, lo) in enumerate(
        [(40.0, -100.0), (40.0, -99.0), (41.0, -100.0), (41.0, -99.0)])], "cell long, lat double, lon double")
    st = spark.createDataFrame([("a", 40.0, -100.0), ("b", 41.0, -99.0)], "unit string, lat double, lon double")
    v = spark.createDataFrame([("a", 2000, 1, 5.0), ("b", 2000, 1, -3.0)], "unit string, year int, month int, value double")
    out = rows(gridding.nearest_idw(v, spatial.near_pairs(cells, st, 150.0)), "cell")
    assert out[0]["value"] == 5.0 and out[3]["value"] == -3.0
    assert -3.0 < out[1]["value"] < 5.0


def test_station_anomalies_drop_short_baselines(spark):
    data = [("A", y, 7, 20.0 + (y - 1965)) for y in range(1951, 1981)] + [("B", y, 7, 15.0) for y in range(1951, 1961)]
    df = spark.createDataFrame(data, "unit string, year int, month int, value double")
    out = rows(anomaly.anomalies(df, min_years=15), "year")
    assert {r["unit"] for r in out} == {"A"}
    assert np.mean([r["value"] for r in out]) == pytest.approx(0.0)
    assert next(r["value"] for r in out if r["year"] == 1965) == pytest.approx(-0.5)


@pytest.mark.parametrize("values, credit", [((1, 3, 3, None), (0, 0.5, 0.5, 0)), ((1, 5, 3), (0, 1, 0))])
def test_record_credit_splits_ties(spark, values, credit):
    data = [("u", dt.date(2000 + i, 6, 1), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "unit string, day date, value double")
    got = {r["year"]: r["records"] for r in rows(records.unit_record_counts(df))}
    assert got == {2000 + i: c for i, c in enumerate(credit) if c}


def _season(spark, years, seed=0, drop=None):
    rng = np.random.default_rng(seed)
    days = dates.day_spine(spark, *years).orderBy("day").collect()
    values = np.round(rng.normal(30.0, 5.0, len(days)), 1)
    data = [("u", r["day"], r["year"], float(v)) for r, v in zip(days, values) if drop is None or not drop(r["day"])]
    return spark.createDataFrame(data, "unit string, day date, year int, value double")


def test_a_full_station_holds_153_records(spark):
    panel = _season(spark, (1900, 2025))
    series_ = records.record_series(records.unit_record_counts(panel), (1900, 2025))
    out = rows(records.integral(series_))[0]
    assert out["integral"] == pytest.approx(153.0) and out["ok"]
    assert series_.count() == 126


def test_half_a_record_is_rejected(spark):
    full = _season(spark, (1900, 2025))
    half = full.filter("year >= 1963")
    assert coverage.keep_complete(full, 126).count() == full.count()
    assert coverage.keep_complete(half, 126).count() == 0
    c = rows(coverage.coverage(half, 126))[0]
    assert (c["n_years"], round(c["share"], 2)) == (63, 0.5)


def test_years_past_the_last_full_one_are_blank(spark):
    s = spark.createDataFrame([(y, 1.0) for y in (2022, 2023, 2024)], "year int, value double")
    axis = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 8, 31),)], "day date")
    assert [r["value"] for r in rows(coverage.blank_after_last_full_year(s, axis), "year")] == [1.0, 1.0, None]


def test_season_day_and_slot(spark):
    df = spark.createDataFrame([(dt.date(y, *md),) for y in (1999, 2000) for md in ((5, 1), (9, 30), (2, 28), (3, 1))], "day date")
    out = rows(df.select("day", dates.season_day(F.col("day")).alias("s"), dates.leap_slot(F.col("day")).alias("slot")), "day")
    got = {(r["day"].year, r["day"].month, r["day"].day): (r["s"], r["slot"]) for r in out}
    for y in (1999, 2000):
        assert got[(y, 5, 1)][0] == 1 and got[(y, 9, 30)][0] == 153
        assert got[(y, 2, 28)][1] == 58 and got[(y, 3, 1)][1] == 60
    back = spark.createDataFrame([(1999, 59), (2000, 59), (1999, 365)], "year int, slot int")
    got = rows(back.withColumn("d", dates.slot_to_date(F.col("year"), F.col("slot"))), "slot", "year")
    assert [r["d"] for r in got] == [None, dt.date(2000, 2, 29), dt.date(1999, 12, 31)]


def _hot(spark, doys):
    return spark.createDataFrame([("u", 2000, d, 1.0) for d in doys], "unit string, year int, doy int, value double")


@pytest.mark.parametrize("doys, days", [
    (range(10, 16), 6), (range(10, 15), 0), (range(10, 19), 9), ([10, 11, 12, 14, 15, 16], 0),
    ([*range(1, 7), *range(20, 28), 40], 14)])
def test_run_count(spark, doys, days):
    df = _hot(spark, list(doys))
    assert spells.spell_days(df, F.col("value") > 0).count() == days
    folded = df.agg(spells.days_in_runs(F.collect_list("doy"), 6).alias("n")).first()["n"]
    assert folded == days


def test_one_year_gives_no_thresholds(spark):
    data = [("u", 2000, d, float(d % 7)) for d in range(1, 154)]
    df = spark.createDataFrame(data, "unit string, year int, doy int, value double")
    assert thresholds.heat_thresholds(df).filter("threshold IS NOT NULL").count() == 0


def test_short_record_is_unknown_not_zero(spark):
    data = [("u", 2000, d, float(d % 7)) for d in range(1, 154)]
    df = spark.createDataFrame(data, "unit string, year int, doy int, value double")
    assert rows(spells.heatwave_counts(df))[0]["hw_days"] is None
    assert rows(spells.heatwave_counts(df, need_thresholds=False))[0]["hw_days"] == 0


@pytest.mark.parametrize("values, p, want", [(list(range(1, 11)), 90, 10), ([1, 3, 5, 9], 50, 5), ([1, 3, 5, 9], 25, 3)])
def test_nearest_rank(spark, values, p, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "a array<double>")
    assert df.select(thresholds.nearest_rank(F.col("a"), p).alias("x")).first()["x"] == want


def test_radial_distance(spark):
    df = spark.range(1)
    near = df.select(geo.radial_km(F.lit(40.0), F.lit(-100.0), F.lit(41.0), F.lit(-100.0)).alias("d")).first()["d"]
    far = df.select(geo.radial_km(F.lit(40.0), F.lit(-100.0), F.lit(-39.0), F.lit(79.0)).alias("d")).first()["d"]
    assert 110 < near < 111 and far < 0


def test_count_interpolation(spark):
    cells = spark.createDataFrame([(1, 40.0, -100.0)], "cell long, lat double, lon double")
    st = spark.createDataFrame([("a", 40.0, -100.0), ("b", 40.5, -100.5)], "unit string, lat double, lon double")
    counts = spark.createDataFrame([("a", 2000, 7), ("b", 2000, 3)], "unit string, year int, hw_days int")
    out = rows(gridding.count_idw(counts, spatial.radial_pairs(cells, st, 115.0), 115.0))[0]
    assert out["hw_days"] == pytest.approx(7.0, abs=1e-4) and out["n_stations"] == 2


@pytest.mark.parametrize("kms, accepted", [([], False), ([90.0], False), ([70.0], True), ([110.0, 110.0], True)])
def test_acceptance_rule(spark, kms, accepted):
    pairs_ = spark.createDataFrame([(1, i, k) for i, k in enumerate(kms)], "cell long, unit int, km double")
    counts = spark.createDataFrame([(i, 2000, 5) for i in range(3)], "unit int, year int, hw_days int")
    assert (gridding.count_idw(counts, pairs_, 115.0).count() == 1) is accepted


def test_utc_offsets(spark):
    lons = [-122.5, -97.0, -75.0, -7.5, 0.0, 22.5, 100.0, 179.0, -179.0, 359.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lons)], "i int, lon double")
    got = [r["o"] for r in rows(df.select("i", geo.utc_offset_hours(F.col("lon")).alias("o")), "i")]
    assert got == [-8, -6, -5, 0, 0, 2, 7, 12, -12, 0]


def test_local_day_of_a_ramp(spark):
    # at 100 W a day starts 7 h late: its first 3-hourly sample is 09 UTC
    df = spark.createDataFrame([(1, -100.0, h, float(h)) for h in range(0, 72, 3)], "cell int, lon double, hours long, value double")
    out = {r["day"]: r for r in rows(localday.local_days(df, 3))}
    first, second = out[dt.date(1970, 1, 1)], out[dt.date(1970, 1, 2)]
    assert first["tmin"] == 9 and first["tmax"] - first["tmin"] == 21 and first["tmean"] - first["tmin"] == 10.5
    assert second["tmin"] == 33
    assert out[dt.date(1969, 12, 31)]["tmax"] is None and out[dt.date(1970, 1, 3)]["tmax"] is None
    holed = df.withColumn("value", F.when(F.col("hours") != 12, F.col("value")))
    assert {r["day"]: r["tmax"] for r in rows(localday.local_days(holed, 3))}[dt.date(1970, 1, 1)] is None
    assert localday.missing_steps(df, 3).count() == 0
    assert [r["hours"] for r in rows(localday.missing_steps(df.filter("hours != 12"), 3))] == [9]
    with pytest.raises(ValueError):
        localday.local_days(df, 5)


def test_first_row_wins_and_flags_go_first(spark):
    data = [("u", dt.date(2000, 6, 1), "TMAX", 100, "X", 1), ("u", dt.date(2000, 6, 1), "TMAX", 200, " ", 2),
            ("u", dt.date(2000, 6, 1), "TMAX", 300, None, 3), ("u", dt.date(2000, 6, 1), "TMIN", 50, "", 4),
            ("u", dt.date(2000, 6, 2), "PRCP", 9, "", 5)]
    df = spark.createDataFrame(data, "unit string, day date, elem string, value int, qflag string, ord long")
    out = rows(qc.daily_panel(df))
    assert len(out) == 1 and out[0]["tmax"] == 20.0 and out[0]["tmin"] == 5.0
    two = qc.first_wins(df, ["unit", "day"], ["elem", "ord"], ["value"])
    assert [r["value"] for r in rows(two, "day")] == [100, 9]


def test_complete_months_need_their_share_of_days(spark):
    df = spark.createDataFrame([("u", 2000, 2, 240.0, 24), ("u", 2001, 2, 230.0, 23), ("u", 2000, 3, 240.0, 24), ("u", 2000, 4, 0.0, 0)],
                               "unit string, year int, month int, s double, n long")
    out = rows(monthly.complete_months(df, "s", "n"))
    # 80% of a leap February is 23.2 days, of a common one 22.4, of March 24.8
    assert sorted((r["year"], r["month"], r["value"]) for r in out) == [(2000, 2, 10.0), (2001, 2, 10.0)]


def test_monthly_offsets_drop_estimated_months(spark):
    schema = "unit string, elem string, year int, month int, value double, flag string"
    raw = spark.createDataFrame([("u", "tmax", 2000, m, 1000.0, " ") for m in (1, 2, 3)], schema)
    adj = spark.createDataFrame([("u", "tmax", 2000, 1, 1050.0, " "), ("u", "tmax", 2000, 2, 1010.0, "E"),
                                 ("u", "tmax", 2001, 1, 1010.0, " ")], schema)
    out = rows(pairs.monthly_offsets(raw, adj))
    assert len(out) == 1 and out[0]["offset"] == pytest.approx(0.5)


def test_pair_masks(spark):
    daily = spark.createDataFrame([("u", dt.date(2000, 1, 1), 10.0, 0.0), ("u", dt.date(2000, 2, 1), 10.0, None)],
                                  "unit string, day date, tmax double, tmin double")
    off = spark.createDataFrame([("u", 2000, 1, 1.0, None, 0.5), ("u", 2000, 2, 1.0, 1.0, 0.5)],
                                "unit string, year int, month int, tmax_offset double, tmin_offset double, tavg_offset double")
    jan, feb = rows(pairs.paired_days(daily, off), "day")
    assert (jan["tmax_adj"], jan["tmin_raw"], jan["tavg_raw"], jan["tavg_adj"]) == (11.0, None, 5.0, 5.5)
    assert (feb["tmax_adj"], feb["tmin_adj"], feb["tavg_adj"]) == (11.0, None, None)


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.5), (2, 4.0, 3.0)], "k int, x double, y double")
    x, y = rows(joins.differences(a, b, ["k"], ["x", "y"]), "name")
    assert (x["only_new"], x["only_old"], x["max_abs_diff"], x["same"]) == (1, 0, 0.0, False)
    assert (y["max_abs_diff"], y["same"]) == (0.5, False)
    assert all(r["same"] for r in rows(joins.differences(a, a, ["k"], ["x", "y"])))


def test_calendar_keeps_gaps(spark):
    df = spark.createDataFrame([("u", dt.date(2000, 5, 1), 1.0)], "unit string, day date, value double")
    out = joins.on_calendar(df, (2000, 2001))
    assert out.count() == 306 and out.filter("value IS NOT NULL").count() == 1


def test_outliers_tail_and_gate(spark):
    vals = [1.0, 1.1, 0.9, 1.0, 1.2, 0.8, 1.1, 0.9, 1.0, 1.1, 0.9, 1.0, 1.05, 0.95, 1.0, 9.0]
    s = spark.createDataFrame([("s", 2000 + i, v, 0.4 if i == 0 else 1.0) for i, v in enumerate(vals)],
                              "series string, year int, value double, fraction double")
    assert [r["year"] for r in rows(series.trim_tail(s)) if r["value"] is None] == [2015]
    assert [r["year"] for r in rows(series.blank_outliers(s)) if r["value"] is None] == [2015]
    assert series.gate_coverage(s).filter("value IS NULL").count() == 1
    short = s.filter("year >= 2003")
    assert series.trim_tail(short).filter("value IS NULL").count() == 0  # 13 points are too few to judge
    flat = s.withColumn("value", F.when(F.col("year") == 2015, 9.0).otherwise(1.0))
    assert series.blank_outliers(flat).filter("value IS NULL").count() == 0  # MAD is 0


def test_guards(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 2)], "series string, year int")
    got = {r["series"]: (r["n_repeats"], r["n_gaps"]) for r in rows(guards.broken_axes(s))}
    assert got == {"a": (1, 0), "b": (0, 1)}
    with pytest.raises(Exception, match="too large"):
        guards.enforce(s, F.col("year") < 3, "too large").count()
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert rows(guards.nan_counts(nan, ["v"])) == [{"v": 1}]


def test_recent_and_rows(spark):
    s = spark.createDataFrame([("a", y, float(y)) for y in range(1990, 2011)], "series string, year int, value double")
    r = rows(series.recent_mean(s, (2015, 2024)))[0]
    assert (r["recent"], r["first_year"], r["last_year"]) == (2005.5, 2001, 2010)
    row = rows(series.anomaly_rows(s, (1995,), (1990, 1999), (2007, 2016)))[0]
    assert row["y1995"] == 1995.0 and row["old_mean"] == 1994.5
    assert (row["modern_mean"], row["modern_end"], row["last_year"]) == (2008.5, 2010, 2010)
    assert math.isclose(rows(series.full_window_trend(s, 1990, 2010))[0]["trend"], 100.0)
    assert rows(series.full_window_trend(s, 1980, 2010))[0]["trend"] is None


def test_sample_hours_ignore_the_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS a, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS b, "
                       "TIMESTAMP'1969-12-31T23:30:00Z' AS c")
        got = df.select(dates.epoch_hours_utc_clock(F.col("a")), dates.epoch_hours_utc_clock(F.col("b")),
                        dates.epoch_hours(F.col("c"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(got) == (475010, -1, -1)
