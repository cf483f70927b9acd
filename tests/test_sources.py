"""Readers and writers on small files."""

import datetime as dt
import gzip

import pytest
from conftest import plan_text, rows
from pyspark.sql import functions as F

from dayspell.operators import joins, qc, tables
from dayspell.plans import master, stations
from dayspell.sinks import writers
from dayspell.sources import fields, stations as src, tables as table_source


def _gz(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_daily_csv_to_panel(spark, tmp_path):
    _gz(tmp_path / "2000.csv.gz", "\n".join([
        "USW00000001,20000601,TMAX,311,,,7,", "USW00000001,20000601,TMAX,999,,,7,",
        "USW00000001,20000601,TMIN,150,,X,7,", "USW00000001,20000602,TMIN,-9999,,,7,",
        "USW00000001,20000631,TMAX,300,,,7,", "USW00000001,20000603,PRCP,5,,,7,",
        "USW00000002,20000601,TMAX,250,, ,7,0700", "USW00000003,20000601,TMAX,abc,,,7,"]) + "\n")
    _gz(tmp_path / "2001.csv.gz", "USW00000001,20010601,TMAX,100,,,7,\n")
    obs = src.read_daily_csv(spark, str(tmp_path))
    assert obs.filter("day IS NULL").count() == 1  # 31 June
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "stations.txt").write_text(
        "USW00000001  40.1000 -100.2000  500.0\nUSW00000002  60.0000  -90.0000   10.0\n")
    lst = src.parse_station_list(spark.read.text(str(tmp_path / "list" / "stations.txt")))
    assert rows(lst, "unit")[0] == {"unit": "USW00000001", "lat": 40.1, "lon": -100.2}
    clean = qc.drop_missing(obs)
    band = rows(stations.qc_station_band(clean, lst), "day")
    assert [(r["unit"], r["day"], r["tmax"], r["tmin"]) for r in band] == [
        ("USW00000001", dt.date(2000, 6, 1), 31.1, None), ("USW00000001", dt.date(2001, 6, 1), 10.0, None)]
    cube = rows(stations.qc_cube(obs), "unit", "year")
    assert [(r["unit"], r["year"], r["slot"], r["tmax"]) for r in cube] == [
        ("USW00000001", 2000, 152, 311.0), ("USW00000001", 2001, 152, 100.0), ("USW00000002", 2000, 152, 250.0)]


def test_first_row_survives_split_files(spark, tmp_path):
    # a plain file read in many small pieces keeps its line order
    lines = [f"USW00000001,20000601,TMAX,{i},,,7," for i in range(4000)]
    (tmp_path / "2000.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        obs = src.read_daily_csv(spark, str(tmp_path / "2000.csv"))
        assert obs.rdd.getNumPartitions() > 4
        assert rows(qc.first_wins(obs, ["unit", "day", "elem"], "ord", ["value"]))[0]["value"] == 0.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_inventory(spark, tmp_path):
    (tmp_path / "inv.txt").write_text("USW00000001  40.1000 -100.2000 TMAX 1900 2020\n"
                                      "USW00000001  40.1000 -100.2000 PRCP 1890 2020\n")
    inv = src.parse_inventory(spark.read.text(str(tmp_path / "inv.txt")))
    assert rows(inv, "elem")[1] == {"unit": "USW00000001", "lat": 40.1, "lon": -100.2, "elem": "TMAX",
                                    "first_year": 1900, "last_year": 2020}
    assert src.element_positions(inv).count() == 1


def _month_line(uid, year, values, flags=None):
    flags = flags or ["   "] * 12
    return f"{uid}1{year}" + "".join(f"{v:6d}{f}" for v, f in zip(values, flags))


def test_monthly_files_to_offsets(spark, tmp_path):
    uid = "USH00000001"
    raw = [100 * m for m in range(1, 13)]
    adj = [v + 25 for v in raw]
    flags = ["   "] * 12
    flags[2] = "E  "
    raw[5] = -9999
    (tmp_path / f"{uid}.raw.tmax").write_text(_month_line(uid, 2000, raw) + "\nshort\n" + _month_line(uid, 2001, raw) + "\n")
    (tmp_path / f"{uid}.FLs.52j.tmax").write_text(_month_line(uid, 2000, adj, flags) + "\n" + _month_line(uid, 2005, adj) + "\n")
    (tmp_path / "readme.txt").write_text("x" * 200 + "\n")
    months = src.read_monthly(spark, str(tmp_path))
    assert months.count() == 48
    off = stations.homogenization_offsets(months.filter("leg = 'raw'"), months.filter("leg = 'adj'"))
    got = {(r["year"], r["month"]): r["tmax_offset"] for r in rows(off)}
    assert set(got) == {(2000, m) for m in range(1, 13) if m not in (3, 6)}
    assert all(v == pytest.approx(0.25) for v in got.values())


def test_statewide_file(spark, tmp_path):
    line = "110027" + "2000" + "".join(f"{v:7.2f}" for v in [32.0, 50.0, -99.9] + [212.0] * 9)
    other = "110028" + line[6:]
    (tmp_path / "s.txt").write_text(line + "\n" + other + "\n" + line[:6] + "1890" + line[10:] + "\n")
    out = rows(src.parse_statewide(spark.read.text(str(tmp_path / "s.txt")), "tmax", (1900, 2020)), "month")
    assert [r["value"] for r in out] == pytest.approx([0.0, 10.0, None] + [100.0] * 9)


def test_pair_csv_round_trip(spark, tmp_path):
    days = [("USH00000001", dt.date(2000, m, 1), 10.123, 11.128) for m in (4, 5, 6)] + [
        ("USH00000001", dt.date(2000, 7, 1), None, None)]
    pairs = spark.createDataFrame(days, "unit string, day date, tmax_raw double, tmax_adj double")
    writers.write_station_csv(pairs, str(tmp_path / "out"))
    back = src.read_header_csv(spark, str(tmp_path / "out"))
    got = rows(back.select("date", "tmax_raw_c", "tmax_adj_c"), "date")
    assert [tuple(r.values()) for r in got] == [("20000501", "10.12", "11.13"), ("20000601", "10.12", "11.13")]
    assert {r["unit"] for r in rows(back)} == {"USH00000001"}
    (tmp_path / "in").mkdir()
    _gz(tmp_path / "in" / "USH00000001.csv.gz", "date,tmax_raw_c,tmax_adj_c\n20000601,1.0,2.0\n20000601,5.0,6.0\n"
        "20000602,,3.0\nbad,1.0,1.0\n20000101,1.0,1.0\n")
    out = rows(src.read_pair_csv(spark, str(tmp_path / "in"), (5, 6, 7, 8, 9)))
    assert out == [{"unit": "USH00000001", "day": dt.date(2000, 6, 1), "raw": 1.0, "adj": 2.0}]


def test_yearly_parquet_is_incremental_and_prunes(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([(1, 40.0, -100.0, 2000, 1.0), (1, 40.0, -100.0, 2001, 2.0), (2, 60.0, 10.0, 2001, 3.0)],
                               "unit int, lat double, lon double, year int, tmax double")
    writers.write_yearly(df.filter("year = 2000"), path)
    changed = df.withColumn("tmax", F.col("tmax") + 10)
    writers.write_yearly(changed, path)  # 2000 is kept, 2001 is new
    assert [r["tmax"] for r in rows(spark.read.parquet(path), "year", "unit")] == [1.0, 12.0, 13.0]
    writers.write_yearly(changed.filter("year = 2000"), path, rebuild=True)  # only 2000 is replaced
    assert [r["tmax"] for r in rows(spark.read.parquet(path), "year", "unit")] == [11.0, 12.0, 13.0]
    box = {"lat_min": 24.0, "lat_max": 50.0, "lon_min": -125.0, "lon_max": -66.0}
    scan = fields.read_panel(spark, path, ["unit", "year", "tmax"], box, (2001, 2001))
    assert [r["tmax"] for r in rows(scan)] == [12.0]
    text = plan_text(scan)
    assert "PartitionFilters: [isnotnull(year" in text and "GreaterThanOrEqual(lat,24.0)" in text


def test_field_scan(spark, tmp_path):
    path = str(tmp_path / "field")
    spark.createDataFrame([(35.0, 260.0, 0, dt.date(2000, 6, 1), 280.0), (35.0, 260.0, 1, dt.date(2000, 6, 1), 9.0),
                           (35.0, 100.0, 0, dt.date(2000, 6, 1), 281.0), (70.0, 260.0, 0, dt.date(2000, 6, 1), 282.0),
                           (36.0, 261.0, 0, dt.date(2000, 6, 1), 1e20), (35.0, 260.0, 0, dt.date(2000, 1, 1), 283.0)],
                          "latitude double, longitude double, z int, day date, value double").write.parquet(path)
    out = fields.read_field(spark, path, (51.0, 24.0), (-126.0, -65.0), (6, 7, 8), (1990, 2010), level=("z", 0))
    got = rows(fields.celsius_from_attribute(out, "Kelvin"), "lat")
    assert [(r["lat"], r["lon"], r["value"]) for r in got] == [(35.0, -100.0, pytest.approx(6.85)), (36.0, -99.0, None)]
    warm = rows(fields.celsius_by_mean(out.filter("value IS NOT NULL")))
    assert warm[0]["value"] == pytest.approx(6.85)
    same = fields.celsius_by_mean(out.withColumn("value", F.lit(20.0)))
    assert {r["value"] for r in rows(same)} == {20.0}


def test_thinning_keeps_every_fourth_row_and_column(spark):
    cells = spark.range(100).select((F.floor(F.col("id") / 10) * 0.25).alias("lat"), (F.col("id") % 10 * 0.25).alias("lon"))
    got = rows(fields.thin(cells, 4), "lat", "lon")
    assert [(r["lat"], r["lon"]) for r in got] == [(a, o) for a in (0.0, 1.0, 2.0) for o in (0.0, 1.0, 2.0)]


def test_periods_and_climatology(spark):
    a = spark.createDataFrame([(1, dt.date(2000, 12, 31), 1.0)], "cell int, day date, value double")
    b = spark.createDataFrame([(1, dt.date(2000, 12, 31), 5.0), (1, dt.date(2001, 1, 1), 6.0)], "cell int, day date, value double")
    both = fields.combine_periods([a, b])
    assert [r["value"] for r in rows(both, "day")] == [1.0, 6.0]
    clim = spark.createDataFrame([(1, 0, 10.0), (1, 364, 20.0)], "cell int, idx int, clim double")
    assert [r["value"] for r in rows(fields.absolute_from_anomaly(both, clim), "day")] == [21.0, 16.0]


def test_master_table_is_incremental(spark, tmp_path):
    calls = []

    def builder(name, shift):
        def run():
            calls.append(name)
            return spark.range(1900, 1910).select(F.col("id").alias("year"), (F.col("id") + shift).alias("value"))
        return run

    names = ["conus_records__ushcn", "conus_records__berkeley", "band_hw_days__era5"]
    builders = {n: builder(n, i) for i, n in enumerate(names)}
    first = master.build(None, builders, names[:2])
    table, cat = str(tmp_path / "t"), str(tmp_path / "c")
    writers.write_master(first, names[:2], (1900, 1926), table, cat, master.labels(spark))
    held = table_source.read_master(spark, table)
    assert held.count() == 27 and set(held.columns) == {"year", *names[:2]}
    todo = [n for n in master.wanted_columns(held.columns, datasets=["ushcn", "berkeley", "era5"]) if n in builders]
    assert todo == ["band_hw_days__era5"]
    calls.clear()
    second = master.build(held, builders, todo)
    assert calls == todo
    assert rows(second.groupBy("series").count(), "series") == [{"series": n, "count": 10} for n in sorted(names)]
    c = {r["series"]: r for r in rows(spark.read.option("header", True).csv(cat))}
    r = c["conus_records__berkeley"]
    assert (r["domain"], r["quantity"], r["dataset"], r["first_year"], r["last_year"], r["n_years"], r["label"]) == (
        "conus", "records", "berkeley", "1900", "1909", "10", "Berkeley Earth")
    with pytest.raises(ValueError, match="unknown"):
        master.wanted_columns([], datasets=["nothing"])
    with pytest.raises(ValueError, match="does not hold"):
        tables.require_columns(held, ["band_hw_days__era5"], "heat")
    assert rows(tables.one_series(held, names[0]).filter("year = 1905")) == [
        {"series": names[0], "year": 1905, "value": 1905.0}]
    assert tables.one_series(held, "absent") is None


def test_column_names_of_the_master_table():
    cols = master.all_columns()
    assert len(cols) == len(set(cols))
    assert "conus_jja_tavgmean_anom__20cr" in cols and "band_hw_days__ushcn" not in cols
    assert [e.series for e in master.ENTRIES if (e.section, e.dataset) == (1, "noaa")] == ["conus_jja_tavg_anom__noaa"]


def test_wide_days_and_crosswalk(spark):
    df = spark.createDataFrame([("a", dt.date(2000, 6, 1), 1.0), ("b", dt.date(2000, 6, 1), 2.0), ("b", dt.date(2000, 6, 2), 3.0)],
                               "unit string, day date, value double")
    assert [(r["a"], r["b"]) for r in rows(writers.wide_days(df, ["a", "b"]), "day")] == [(1.0, 2.0), (None, 3.0)]
    x = spark.createDataFrame([("n1", "A2345678901", 1), ("n1", "A2345678900", 2), ("n2", "short", 3), ("n3", "B2345678901", 4)],
                              "network_id string, archive_id string, ord int")
    o = spark.createDataFrame([("A2345678901",), ("A2345678900",), ("B2345678901",)], "archive_id string")
    s = spark.createDataFrame([("n1", 1.0, 2.0), ("n2", 1.0, 2.0)], "network_id string, lat double, lon double")
    assert rows(joins.crosswalk_chain(x, o, s)) == [
        {"network_id": "n1", "archive_id": "A2345678901", "lat": 1.0, "lon": 2.0}]
