"""Queries: what the writers write, read back by the matching readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayspell.operators import tables
from dayspell.plans.store import shared_folder
from dayspell.queries import views
from dayspell.queries.records import _PAIR, FIELD_SQL, field, pair_days
from dayspell.queries.registry import query, tidy
from dayspell.sinks import writers
from dayspell.sources import fields, stations
from dayspell.sources import tables as table_source


def _folder(spark):
    return f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"


@query("station_csv_files", "WITH " + _PAIR.rstrip(",") + """
SELECT CAST(unit AS VARCHAR) AS unit, day, round(raw, 6) + 0.0 AS raw, round(adj, 6) + 0.0 AS adj FROM legs WHERE month(day) BETWEEN 6 AND 8
""", ("panel",))
def station_csv_files(spark, d):
    """One gzip file group per station, two decimals; the station is read from the folder's name."""
    path = _folder(spark)
    pairs = pair_days(spark, d).select("unit", "day", F.col("raw").alias("tmax_raw"), F.col("adj").alias("tmax_adj"))
    writers.write_station_csv(pairs, path)
    return tidy(stations.read_pair_csv(spark, f"{path}/*/*.csv.gz", months=(6, 7, 8)))


@query("yearly_panel_files", """
SELECT unit, day, CAST(p.year AS INTEGER) AS year, round(value, 6) + 0.0 AS value FROM panel p JOIN station USING (unit)
WHERE p.year BETWEEN 1996 AND 2000 AND lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66
""", ("panel", "station"))
def yearly_panel_files(spark, d):
    """Yearly Parquet: the second write skips the years that the first one made; the box and the years are cut by the reader."""
    path = _folder(spark)
    placed = views.panel(spark, d).join(views.station(spark, d).select("unit", "lat", "lon"), "unit")
    writers.write_yearly(placed.filter("year <= 1997"), path)
    writers.write_yearly(placed.withColumn("value", F.when(F.col("year") <= 1997, -99.0).otherwise(F.col("value"))), path)
    box = {"lat_min": 24.0, "lat_max": 50.0, "lon_min": -125.0, "lon_max": -66.0}
    return tidy(fields.read_panel(spark, path, ("unit", "day", "year", "value"), box=box, years=(1996, 2000)))


@query("yearly_field_files", "WITH " + FIELD_SQL + """
SELECT lat, lon, day, year, round(value, 6) + 0.0 AS value
FROM (SELECT CAST(25 + 2 * (cell // 30) AS DOUBLE) AS lat, CAST(-124 + 2 * (cell % 30) AS DOUBLE) AS lon, day, year, value FROM field)
WHERE lat BETWEEN 27 AND 45 AND lon BETWEEN -120 AND -70 AND year BETWEEN 1995 AND 1999 AND month(day) BETWEEN 6 AND 8
""", ("days", "station"))
def yearly_field_files(spark, d):
    """A gridded field stored with 0-360 longitudes and other names, read by window, years and months."""
    path = _folder(spark)
    lon = -124.0 + 2.0 * (F.col("cell") % 30)
    named = field(spark, d).select((25.0 + 2.0 * F.floor(F.col("cell") / 30)).alias("latitude"), (lon + 360.0).alias("longitude"), "day", "year", "value")
    writers.write_yearly(named, path)
    out = fields.read_field(spark, path, lat_bounds=(45.0, 27.0), lon_bounds=(-120.0, -70.0), months=(6, 7, 8), years=(1995, 1999))
    return tidy(out.select("lat", "lon", "day", "year", "value"))


@query("series_csv_file", """
SELECT series, year, round(round(value, 4), 6) + 0.0 AS value
FROM (SELECT 'm' || month(day) AS series, CAST(year AS INTEGER) AS year, avg(value) AS value FROM panel GROUP BY ALL)
WHERE year BETWEEN 1995 AND 2001
""", ("panel",))
def series_csv_file(spark, d):
    """A year x series CSV of four decimals, read as the master table is and turned long again."""
    path = _folder(spark)
    months = views.panel(spark, d).groupBy(F.concat(F.lit("m"), F.month("day")).alias("series"), "year").agg(F.avg("value").alias("value"))
    writers.write_series_csv(months, [f"m{m}" for m in range(5, 10)], (1995, 2001), path)
    return tidy(tables.wide_to_long(table_source.read_master(spark, path)))


@query("station_table_files", """
SELECT CAST(unit AS VARCHAR) AS unit, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, n FROM station
JOIN (SELECT unit, count(*) AS n FROM panel GROUP BY unit) USING (unit)
""", ("panel", "station"))
def station_table_files(spark, d):
    """A station list as CSV with a header beside station sums as Parquet."""
    path = _folder(spark)
    writers.write_csv(views.station(spark, d).select("unit", "lat", "lon"), f"{path}/list")
    writers.write_table(views.panel(spark, d).groupBy(F.col("unit").cast("string").alias("unit")).agg(F.count("*").alias("n")), f"{path}/sums")
    listed = stations.read_header_csv(spark, f"{path}/list", "unit string, lat double, lon double")
    return tidy(listed.join(spark.read.parquet(f"{path}/sums"), "unit"))
