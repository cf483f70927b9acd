"""Queries: the master table and its catalogue, period combination, climatology sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import spells, tables
from dayspell.plans import anomalies as anomaly_plans
from dayspell.plans import heat as heat_plans
from dayspell.plans import master
from dayspell.plans import records as record_plans
from dayspell.queries import heat, monthly, records, views
from dayspell.queries.registry import query, tidy
from dayspell.sources import fields

_COLUMNS = ["conus_records__ushcn", "conus_hw_days__ushcn", "band_jja_tmax_anom__berkeley"]


def _builders(spark, d):
    def heat_days():
        counts = spells.heatwave_counts(heat._season(spark, d), **heat._RULE)
        reduced = heat_plans.reduce_stations(counts, views.station(spark, d), heat._land(spark), views.RADIUS_KM)
        return reduced.station_mean.select("year", F.col("hw_days").alias("value"))

    def anomaly():
        return anomaly_plans.band_anomaly(monthly._field(spark, d), monthly._cells(spark, d), baseline=views.BASE,
                                          min_base=views.MIN_BASE).select("year", "value")

    return {
        _COLUMNS[0]: lambda: record_plans.network_series(views.panel(spark, d), views.YEARS, **records._RULE),
        _COLUMNS[1]: heat_days,
        _COLUMNS[2]: anomaly,
    }


_LONG = (
    "WITH " + records._COMPLETE + records._credit("cr", "kept", "unit") + ","
    + heat._thresholds_sql("panel", "unit") + "," + heat._counts_sql("panel", "unit", True) + ","
    + monthly._SEASON_YEARS + "," + monthly._BAND.format(cells="station", key="unit").replace(
        "\nSELECT year, round(CASE", ",\nbandq AS (SELECT year, round(CASE").rstrip() + ")"
    + f""",
master AS (SELECT '{_COLUMNS[0]}' AS series, year, value FROM ({records._series('cr_n', 'unit')})
  UNION ALL SELECT '{_COLUMNS[1]}', year, sum(cos(radians(lat)) * hw_days) / sum(cos(radians(lat)))
    FROM counts JOIN station USING (unit) WHERE hw_days IS NOT NULL GROUP BY year
  UNION ALL SELECT '{_COLUMNS[2]}', year, value FROM bandq WHERE value IS NOT NULL)"""
)


@query("master_table", _LONG + """
SELECT y.year, """ + ", ".join(
    f"round(max(value) FILTER (WHERE series = '{c}'), 6) + 0.0 AS {c}" for c in _COLUMNS) + """
FROM (SELECT CAST(range AS INTEGER) AS year FROM range(1994, 2003)) y LEFT JOIN master ON master.year = y.year GROUP BY y.year
""", ("panel", "days", "station"))
def master_table(spark, d):
    wanted = master.wanted_columns([])
    long = master.build(None, _builders(spark, d), wanted)
    return tidy(tables.long_to_wide(long, _COLUMNS, (1994, 2002)))


@query("master_catalogue", _LONG + """
SELECT series, split_part(series, '_', 1) AS domain,
  substr(split_part(series, '__', 1), instr(series, '_') + 1) AS quantity, split_part(series, '__', 2) AS dataset,
  CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, count(*) AS n_years
FROM master WHERE value IS NOT NULL GROUP BY series
""", ("panel", "days", "station"))
def master_catalogue(spark, d):
    long = master.build(None, _builders(spark, d), _COLUMNS)
    return tables.describe_columns(long)


@query("combine_periods", """
WITH a AS (SELECT unit AS cell, day, value, 0 AS o FROM days WHERE year <= 1998),
b AS (SELECT unit AS cell, day, value + 1 AS value, 1 AS o FROM days WHERE year >= 1998)
SELECT cell, day, round(arg_min(value, o), 6) + 0.0 AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY cell, day
""", ("days",))
def combine_periods(spark, d):
    # both periods and their union stay in one layout by place and day, whose tasks do not grow with the tables
    f = views.days(spark, d, views.parts(spark, d)).withColumnRenamed("unit", "cell")
    first = f.filter("year <= 1998")
    second = f.filter("year >= 1998").withColumn("value", F.col("value") + 1)
    return tidy(fields.combine_periods([first, second]))


@query("absolute_from_anomaly", """
SELECT unit AS cell, day, round(value + (unit * 3 + least(dayofyear(day) - 1, 364)) % 17 / 10.0, 6) + 0.0 AS value FROM days
""", ("days",))
def absolute_from_anomaly(spark, d):
    f = views.days(spark, d).select(F.col("unit").alias("cell"), "day", "value")
    idx = F.explode(F.sequence(F.lit(0), F.lit(364))).alias("idx")
    clim = views.station(spark, d).select(F.col("unit").alias("cell"), idx)
    clim = clim.withColumn("clim", (F.col("cell") * 3 + F.col("idx")) % 17 / 10.0)
    return tidy(fields.absolute_from_anomaly(f, clim))


@query("celsius_by_mean", """
SELECT unit, day, round(value + 273.15 - 273.15, 6) + 0.0 AS value FROM days
""", ("days",))
def celsius_by_mean(spark, d):
    kelvin = views.days(spark, d).select("unit", "day", (F.col("value") + 273.15).alias("value"))
    return tidy(fields.celsius_by_mean(kelvin))


# odd years come in kelvin, even ones in degC; some kelvin files lack most days
@query("celsius_by_file", """
SELECT unit, day, year, round(value, 6) + 0.0 AS value FROM days WHERE year % 4 <> 3 OR month(day) = 7
""", ("days",))
def celsius_by_file(spark, d):
    mixed = views.days(spark, d).filter("year % 4 <> 3 or month(day) = 7").withColumn(
        "value", F.col("value") + F.when(F.col("year") % 2 == 1, 273.15).otherwise(0.0))
    return tidy(fields.celsius_by_mean(mixed, by="year").select("unit", "day", "year", "value"))
