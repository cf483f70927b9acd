"""Queries: archive text lines, rendered from the views and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import qc
from dayspell.queries import views
from dayspell.queries.registry import query, tidy
from dayspell.sources import stations


@query("daily_lines", """
SELECT 'S' || unit AS unit, day, round(tmax, 6) + 0.0 AS tmax, round(tmin, 6) + 0.0 AS tmin FROM daily
""", ("daily",))
def daily_lines(spark, d):
    """Raw rows as headerless CSV lines; a date in 41 is no date, and such a line gives no day."""
    line = F.concat_ws(",", F.concat(F.lit("S"), F.col("unit")), F.date_format("day", "yyyyMMdd"), "elem", F.col("value"),
                       F.lit(""), "qflag", F.lit("0"), F.lit("0700"))
    good = views.obs(spark, d).select(line.alias("value"), "ord")
    bad = views.obs(spark, d).filter("value % 5 = 0").select(
        F.concat(F.lit("S1,20000641,TMAX,"), F.col("value"), F.lit(",,,0,")).alias("value"), F.lit(-1).cast("long").alias("ord"))
    rows = stations.parse_daily(good.unionByName(bad))
    return tidy(qc.daily_panel(rows.filter(F.col("day").isNotNull())).select("unit", "day", "tmax", "tmin"))


def _fixed(column, width):
    return F.lpad(F.format_string("%.4f", column), width, " ")


@query("station_list_lines", """
SELECT 'X' || lpad(CAST(unit AS VARCHAR), 10, '0') AS unit, round(lat, 4) + 0.0 AS lat, round(lon, 4) + 0.0 AS lon FROM site
""", ("site",))
def station_list_lines(spark, d):
    name = F.concat(F.lit("X"), F.lpad(F.col("unit").cast("string"), 10, "0"))
    lines = views.site(spark, d).select(F.concat(
        name, F.lit(" "), _fixed(F.col("lat"), 8), F.lit(" "), _fixed(F.col("lon"), 9), F.lit("  123.4 A NAME")).alias("value"))
    return tidy(stations.parse_station_list(lines), 4)


@query("inventory_lines", """
SELECT 'X' || lpad(CAST(unit AS VARCHAR), 10, '0') AS unit, round(lat, 4) + 0.0 AS lat, round(lon, 4) + 0.0 AS lon
FROM site WHERE unit % 3 <> 0
""", ("site",))
def inventory_lines(spark, d):
    """Two elements a station; every third station lists no TMAX."""
    name = F.concat(F.lit("X"), F.lpad(F.col("unit").cast("string"), 10, "0"))
    elem = F.explode(F.when(F.col("unit") % 3 == 0, F.array(F.lit("PRCP"))).otherwise(F.array(F.lit("TMAX"), F.lit("TMIN"))))
    lines = views.site(spark, d).withColumn("elem", elem).select(F.concat(
        name, F.lit(" "), _fixed(F.col("lat"), 8), F.lit(" "), _fixed(F.col("lon"), 9), F.lit(" "), "elem", F.lit(" 1901 2020")).alias("value"))
    return tidy(stations.element_positions(stations.parse_inventory(lines)), 4)
