"""Queries: spatial joins and gridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import spatial
from dayspell.plans import stations as plans
from dayspell.queries import views
from dayspell.queries.heat import RADIAL_SQL
from dayspell.queries.monthly import NEAREST_SQL
from dayspell.queries.registry import query, tidy


@query("near_pairs", "WITH " + NEAREST_SQL.format(cells="grid") + """
SELECT cell, unit, round(km, 5) + 0.0 AS km FROM pairs
""", ("site", "site_months", "grid"))
def near_pairs(spark, d):
    return tidy(spatial.near_pairs(views.grid(spark), views.site(spark, d), views.RADIUS_KM), 5)


@query("radial_pairs", "WITH " + RADIAL_SQL.format(stations="site") + """
SELECT cell, unit, round(km, 5) + 0.0 AS km FROM radial
""", ("site", "grid"))
def radial_pairs(spark, d):
    land = views.grid(spark).filter("land")
    return tidy(spatial.radial_pairs(land, views.site(spark, d), views.RADIUS_KM), 5)


_INSIDE = """
ins AS (SELECT unit, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
    THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM site, (SELECT * FROM edges WHERE y1 <> y2) GROUP BY unit)"""


@query("sites_in_polygon", "WITH " + _INSIDE + " SELECT unit, lat, lon, inside FROM site JOIN ins USING (unit)",
       ("site", "edges"))
def sites_in_polygon(spark, d):
    edges = spatial.polygon_edges(views.polygon(spark))
    return spatial.points_inside(views.site(spark, d), edges).select("unit", "lat", "lon", "inside")


@query("polygon_daily_counts", "WITH " + _INSIDE + """
SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_rows FROM lineitem JOIN ins ON unit = l_suppkey
WHERE inside GROUP BY ALL
""", ("site", "edges"))
def polygon_daily_counts(spark, d):
    edges = spatial.polygon_edges(views.polygon(spark))
    kept = spatial.points_inside(views.site(spark, d), edges).filter("inside").select("unit")
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_shipdate").cast("date").alias("day"))
    return rows.join(kept, "unit", "left_semi").groupBy("day").agg(F.count("*").alias("n_rows"))


# two halves of one area drawn in opposite directions, and a third polygon that overlaps both
_PATCHES = (
    (1, ((-110.0, 30.0), (-100.0, 30.0), (-100.0, 40.0), (-110.0, 40.0))),
    (2, ((-100.0, 30.0), (-100.0, 40.0), (-90.0, 40.0), (-90.0, 30.0))),
    (3, ((-105.0, 33.0), (-95.0, 33.0), (-95.0, 37.0), (-105.0, 37.0))),
)


def _patches(spark, polys):
    return spatial.polygon_edges(spark.createDataFrame(
        [(p, 0, i, x, y) for p, ring in _PATCHES if p in polys for i, (x, y) in enumerate(ring)],
        "poly int, ring int, seq int, lon double, lat double"))


@query("sites_in_any_polygon", """
SELECT unit, lat BETWEEN 30 AND 40 AND lon >= -110 AND lon < -90 AS inside, count(*) AS n_rows
FROM site JOIN lineitem ON unit = l_suppkey GROUP BY ALL
""", ("site",))
def sites_in_any_polygon(spark, d):
    found = spatial.points_inside(views.site(spark, d), _patches(spark, (1, 2, 3)), closed=True)
    n = views.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.count("*").alias("n_rows"))
    return found.join(n, "unit").select("unit", "inside", "n_rows")


@query("cells_of_two_halves", """
WITH c AS (SELECT cell, greatest(0, least(lat + 1, 40) - greatest(lat - 1, 30)) * greatest(0, least(lon + 1, -90) - greatest(lon - 1, -110)) / 4 AS fraction,
                  greatest(0, least(lat + 1, 37) - greatest(lat - 1, 33)) * greatest(0, least(lon + 1, -95) - greatest(lon - 1, -105)) / 4 AS lake FROM grid),
s AS (SELECT CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell, count(*) AS n_sites FROM site
      WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29 GROUP BY ALL)
SELECT cell, round(fraction - lake, 6) + 0.0 AS fraction, coalesce(n_sites, 0) AS n_sites
FROM c LEFT JOIN s USING (cell) WHERE fraction - lake > 1e-12
""", ("grid", "site"))
def cells_of_two_halves(spark, d):
    land = spatial.cell_fractions(_patches(spark, (1, 2)), views.GRID, ("cell",))
    dry = spatial.subtract_fractions(land, spatial.cell_fractions(_patches(spark, (3,)), views.GRID, ("cell",)))
    n = views.GRID.snap(views.site(spark, d)).groupBy("cell").agg(F.count("*").alias("n_sites"))
    return tidy(dry.join(n, "cell", "left").na.fill(0, ["n_sites"]).select("cell", "fraction", "n_sites"))


@query("grid_stations_2deg", """
SELECT CAST(least(greatest(trunc((lat - 24) / 2), 0), 12) * 180 + least(greatest(trunc((lon + 180) / 2), 0), 179) AS BIGINT)
         AS cell, day, round(avg(tmax), 6) + 0.0 AS value, count(*) AS n_stations
FROM daily JOIN station USING (unit) WHERE tmax IS NOT NULL GROUP BY ALL
""", ("daily", "station"))
def grid_stations_2deg(spark, d):
    located = views.daily(spark, d).join(views.station(spark, d).select("unit", "lat", "lon"), "unit")
    return tidy(plans.grid_stations(located))


@query("snap_to_grid", """
SELECT CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell, count(*) AS n_sites
FROM site WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29
GROUP BY ALL
""", ("site",))
def snap_to_grid(spark, d):
    return views.GRID.snap(views.site(spark, d)).groupBy("cell").agg(F.count("*").alias("n_sites"))


@query("site_axis_edges", """
WITH c AS (SELECT DISTINCT lat AS centre FROM site),
w AS (SELECT centre, lag(centre) OVER o AS b, lead(centre) OVER o AS a, row_number() OVER o - 1 AS idx FROM c
      WINDOW o AS (ORDER BY centre))
SELECT 'lat' AS axis, CAST(idx AS INTEGER) AS idx, centre,
   round(CASE WHEN b IS NULL THEN centre - (a - centre) / 2 ELSE b + (centre - b) / 2 END, 6) + 0.0 AS lo,
   round(CASE WHEN a IS NULL THEN centre + (centre - b) / 2 ELSE centre + (a - centre) / 2 END, 6) + 0.0 AS hi
FROM w
""", ("site",))
def site_axis_edges(spark, d):
    axis = views.site(spark, d).select(F.lit("lat").alias("axis"), F.col("lat").alias("centre"))
    return tidy(spatial.axis_edges(axis))
