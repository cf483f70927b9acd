"""Queries: thresholds, exceedance, runs, heat-wave days and their reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import gridding, spatial, spells, thresholds
from dayspell.plans import heat as plans
from dayspell.plans.store import written
from dayspell.queries import views
from dayspell.queries.records import FIELD_SQL, field
from dayspell.queries.registry import query, rounded, tidy
from dayspell.functions.dates import season_day

_RULE = dict(percentile=60, min_pool=20, min_run=3)


def _season(spark, d):
    return views.panel(spark, d).select(
        "unit", "year", season_day(F.col("day")).alias("doy"), "value")


def _thresholds_sql(source: str, key: str) -> str:
    return f"""
pool AS (SELECT t.{key}, t.doy, list_sort(list(p.value)) AS vals
  FROM (SELECT {key}, CAST(range AS INTEGER) AS doy FROM (SELECT DISTINCT {key} FROM {source}), range(1, 154)) t
  JOIN {source} p ON p.{key} = t.{key} AND p.doy BETWEEN t.doy - 3 AND t.doy + 3 GROUP BY ALL),
thr AS (SELECT {key}, doy, CAST(len(vals) AS INTEGER) AS n_pool, CASE WHEN len(vals) >= 20 THEN
  vals[CAST(least(floor(len(vals)::DOUBLE * 60::DOUBLE * 0.01::DOUBLE), len(vals) - 1) AS INTEGER) + 1] END AS threshold
  FROM pool)"""


def _counts_sql(source: str, key: str, gate: bool) -> str:
    tgate = f"AND tn.n / 153.0 >= 0.7" if gate else ""
    return f"""
hot AS (SELECT {key}, year, doy, doy - row_number() OVER (PARTITION BY {key}, year ORDER BY doy) AS island
  FROM {source} JOIN thr USING ({key}, doy) WHERE value >= threshold),
runs AS (SELECT {key}, year, island, count(*) AS n FROM hot GROUP BY ALL HAVING count(*) >= 3),
hw AS (SELECT {key}, year, sum(n) AS n FROM runs GROUP BY ALL),
tn AS (SELECT {key}, count(threshold) AS n FROM thr GROUP BY ALL),
held AS (SELECT {key}, year, count(*) AS n_days FROM {source} GROUP BY ALL),
counts AS (SELECT h.{key}, h.year, h.n_days, CASE WHEN h.n_days / 153.0 >= 0.7 {tgate}
     THEN CAST(coalesce(hw.n, 0) AS INTEGER) END AS hw_days
  FROM held h JOIN tn ON tn.{key} = h.{key} LEFT JOIN hw ON hw.{key} = h.{key} AND hw.year = h.year)"""


@query("heat_thresholds", "WITH " + _thresholds_sql("panel", "unit") + """
SELECT unit, doy, n_pool, threshold FROM thr
""", ("panel",))
def heat_thresholds(spark, d):
    return thresholds.heat_thresholds(_season(spark, d), percentile=60, min_pool=20)


@query("heat_thresholds_linear", """
SELECT t.unit, t.doy, CAST(count(*) AS INTEGER) AS n_pool,
   CASE WHEN count(*) >= 30 THEN round(quantile_cont(p.value, 0.9), 6) + 0.0 END AS threshold
FROM (SELECT unit, CAST(range AS INTEGER) AS doy FROM (SELECT DISTINCT unit FROM panel), range(1, 154)) t
JOIN panel p ON p.unit = t.unit AND p.doy BETWEEN t.doy - 3 AND t.doy + 3 GROUP BY t.unit, t.doy
""", ("panel",))
def heat_thresholds_linear(spark, d):
    return tidy(thresholds.heat_thresholds(_season(spark, d), min_pool=30, method="linear"))


@query("hot_spell_days", """
WITH hot AS (SELECT unit, year, doy, value, doy - row_number() OVER (PARTITION BY unit, year ORDER BY doy) AS island
  FROM panel WHERE value >= 35)
SELECT unit, year, doy, value, count(*) OVER (PARTITION BY unit, year, island) AS run_length FROM hot
QUALIFY run_length >= 3
""", ("panel",))
def hot_spell_days(spark, d):
    return spells.spell_days(_season(spark, d), F.col("value") >= 35, min_run=3).select(
        "unit", "year", "doy", "value", "run_length")


@query("heatwave_counts_stations", "WITH " + _thresholds_sql("panel", "unit") + "," + _counts_sql(
    "panel", "unit", True) + " SELECT unit, year, n_days, hw_days FROM counts", ("panel",))
def heatwave_counts_stations(spark, d):
    return spells.heatwave_counts(_season(spark, d), **_RULE)


@query("heatwave_station_mean", "WITH " + _thresholds_sql("panel", "unit") + "," + _counts_sql(
    "panel", "unit", True) + """
SELECT year, round(sum(cos(radians(lat)) * hw_days) / sum(cos(radians(lat))), 6) + 0.0 AS hw_days,
   round(sum(cos(radians(lat))) / (SELECT sum(cos(radians(lat))) FROM station), 6) + 0.0 AS coverage
FROM counts JOIN station USING (unit) WHERE hw_days IS NOT NULL GROUP BY year
""", ("panel", "station"))
def heatwave_station_mean(spark, d):
    counts = spells.heatwave_counts(_season(spark, d), **_RULE)
    return tidy(plans.reduce_stations(counts, views.station(spark, d), _land(spark), views.RADIUS_KM).station_mean)


def _land(spark):
    return views.grid(spark).filter("land").select("cell", "lat", "lon")


_GRID_FIELD = FIELD_SQL + """,
fs AS (SELECT cell, year, CAST(dayofyear(day) - CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0)
         THEN 121 ELSE 120 END AS INTEGER) AS doy, value FROM field WHERE month(day) BETWEEN 5 AND 9),"""


def _grid_counts(spark, d):
    season = plans.season_panel(field(spark, d), ("cell",), "value")
    return plans.grid_counts(season, **_RULE)


@query("heatwave_counts_grid", "WITH " + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql(
    "fs", "cell", False) + " SELECT cell, year, n_days, hw_days FROM counts", ("days", "station"))
def heatwave_counts_grid(spark, d):
    return _grid_counts(spark, d)


@query("heatwave_series_grid", "WITH " + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql(
    "fs", "cell", False) + """,
dom AS (SELECT cell, cos(radians(lat)) AS w FROM grid WHERE land AND lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -65)
SELECT year, round(sum(w * hw_days) / sum(w), 6) + 0.0 AS hw_days,
       round(sum(w) / (SELECT sum(w) FROM dom), 6) + 0.0 AS coverage
FROM counts JOIN dom USING (cell) WHERE hw_days IS NOT NULL GROUP BY year
""", ("days", "station", "grid"))
def heatwave_series_grid(spark, d):
    return tidy(plans.grid_series(_grid_counts(spark, d), _land(spark), lon_bounds=(-125.0, -65.0)))


RADIAL_SQL = """
land AS (SELECT cell, lat, lon FROM grid WHERE land),
radial AS (SELECT cell, unit, km FROM (SELECT g.cell, s.unit,
   6335.44 * atan(sqrt((cos(radians(g.lat)) * sin(radians(s.lon - g.lon))) ** 2
     + (cos(radians(s.lat)) * sin(radians(g.lat)) - sin(radians(s.lat)) * cos(radians(g.lat)) * cos(radians(s.lon - g.lon))) ** 2)
     / (sin(radians(s.lat)) * sin(radians(g.lat)) + cos(radians(s.lat)) * cos(radians(g.lat)) * cos(radians(s.lon - g.lon)))) AS km
   FROM land g, {stations} s) WHERE km >= 0 AND km < 300)"""
_IDW = """,
idw AS (SELECT cell, year, sum(w * hw_days) / sum(w) AS hw_days, count(*) AS n_stations FROM (
   SELECT cell, year, hw_days, (300.0 / greatest(km, 0.001)) ** 2 AS w FROM {counts} JOIN radial USING (unit)
   WHERE hw_days IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2 OR sqrt(sum(w)) > 1.5)"""
_AREA = """
SELECT year, round(sum(cos(radians(lat)) * hw_days) / sum(cos(radians(lat))), 6) + 0.0 AS hw_days,
   round(sum(cos(radians(lat))) / (SELECT sum(cos(radians(lat))) FROM {dom}), 6) + 0.0 AS coverage
FROM {field} JOIN {dom} USING (cell) WHERE hw_days IS NOT NULL GROUP BY year"""
_STATION_IDW = "WITH " + _thresholds_sql("panel", "unit") + "," + _counts_sql("panel", "unit", True) + "," \
    + RADIAL_SQL.format(stations="station") + _IDW.format(counts="counts")
_USES = ("panel", "station", "grid")


def _station_counts(spark, d):
    return spells.heatwave_counts(_season(spark, d), **_RULE)


def _reduced(spark, d):
    return plans.reduce_stations(_station_counts(spark, d), views.station(spark, d), _land(spark), views.RADIUS_KM)


@query("heatwave_idw_field", _STATION_IDW + """
SELECT cell, year, round(hw_days, 6) + 0.0 AS hw_days, n_stations FROM idw""", _USES)
def heatwave_idw_field(spark, d):
    return tidy(_reduced(spark, d).field)


@query("heatwave_idw_series", _STATION_IDW + _AREA.format(field="idw", dom="land"), _USES)
def heatwave_idw_series(spark, d):
    return tidy(_reduced(spark, d).series)


@query("heatwave_idw_coverage", _STATION_IDW + """
SELECT year, round(sum(cos(radians(lat))) / (SELECT sum(cos(radians(lat))) FROM land), 6) + 0.0 AS coverage
FROM idw JOIN land USING (cell) GROUP BY year""", _USES)
def heatwave_idw_coverage(spark, d):
    return tidy(_reduced(spark, d).coverage)


@query("heatwave_idw_fixed_cells", _STATION_IDW + """,
fixed AS (SELECT * FROM land WHERE cell IN (SELECT cell FROM idw GROUP BY cell
          HAVING count(*) = (SELECT count(DISTINCT year) FROM idw)))
SELECT year, hw_days FROM (""" + _AREA.format(field="idw", dom="fixed") + ")", _USES)
def heatwave_idw_fixed_cells(spark, d):
    return tidy(_reduced(spark, d).fixed_series)


@query("heatwave_fixed_cell_list", _STATION_IDW + """
SELECT cell FROM idw GROUP BY cell HAVING count(*) = (SELECT count(DISTINCT year) FROM idw)""", _USES)
def heatwave_fixed_cell_list(spark, d):
    return gridding.fixed_cells(written(_reduced(spark, d).field))


@query("heatwave_at_network", "WITH " + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql(
    "fs", "cell", False) + """,
sited AS (SELECT unit, lat, lon, CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell
  FROM site WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29),
pseudo AS (SELECT unit, year, hw_days FROM sited JOIN counts USING (cell)),""" + RADIAL_SQL.format(stations="site")
       + _IDW.format(counts="pseudo") + _AREA.format(field="idw", dom="land"), ("days", "station", "grid", "site"))
def heatwave_at_network(spark, d):
    return tidy(plans.reduce_at_network(written(_grid_counts(spark, d)), views.site(spark, d), views.GRID, _land(spark),
                                        views.RADIUS_KM).series)


@query("heatwave_at_network_mean", "WITH " + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql(
    "fs", "cell", False) + """,
sited AS (SELECT unit, lat, CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell
  FROM site WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29)
SELECT year, round(sum(cos(radians(lat)) * hw_days) / sum(cos(radians(lat))), 6) + 0.0 AS hw_days,
   round(sum(cos(radians(lat))) / (SELECT sum(cos(radians(lat))) FROM sited), 6) + 0.0 AS coverage
FROM sited JOIN counts USING (cell) WHERE hw_days IS NOT NULL GROUP BY year
""", ("days", "station", "site"))
def heatwave_at_network_mean(spark, d):
    return tidy(plans.reduce_at_network(written(_grid_counts(spark, d)), views.site(spark, d), views.GRID, _land(spark),
                                        views.RADIUS_KM).station_mean)


@query("heatwave_counts_at_sites", "WITH " + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql(
    "fs", "cell", False) + """,
sited AS (SELECT unit, CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell
  FROM site WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29)
SELECT unit, year, hw_days FROM sited JOIN counts USING (cell)
""", ("days", "station", "site"))
def heatwave_counts_at_sites(spark, d):
    return plans.counts_at_network(_grid_counts(spark, d), views.site(spark, d), views.GRID)


@query("heatwave_co_sampled", _STATION_IDW.replace("pool AS", "spool AS").replace("FROM pool", "FROM spool")
       .replace("thr AS", "sthr AS").replace("JOIN thr", "JOIN sthr").replace("FROM thr", "FROM sthr")
       .replace("hot AS", "shot AS").replace("FROM hot", "FROM shot")
       .replace("runs AS", "sruns AS").replace("FROM runs", "FROM sruns")
       .replace("hw AS", "shw AS").replace("JOIN hw ON hw", "JOIN shw hw ON hw")
       .replace("tn AS", "stn AS").replace("JOIN tn ON tn", "JOIN stn tn ON tn")
       .replace("held AS", "sheld AS").replace("FROM held", "FROM sheld")
       .replace("counts AS", "scounts AS").replace("FROM counts", "FROM scounts")
       + "," + _GRID_FIELD + _thresholds_sql("fs", "cell") + "," + _counts_sql("fs", "cell", False) + """,
shared AS (SELECT counts.cell, counts.year, counts.hw_days FROM counts SEMI JOIN idw USING (cell, year))"""
       + _AREA.format(field="shared", dom="land"), ("panel", "days", "station", "grid"))
def heatwave_co_sampled(spark, d):
    return tidy(plans.co_sampled_series(_grid_counts(spark, d), written(_reduced(spark, d).field), _land(spark)))


@query("footprint_similarity", "WITH " + _GRID_FIELD.rstrip(",") + "," + RADIAL_SQL.format(stations="station") + """,
a AS (SELECT DISTINCT cell FROM field), b AS (SELECT DISTINCT cell FROM radial)
SELECT round(count(*) FILTER (WHERE a.cell IS NOT NULL AND b.cell IS NOT NULL) / count(*), 6) + 0.0 AS jaccard
FROM a FULL JOIN b ON a.cell = b.cell
""", ("days", "station", "grid"))
def footprint_similarity(spark, d):
    near = spatial.radial_pairs(_land(spark), views.station(spark, d), views.RADIUS_KM)
    return tidy(gridding.mask_similarity(field(spark, d).select("cell").distinct(), near.select("cell").distinct()))


# ---- exceedance against an interpolated percentile --------------------------------

_JJA = """
jja AS (SELECT unit AS cell, year, CAST(dayofyear(day) AS INTEGER) AS doy, value FROM days WHERE month(day) BETWEEN 6 AND 8),
ring AS (SELECT {doys} AS doy),
thr AS (SELECT t.cell, t.doy, CAST(count(*) AS INTEGER) AS n_pool, quantile_cont(p.value, 0.95) AS threshold
  FROM (SELECT cell, CAST(range AS INTEGER) AS doy FROM (SELECT DISTINCT cell FROM jja), range(152, 245)) t
  JOIN jja p ON p.cell = t.cell AND p.doy BETWEEN t.doy - 14 AND t.doy + 16 GROUP BY t.cell, t.doy)""".replace(
    "ring AS (SELECT {doys} AS doy),\n", "")


def _jja(spark, d):
    days = views.days(spark, d).withColumnRenamed("unit", "cell").filter(F.month("day").between(6, 8))
    return days.select("cell", "year", F.dayofyear("day").alias("doy"), "value")


@query("doy_percentile", "WITH " + _JJA + """
SELECT cell, doy, n_pool, round(threshold, 6) + 0.0 AS threshold FROM thr
""", ("days",))
def doy_percentile(spark, d):
    return tidy(thresholds.exceedance_thresholds(_jja(spark, d)))


@query("doy_percentile_whole_year", """
WITH o AS (SELECT unit AS cell, CAST(dayofyear(day) AS INTEGER) AS doy, value FROM days),
t AS (SELECT cell, CAST((doy + 14 - CAST(range AS INTEGER) - 1 + 366) % 366 + 1 AS INTEGER) AS doy, value FROM o, range(31))
SELECT cell, doy, CAST(count(*) AS INTEGER) AS n_pool, round(quantile_cont(value, 0.95), 6) + 0.0 AS threshold
FROM t GROUP BY cell, doy
""", ("days",))
def doy_percentile_whole_year(spark, d):
    days = views.days(spark, d).select(F.col("unit").alias("cell"), "year", F.dayofyear("day").alias("doy"), "value")
    return tidy(thresholds.exceedance_thresholds(days, months=tuple(range(1, 13))))


@query("exceedance_map", "WITH " + _JJA + """,
axis AS (SELECT year, count(*) AS n FROM (SELECT DISTINCT year, doy FROM jja) GROUP BY year),
yr AS (SELECT j.cell, j.year, count(*) FILTER (WHERE value > threshold) / max(n) * 100.0 AS share
  FROM jja j JOIN thr USING (cell, doy) JOIN axis ON axis.year = j.year GROUP BY ALL),
e AS (SELECT cell, sum(CASE WHEN year BETWEEN 1995 AND 1997 THEN share ELSE 0 END) / 3 AS early,
             sum(CASE WHEN year BETWEEN 1999 AND 2001 THEN share ELSE 0 END) / 3 AS late FROM yr GROUP BY cell)
SELECT cell, round(early, 6) + 0.0 AS early, round(late, 6) + 0.0 AS late, round(late - early, 6) + 0.0 AS difference
FROM e JOIN station ON unit = cell WHERE land
""", ("days", "station"))
def exceedance_map(spark, d):
    land = views.station(spark, d).filter("land").select(F.col("unit").alias("cell"))
    days = written(_jja(spark, d))  # the counts and the time axis read it
    return tidy(plans.exceedance_map_of_season(days, views.ERAS, land=land))
