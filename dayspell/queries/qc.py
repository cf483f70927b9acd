"""Queries: quality control, panels, coverage and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.functions import dates, geo
from dayspell.operators import coverage, guards, joins, qc
from dayspell.plans import stations
from dayspell.queries import views
from dayspell.queries.registry import query, rounded, tidy


@query("qc_station_band", """
SELECT unit, day, tmax, tmin, lat, lon FROM daily JOIN station USING (unit) WHERE lat BETWEEN 24 AND 50
""", ("daily", "station"))
def qc_station_band(spark, d):
    out = stations.qc_station_band(views.obs(spark, d), views.station(spark, d))
    return out.select("unit", "day", "tmax", "tmin", "lat", "lon")


@query("qc_gate_counts", """
SELECT unit, elem, count(*) AS n_rows, count(*) FILTER (WHERE qflag = '') AS n_unflagged,
       count(*) FILTER (WHERE qflag = '' AND value BETWEEN 100 AND 400) AS n_bounded,
       count(*) FILTER (WHERE qflag = '' AND value BETWEEN 100 AND 400 AND month(day) BETWEEN 5 AND 9
                        AND year(day) BETWEEN 1996 AND 2000) AS n_season
FROM obs GROUP BY unit, elem
""", ("obs",))
def qc_gate_counts(spark, d):
    raw = qc.select_elements(views.obs(spark, d))
    clean = qc.unflagged(raw.columns) & qc.is_real()
    bounded = clean & qc.is_within(bounds=(100, 400))
    season = bounded & qc.is_in_season(years=(1996, 2000))
    gates = (("n_unflagged", clean), ("n_bounded", bounded), ("n_season", season))
    return raw.groupBy("unit", "elem").agg(
        F.count("*").alias("n_rows"), *[F.count(F.when(gate, 1)).alias(name) for name, gate in gates])


@query("qc_slot_cube", """
SELECT unit, CAST(year(day) AS INTEGER) AS year,
       CAST(CASE WHEN year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0)
                   OR dayofyear(day) <= 59 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS INTEGER) AS slot,
       arg_min(value, ord) FILTER (WHERE elem = 'TMAX') AS tmax,
       arg_min(value, ord) FILTER (WHERE elem = 'TMIN') AS tmin
FROM obs WHERE qflag = '' GROUP BY unit, day
""", ("obs",))
def qc_slot_cube(spark, d):
    return stations.qc_cube(views.obs(spark, d), views.station(spark, d).select("unit"))


@query("slot_cube_days", """
SELECT unit, CAST(year(day) AS INTEGER) AS year, day, CAST(tmax * 10 AS INTEGER) AS tmax,
       CAST(tmin * 10 AS INTEGER) AS tmin FROM daily
""", ("daily",))
def slot_cube_days(spark, d):
    return qc.slots_to_days(stations.qc_cube(views.obs(spark, d))).select("unit", "year", "day", "tmax", "tmin")


@query("cube_rebuild_diff", """
WITH a AS (SELECT unit, day, arg_min(value, ord) FILTER (WHERE elem = 'TMAX') AS tmax,
                  arg_min(value, ord) FILTER (WHERE elem = 'TMIN') AS tmin FROM obs GROUP BY ALL),
b AS (SELECT unit, day, arg_min(value, ord) FILTER (WHERE elem = 'TMAX') AS tmax,
             arg_min(value, ord) FILTER (WHERE elem = 'TMIN') AS tmin FROM obs WHERE qflag = '' GROUP BY ALL),
j AS (SELECT a.tmax AS ax, a.tmin AS an, b.tmax AS bx, b.tmin AS bn FROM a FULL JOIN b USING (unit, day)),
r AS (SELECT 'tmax' AS name, ax AS o, bx AS n FROM j UNION ALL SELECT 'tmin', an, bn FROM j)
SELECT name, count(o) AS n_old, count(n) AS n_new, count(*) FILTER (WHERE o IS NOT NULL AND n IS NULL) AS only_old,
       count(*) FILTER (WHERE o IS NULL AND n IS NOT NULL) AS only_new,
       CAST(coalesce(max(abs(o - n)), 0) AS DOUBLE) AS max_abs_diff,
       count(*) FILTER (WHERE (o IS NULL) <> (n IS NULL)) = 0 AND coalesce(max(abs(o - n)), 0) < 1e-4 AS same
FROM r GROUP BY name
""", ("obs",))
def cube_rebuild_diff(spark, d):
    raw = views.obs(spark, d)
    ignoring_flags = stations.qc_cube(raw.drop("qflag"))
    return joins.differences(ignoring_flags, stations.qc_cube(raw), ["unit", "year", "slot"], ["tmax", "tmin"])


@query("coverage_table", """
SELECT unit, count(DISTINCT year) AS n_years, count(*) AS n_days,
       round(count(*) / (7.0 * 153), 6) + 0.0 AS share,
       count(DISTINCT year) >= 5 AND count(*) / (7.0 * 153) >= 0.8 AS complete
FROM panel GROUP BY unit
""", ("panel",))
def coverage_table(spark, d):
    c = coverage.coverage(views.panel(spark, d), span_years=7)
    complete = (F.col("n_years") >= 5) & (F.col("share") >= 0.8)
    return tidy(c.withColumn("complete", complete))


@query("coverage_matrix", """
SELECT unit, """ + ", ".join(f'count(*) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1995, 2002)) + """
FROM panel GROUP BY unit
""", ("panel",))
def coverage_matrix(spark, d):
    return coverage.coverage_matrix(views.panel(spark, d), views.YEARS)


@query("complete_units_days", """
SELECT p.unit, p.day, p.value FROM panel p
JOIN (SELECT unit FROM panel GROUP BY unit HAVING count(DISTINCT year) >= 5 AND count(*) / (7.0 * 153) >= 0.88)
USING (unit)
""", ("panel",))
def complete_units_days(spark, d):
    return coverage.keep_complete(views.panel(spark, d), 7, 5, 0.88).select("unit", "day", "value")


@query("heat_screen", """
WITH y AS (SELECT unit, year, count(*) AS n FROM panel GROUP BY ALL)
SELECT unit, CAST(sum(n) AS BIGINT) AS n_days FROM y GROUP BY unit HAVING sum(n) >= 352 AND max(n) >= 123
""", ("panel",))
def heat_screen(spark, d):
    # 80% of 153 days is 123 days; 123 windows of 20 values over 7 days is 352 days
    kept = coverage.lossless_screen(views.panel(spark, d), min_share=0.8, min_pool=20)
    return kept.groupBy("unit").agg(F.count("*").alias("n_days"))


@query("calendar_reindex", """
WITH c AS (SELECT unit, CAST(d AS DATE) AS day FROM (SELECT DISTINCT unit FROM panel),
           range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d) WHERE month(d) BETWEEN 5 AND 9)
SELECT unit, day, value, value IS NULL AS gap FROM c LEFT JOIN panel USING (unit, day)
""", ("panel",))
def calendar_reindex(spark, d):
    full = joins.on_calendar(views.panel(spark, d).select("unit", "day", "value"), views.YEARS)
    return full.withColumn("gap", F.col("value").isNull())


@query("calendar_fields", """
WITH x AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
l AS (SELECT day, year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0) AS leap FROM x)
SELECT day, leap, CAST(dayofyear(day) - CASE WHEN leap THEN 121 ELSE 120 END AS INTEGER) AS season_day,
       CAST(CASE WHEN leap OR dayofyear(day) <= 59 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS INTEGER) AS slot,
       CAST(month(day) * 100 + day(day) AS INTEGER) AS month_day,
       CAST(day(last_day(day)) AS INTEGER) AS month_length,
       CAST(strftime(day, '%Y%m%d') AS INTEGER) AS yyyymmdd, day AS again, day AS parsed
FROM l
""")
def calendar_fields(spark, d):
    days = views.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    day = F.col("day")
    return days.select(
        "day", dates.is_leap(F.year(day)).alias("leap"), dates.season_day(day).alias("season_day"),
        dates.leap_slot(day).alias("slot"), dates.month_day(day).alias("month_day"),
        dates.days_in_month(F.year(day), F.month(day)).alias("month_length"),
        dates.format_yyyymmdd(day).alias("yyyymmdd"),
        dates.slot_to_date(F.year(day), dates.leap_slot(day)).alias("again"),
        dates.parse_yyyymmdd(dates.format_yyyymmdd(day)).alias("parsed"))


@query("site_geography", """
SELECT unit, round((lon + 540) % 360 - 180, 6) + 0.0 AS wrapped,
       CAST(round_even(((lon + 540) % 360 - 180) / 15, 0) AS INTEGER) AS utc_offset,
       (lon + 360) % 360 >= 280 OR (lon + 360) % 360 <= 10 AS east,
       round(2 * 6371.0088 * asin(least(sqrt(
         (cos(radians(lat)) * cos(radians(lon)) - cos(radians(40)) * cos(radians(-100))) ** 2 +
         (cos(radians(lat)) * sin(radians(lon)) - cos(radians(40)) * sin(radians(-100))) ** 2 +
         (sin(radians(lat)) - sin(radians(40))) ** 2) / 2, 1)), 5) + 0.0 AS arc_km,
       round(6335.44 * atan(sqrt((cos(radians(40)) * sin(radians(lon + 100))) ** 2
         + (cos(radians(lat)) * sin(radians(40)) - sin(radians(lat)) * cos(radians(40)) * cos(radians(lon + 100))) ** 2)
         / (sin(radians(lat)) * sin(radians(40)) + cos(radians(lat)) * cos(radians(40)) * cos(radians(lon + 100)))), 5)
         + 0.0 AS radial_km
FROM site
""", ("site",))
def site_geography(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    c = geo.chord(lat, lon, F.lit(40.0), F.lit(-100.0))
    return views.site(spark, d).select(
        "unit", rounded(geo.wrap_lon(lon)).alias("wrapped"), geo.utc_offset_hours(lon).alias("utc_offset"),
        geo.lon_between(lon, -80.0, 10.0).alias("east"), rounded(geo.chord_to_km(c), 5).alias("arc_km"),
        rounded(geo.radial_km(F.lit(40.0), F.lit(-100.0), lat, lon), 5).alias("radial_km"))


@query("common_units", """
SELECT unit FROM daily WHERE tmax IS NOT NULL AND tmin >= 48 INTERSECT SELECT unit FROM station WHERE land
""", ("daily", "station"))
def common_units(spark, d):
    both = views.daily(spark, d).filter("tmax IS NOT NULL AND tmin >= 48")
    return joins.common_ids(both, views.station(spark, d).filter("land"))


@query("guard_incomplete_years", """
SELECT unit, year, count(*) AS n_days FROM panel GROUP BY ALL HAVING count(*) <> 153
""", ("panel",))
def guard_incomplete_years(spark, d):
    return guards.incomplete_years(views.panel(spark, d), ("unit",))


@query("guard_missing_months", """
SELECT y AS year, m AS month FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1994, 2003)),
     (SELECT CAST(range AS INTEGER) AS m FROM range(5, 10))
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.year = y AND month(p.day) = m)
""", ("panel",))
def guard_missing_months(spark, d):
    return guards.missing_months(views.panel(spark, d), 1994, 2002, (5, 6, 7, 8, 9))


@query("guard_repeated_keys", """
SELECT unit, day, elem, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1
""", ("obs",))
def guard_repeated_keys(spark, d):
    return guards.repeated_keys(views.obs(spark, d), ["unit", "day", "elem"])


@query("guard_broken_axes", """
WITH g AS (SELECT unit, year, doy - lag(doy) OVER (PARTITION BY unit, year ORDER BY doy) AS step FROM panel)
SELECT unit, year, count(*) FILTER (WHERE step = 0) AS n_repeats, count(*) FILTER (WHERE step > 1) AS n_gaps
FROM g GROUP BY unit, year HAVING n_repeats > 0 OR n_gaps > 0
""", ("panel",))
def guard_broken_axes(spark, d):
    p = views.panel(spark, d).withColumn("doy", dates.season_day(F.col("day")))
    return guards.broken_axes(p, ("unit", "year"), "doy")


@query("guard_without_position", """
SELECT DISTINCT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT unit FROM site)
""", ("site",))
def guard_without_position(spark, d):
    units = views.table(spark, d, "part").select(F.col("p_partkey").alias("unit"))
    return guards.without_position(units, views.site(spark, d))


@query("guard_nan_counts", """
SELECT count(*) FILTER (WHERE isnan(tmax)) AS tmax, count(*) FILTER (WHERE isnan(tmin)) AS tmin FROM daily
""", ("daily",))
def guard_nan_counts(spark, d):
    return guards.nan_counts(views.daily(spark, d), ["tmax", "tmin"])
