"""Queries: monthly offsets, the raw / adjusted pair and its station months."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import joins, pairs, spells
from dayspell.plans import stations as plans
from dayspell.queries import views
from dayspell.queries.heat import _counts_sql, _thresholds_sql
from dayspell.queries.records import _PAIR, pair_days
from dayspell.queries.registry import query, tidy
from dayspell.functions.dates import season_day
from dayspell.sources.stations import parse_monthly


def monthly_legs(spark, d):
    """Both legs written as fixed-width monthly lines and read back by the parser, in one pass."""
    base = (F.col("unit") * 13 + F.col("month") * 50).cast("int")

    def cell(leg, value, flag):
        return F.struct(F.lit(leg).alias("leg"), F.concat(F.format_string("%6d", value), flag, F.lit("  ")).alias("text"))

    both = F.array(cell("raw", base, F.lit(" ")), cell("adj", base + F.col("hundredths"), F.col("flag")))
    cells = views.offsets(spark, d).select("unit", "elem", "year", "month", F.inline(both))
    by_month = F.map_from_entries(F.collect_list(F.struct("month", "text")))
    lines = cells.groupBy("unit", "leg", "elem", "year").agg(by_month.alias("m"))
    blank = F.lit(" -9999   ")
    text = F.concat(F.format_string("U%010d", "unit"), F.lit("1"), F.col("year").cast("string"), *[
        F.coalesce(F.try_element_at("m", F.lit(i)), blank) for i in range(1, 13)])
    return parse_monthly(lines.select("unit", "leg", "elem", text.alias("value")), ("unit", "leg", "elem"))


_OFF = """
off AS (SELECT unit, year, month, elem, hundredths * 0.01::DOUBLE AS o FROM offsets WHERE flag <> 'E'),
wide AS (SELECT unit, year, month, max(o) FILTER (WHERE elem = 'tmax') AS tmax_offset,
  max(o) FILTER (WHERE elem = 'tmin') AS tmin_offset, max(o) FILTER (WHERE elem = 'tavg') AS tavg_offset
  FROM off GROUP BY ALL)"""


def _offsets(spark, d):
    return plans.homogenization_offsets(monthly_legs(spark, d))


@query("homogenization_offsets", "WITH " + _OFF + """
SELECT unit, year, month, round(tmax_offset, 6) + 0.0 AS tmax_offset, round(tmin_offset, 6) + 0.0 AS tmin_offset,
       round(tavg_offset, 6) + 0.0 AS tavg_offset FROM wide
""", ("offsets",))
def homogenization_offsets(spark, d):
    return tidy(_offsets(spark, d))


@query("offset_rebuild_diff", """
WITH a AS (SELECT unit, year, month, elem, hundredths * 0.01::DOUBLE AS o FROM offsets),
b AS (SELECT unit, year, month, elem, hundredths * 0.01::DOUBLE AS o FROM offsets WHERE flag <> 'E'),
j AS (SELECT a.o AS o, b.o AS n FROM a FULL JOIN b USING (unit, year, month, elem))
SELECT 'offset' AS name, count(o) AS n_old, count(n) AS n_new, count(*) FILTER (WHERE o IS NOT NULL AND n IS NULL) AS only_old,
  count(*) FILTER (WHERE o IS NULL AND n IS NOT NULL) AS only_new, round(max(abs(o - n)), 6) + 0.0 AS max_abs_diff, false AS same
FROM j
""", ("offsets",))
def offset_rebuild_diff(spark, d):
    legs = monthly_legs(spark, d)
    keep_all = pairs.leg_offsets(legs.withColumn("flag", F.lit(" ")))
    dropped = pairs.leg_offsets(legs)
    return tidy(joins.differences(keep_all, dropped, ["unit", "elem", "year", "month"], ["offset"]))


_LEGS = _OFF + """,
legs AS (SELECT d.unit, d.day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
  CASE WHEN tmax_offset IS NOT NULL THEN tmax END AS tmax_raw, tmax + tmax_offset AS tmax_adj,
  CASE WHEN tmin_offset IS NOT NULL THEN tmin END AS tmin_raw, tmin + tmin_offset AS tmin_adj,
  CASE WHEN tavg_offset IS NOT NULL THEN (tmax + tmin) / 2 END AS tavg_raw, (tmax + tmin) / 2 + tavg_offset AS tavg_adj
  FROM daily d LEFT JOIN wide w ON w.unit = d.unit AND w.year = year(d.day) AND w.month = month(d.day))"""
_NAMES = [f"{e}_{leg}" for e in ("tmax", "tmin", "tavg") for leg in ("raw", "adj")]


@query("paired_days", "WITH " + _LEGS + """
SELECT unit, day, year, month, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _NAMES) + " FROM legs",
       ("daily", "offsets"))
def paired_days(spark, d):
    return tidy(plans.reconstruct_pair(views.daily(spark, d), _offsets(spark, d)).daily)


@query("paired_months", "WITH " + _LEGS + """
SELECT unit, year, month, """ + ", ".join(
    f"round(coalesce(sum({c}), 0), 4) + 0.0 AS {c}_sum, count({c}) AS {c}_n" for c in _NAMES) + """
FROM legs GROUP BY unit, year, month HAVING count(tmax_raw) + count(tmin_raw) > 0
""", ("daily", "offsets"))
def paired_months(spark, d):
    return tidy(plans.reconstruct_pair(views.daily(spark, d), _offsets(spark, d)).months, 4)


@query("heatwave_counts_pair", "WITH " + _PAIR + """
two AS (SELECT 'raw' || panel.unit AS unit, year, doy, legs.raw AS value FROM legs JOIN panel USING (unit, day, year)
         UNION ALL SELECT 'adj' || panel.unit, year, doy, legs.adj FROM legs JOIN panel USING (unit, day, year)),"""
       + _thresholds_sql("two", "unit") + "," + _counts_sql("two", "unit", True) + """
SELECT left(unit, 3) AS leg, CAST(substr(unit, 4) AS BIGINT) AS unit, year, n_days, hw_days FROM counts
""", ("panel",))
def heatwave_counts_pair(spark, d):
    p = pair_days(spark, d).withColumn("year", F.year("day")).withColumn("doy", season_day(F.col("day")))
    long = p.unpivot(["unit", "year", "doy"], ["raw", "adj"], "leg", "value")
    return spells.heatwave_counts(long, ("leg", "unit"), percentile=60, min_pool=20, min_run=3)


@query("crosswalk_positions", """
WITH x AS (SELECT c_custkey // 2 AS network_id, -c_custkey AS ord,
             'S' || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 2 THEN 12 ELSE 10 END, '0') AS archive_id FROM customer),
o AS (SELECT DISTINCT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS archive_id FROM supplier)
SELECT network_id, archive_id, lat, lon FROM (SELECT network_id, arg_min(archive_id, ord) AS archive_id FROM x JOIN o USING (archive_id)
  WHERE length(archive_id) = 11 GROUP BY network_id) JOIN (SELECT unit AS network_id, lat, lon FROM site) USING (network_id)
""", ("site",))
def crosswalk_positions(spark, d):
    key = F.col("c_custkey")
    # a third of the ids exceed eleven characters and must be dropped; each network id is listed twice, the later key first
    digits = key.cast("string")
    padded = F.when(key % 3 == 2, F.lpad(digits, 12, "0")).otherwise(F.lpad(digits, 10, "0"))
    x = views.table(spark, d, "customer").select(
        F.floor(key / 2).alias("network_id"), (-key).alias("ord"), F.concat(F.lit("S"), padded).alias("archive_id"))
    o = views.table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("archive_id"))
    sites = views.site(spark, d).withColumnRenamed("unit", "network_id")
    return joins.crosswalk_chain(x, o, sites).select("network_id", "archive_id", "lat", "lon")
