"""Queries: smoothing, outlier guards, period means and trends of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import series
from dayspell.plans import anomalies as anomaly_plans
from dayspell.plans import records as record_plans
from dayspell.plans.store import written
from dayspell.queries import views
from dayspell.queries.registry import query, tidy


def lowess_sql(name: str, source: str, passes: int = 0, keys: str = "series") -> str:
    """CTEs ending in `name`: (keys, x, y, smooth) of source (keys, x, y), 17-point windows."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in [*keys.split(", "), "run"])
    acols = ", ".join(f"a.{k}" for k in keys.split(", "))
    out = f"""
{name}_r AS (SELECT {keys}, x, y, x - row_number() OVER (PARTITION BY {keys} ORDER BY x) AS run FROM {source}
   WHERE y IS NOT NULL),
{name}_0 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, run ORDER BY x) - 1 AS i,
   count(*) OVER (PARTITION BY {keys}, run) AS n, 1.0::DOUBLE AS rw FROM {name}_r)"""
    for p in range(passes + 1):
        src = f"{name}_{p}"
        out += f""",
{name}_h{p} AS (SELECT {acols}, a.run, a.x, a.i, max(abs(b.x - a.x)) AS h FROM {src} a JOIN {src} b ON {on}
   AND b.i BETWEEN least(greatest(a.i - 8, 0), a.n - 17) AND least(greatest(a.i - 8, 0), a.n - 17) + 16
   WHERE a.n >= 17 GROUP BY ALL),
{name}_w{p} AS (SELECT {acols}, a.run, a.x, b.x - a.x AS u, b.y,
   (1 - (abs(b.x - a.x)::DOUBLE / h) ** 3) ** 3 * b.rw AS w
   FROM {src} a JOIN {src} b ON {on} AND b.i BETWEEN least(greatest(a.i - 8, 0), a.n - 17)
        AND least(greatest(a.i - 8, 0), a.n - 17) + 16
   JOIN {name}_h{p} h ON {on.replace('b.', 'h.')} AND h.x = a.x WHERE a.n >= 17),
{name}_f{p} AS (SELECT {keys}, run, x, (sum(w * u * u) * sum(w * y) - sum(w * u) * sum(w * u * y))
   / (sum(w) * sum(w * u * u) - sum(w * u) ** 2) AS smooth FROM {name}_w{p} GROUP BY ALL),
{name}_s{p} AS (SELECT a.*, b.smooth FROM {src} a LEFT JOIN {name}_f{p} b ON {on} AND a.x = b.x)"""
        if p < passes:
            out += f""",
{name}_m{p} AS (SELECT *, median(abs(y - smooth)) OVER (PARTITION BY {keys}, run) AS med FROM {name}_s{p}),
{name}_{p + 1} AS (SELECT {keys}, x, y, run, i, n, CASE WHEN smooth IS NULL THEN 1.0
   ELSE (1 - (CASE WHEN med > 0 THEN least(abs(y - smooth) / (6 * med), 1) WHEN y <> smooth THEN 1 ELSE 0 END) ** 2) ** 2
   END AS rw FROM {name}_m{p})"""
    return out + f""",
{name} AS (SELECT {keys}, x, y, smooth FROM {name}_s{passes})"""


_SRC = "src AS (SELECT series, year AS x, value AS y FROM month_series)"


@query("unbroken_runs", """
WITH a AS (SELECT series, year, value FROM month_series WHERE value < 26.5)
SELECT series, year, round(value, 6) + 0.0 AS value,
       CAST(year - row_number() OVER (PARTITION BY series ORDER BY year) AS INTEGER) AS run FROM a
""", ("month_series",))
def unbroken_runs(spark, d):
    warm_out = views.month_series(spark, d).withColumn("value", F.when(F.col("value") < 26.5, F.col("value")))
    return tidy(series.unbroken_runs(warm_out))


@query("lowess", "WITH " + _SRC + "," + lowess_sql("lw", "src") + """
SELECT series, x AS year, round(y, 6) + 0.0 AS value, round(smooth, 6) + 0.0 AS smooth FROM lw
""", ("month_series",))
def lowess(spark, d):
    return tidy(series.lowess(views.month_series(spark, d)))


@query("lowess_with_holes", "WITH src AS (SELECT series, year AS x, value AS y FROM month_series WHERE value < 28.5),"
       + lowess_sql("lw", "src") + """
SELECT series, x AS year, round(y, 6) + 0.0 AS value, round(smooth, 6) + 0.0 AS smooth FROM lw
""", ("month_series",))
def lowess_with_holes(spark, d):
    holed = views.month_series(spark, d).withColumn("value", F.when(F.col("value") < 28.5, F.col("value")))
    return tidy(series.lowess(holed))


@query("lowess_robust", "WITH " + _SRC + "," + lowess_sql("lw", "src", 3) + """
SELECT series, x AS year, round(smooth, 5) + 0.0 AS smooth FROM lw
""", ("month_series",))
def lowess_robust(spark, d):
    out = series.lowess(views.month_series(spark, d), passes=3)
    return tidy(out.select("series", "year", "smooth"), 5)


@query("robustness_table", "WITH " + _SRC + "," + lowess_sql("p", "src") + "," + lowess_sql("r", "src", 3) + """
SELECT series, round(max(p.y), 5) + 0.0 AS annual, round(max(p.smooth), 5) + 0.0 AS smooth_plain,
       round(max(r.smooth), 5) + 0.0 AS smooth_robust, round(1 - max(r.smooth) / max(p.smooth), 5) + 0.0 AS lowered
FROM p JOIN r USING (series, x) WHERE x BETWEEN 20 AND 40 GROUP BY series
""", ("month_series",))
def robustness_table(spark, d):
    return tidy(record_plans.robustness_table(views.month_series(spark, d), era=(20, 40)), 5)


@query("end_revision", "WITH " + _SRC + """,
num AS (SELECT series, x, y, row_number() OVER (PARTITION BY series ORDER BY x) - 1 AS k,
               count(*) OVER (PARTITION BY series) AS nn FROM src),
copies AS (SELECT series, cut, x, y FROM num, (SELECT unnest(range(33, (SELECT max(nn) FROM num))) AS cut) WHERE cut < nn - 8 AND k <= cut),"""
       + lowess_sql("c", "copies", keys="series, cut") + "," + lowess_sql("f", "src") + """
SELECT series, CAST(cut - k AS INTEGER) AS lag, round(sqrt(avg((c.smooth - f.smooth) ** 2)), 6) + 0.0 AS rmse, count(*) AS n_cuts
FROM c JOIN num USING (series, x) JOIN f USING (series, x) WHERE cut - k < 8 GROUP BY ALL
""", ("month_series",))
def end_revision(spark, d):
    out = series.end_revision(views.month_series(spark, d))
    return tidy(out.withColumn("lag", F.col("lag").cast("int")))


@query("outlier_guard", """
WITH a AS (SELECT *, median(value) OVER (PARTITION BY series) AS med FROM month_series),
b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY series) AS mad FROM a)
SELECT series, year, CASE WHEN bad THEN NULL ELSE round(value, 6) + 0.0 END AS value, bad
FROM (SELECT *, mad > 0 AND abs(value - med) > 2 * 1.4826 * mad AS bad FROM b)
""", ("month_series",))
def outlier_guard(spark, d):
    return tidy(series.blank_outliers(views.month_series(spark, d), k=2.0, mark="bad"))


@query("tail_trim", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS r,
                  count(*) OVER (PARTITION BY series) AS n FROM month_series),
b AS (SELECT *, median(value) FILTER (WHERE r > 2) OVER (PARTITION BY series) AS med FROM a),
c AS (SELECT *, median(abs(value - med)) FILTER (WHERE r > 2) OVER (PARTITION BY series) AS mad FROM b)
SELECT series, year, CASE WHEN r <= 2 AND n >= 15 AND mad > 0 AND abs(value - med) > 1.5 * 1.4826 * mad THEN NULL
       ELSE round(value, 6) + 0.0 END AS value FROM c
""", ("month_series",))
def tail_trim(spark, d):
    return tidy(series.trim_tail(views.month_series(spark, d), z=1.5))


# yearly values of each unit, with the share of the year's days they rest on
_YEARLY = """
yearly AS (SELECT unit AS series, year, avg(value) AS value, count(*) / 365.0 AS fraction FROM days GROUP BY ALL)"""


def yearly(spark, d):
    return views.days(spark, d).groupBy(F.col("unit").alias("series"), "year").agg(
        F.avg("value").alias("value"), (F.count("*") / 365.0).alias("fraction"))


@query("coverage_gate", "WITH " + _YEARLY + """
SELECT series, year, CASE WHEN fraction >= 0.87 THEN round(value, 6) + 0.0 END AS value,
       round(fraction, 6) + 0.0 AS fraction FROM yearly
""", ("days",))
def coverage_gate(spark, d):
    return tidy(series.gate_coverage(yearly(spark, d), minimum=0.87))


@query("anomaly_table", "WITH " + _YEARLY + """,
g AS (SELECT series, year, CASE WHEN fraction >= 0.8 THEN value END AS value FROM yearly),
m AS (SELECT *, median(value) OVER (PARTITION BY series) AS med FROM g),
n AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY series) AS mad FROM m),
v AS (SELECT series, year, CASE WHEN mad > 0 AND abs(value - med) > 8 * 1.4826 * mad THEN NULL ELSE value END AS value FROM n),
e AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY series) AS lv FROM v)
SELECT series, round(max(CASE WHEN year = 1996 THEN value END), 6) + 0.0 AS y1996,
       round(max(CASE WHEN year = 2000 THEN value END), 6) + 0.0 AS y2000,
       CASE WHEN count(value) FILTER (WHERE year BETWEEN 1995 AND 1997) >= 2
            THEN round(avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997), 6) + 0.0 END AS old_mean,
       CASE WHEN count(value) FILTER (WHERE year BETWEEN 1999 AND least(lv, 2001)) >= least(2, min(least(lv, 2001)) - 1998)
             AND count(value) FILTER (WHERE year BETWEEN 1999 AND least(lv, 2001)) > 0
            THEN round(avg(value) FILTER (WHERE year BETWEEN 1999 AND least(lv, 2001)), 6) + 0.0 END AS modern_mean,
       CAST(min(least(lv, 2001)) AS INTEGER) AS modern_end, CAST(min(lv) AS INTEGER) AS last_year,
       '1999-' || CAST(min(least(lv, 2001)) AS VARCHAR) AS modern_window
FROM e WHERE lv IS NOT NULL GROUP BY series
""", ("days",))
def anomaly_table(spark, d):
    y = yearly(spark, d)
    gated = series.gate_coverage(y, minimum=0.8).drop("fraction")
    return tidy(anomaly_plans.anomaly_table(gated, (1996, 2000), (1995, 1997), (1999, 2001), min_years=2))


@query("era_ratio", "WITH " + _YEARLY + """
SELECT series, round(a, 6) + 0.0 AS early, round(b, 6) + 0.0 AS late, round(a / b, 6) + 0.0 AS ratio FROM (
  SELECT series, avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997) AS a,
         avg(value) FILTER (WHERE year BETWEEN 1999 AND 2001) AS b FROM yearly GROUP BY series)
""", ("days",))
def era_ratio(spark, d):
    return tidy(series.era_ratio(yearly(spark, d), *views.ERAS.values()))


@query("decade_means", """
SELECT series, CAST(year // 10 * 10 AS INTEGER) AS decade, round(avg(value), 6) + 0.0 AS value
FROM month_series GROUP BY ALL
""", ("month_series",))
def decade_means(spark, d):
    return tidy(series.decade_means(views.month_series(spark, d)))


@query("recent_mean", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS k FROM month_series WHERE value < 27)
SELECT series, round(CASE WHEN c >= 5 THEN w ELSE l END, 6) + 0.0 AS recent,
       CASE WHEN c >= 5 THEN 70 ELSE f END AS first_year, CASE WHEN c >= 5 THEN 80 ELSE m END AS last_year FROM (
  SELECT series, count(*) FILTER (WHERE year BETWEEN 70 AND 80) AS c, avg(value) FILTER (WHERE year BETWEEN 70 AND 80) AS w,
    avg(value) FILTER (WHERE k <= 10) AS l, min(year) FILTER (WHERE k <= 10) AS f, max(year) AS m FROM r GROUP BY series)
""", ("month_series",))
def recent_mean(spark, d):
    cool = views.month_series(spark, d).filter(F.col("value") < 27)
    return tidy(series.recent_mean(cool, (70, 80)))


@query("strict_period_means", "WITH " + _YEARLY + """
SELECT series, CASE WHEN count(*) FILTER (WHERE year BETWEEN 1995 AND 1998) = 4
    THEN round(avg(value) FILTER (WHERE year BETWEEN 1995 AND 1998), 6) + 0.0 END AS whole,
  CASE WHEN count(*) FILTER (WHERE year BETWEEN 1998 AND 2004) = 7 THEN 1.0::DOUBLE END AS beyond
FROM yearly GROUP BY series
""", ("days",))
def strict_period_means(spark, d):
    return tidy(yearly(spark, d).groupBy("series").agg(
        series.period_mean("value", 1995, 1998, strict=True).alias("whole"),
        series.period_mean("value", 1998, 2004, strict=True).alias("beyond")))


@query("column_summary", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY year DESC) AS k FROM month_series)
SELECT series, count(*) AS n_years, min(year) AS first_year, max(year) AS last_year,
       CASE WHEN min(year) <= 5 THEN round(avg(value) FILTER (WHERE year BETWEEN 5 AND 14), 6) + 0.0 END AS old_mean,
       round(avg(value) FILTER (WHERE k <= 10), 6) + 0.0 AS last_mean FROM r GROUP BY series
""", ("month_series",))
def column_summary(spark, d):
    return tidy(series.column_summary(views.month_series(spark, d), old=(5, 14)))


_TREND = """
a AS (SELECT s.series, CAST(st AS INTEGER) AS start, year, value FROM month_series s, (VALUES (1), (20), (40), (76)) t(st)
      WHERE year >= st AND year <= 80),
p AS (SELECT *, avg(year) OVER w AS xm, avg(value) OVER w AS ym FROM a WINDOW w AS (PARTITION BY series, start)),
q AS (SELECT *, sum((year - xm) ** 2) OVER w AS sxx, sum((year - xm) * (value - ym)) OVER w AS sxy FROM p
      WINDOW w AS (PARTITION BY series, start)),
res AS (SELECT *, value - ym - sxy / sxx * (year - xm) AS r FROM q),
nx AS (SELECT *, lead(r) OVER (PARTITION BY series, start ORDER BY year) AS r2 FROM res),
t AS (SELECT series, start, count(*) AS n, max(sxy / sxx) AS slope, sqrt(sum(r * r) / ((count(*) - 2) * max(sxx))) AS se,
             corr(r, r2) AS r1 FROM nx GROUP BY series, start),
e AS (SELECT *, n * (1 - least(greatest(r1, 0), 0.99)) / (1 + least(greatest(r1, 0), 0.99)) AS n_eff FROM t)"""


def _trends(spark, d):
    return record_plans.trend_table(views.month_series(spark, d), starts=(1, 20, 40, 76), last=80)


@query("trend_table", "WITH " + _TREND + """
SELECT series, start, n, CASE WHEN n >= 10 THEN round(slope * 100, 6) + 0.0 END AS trend,
       CASE WHEN n >= 10 THEN round(se * 100, 6) + 0.0 END AS se, CASE WHEN n >= 10 THEN round(r1, 6) + 0.0 END AS r1,
       CASE WHEN n >= 10 THEN round(n_eff, 6) + 0.0 END AS n_eff FROM e
""", ("month_series",))
def trend_table(spark, d):
    return tidy(_trends(spark, d).drop("p_ols", "p_ar1"))


#: Simpson's rule over the angle: P(|T| >= t) = 1 - 2 C * integral of cos(a)^(df - 1) from 0 to atan(t / sqrt(df)).
_T_TAIL = """(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * atan({t} / sqrt({df})) / 2000 / 3 * list_sum([
    (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(k * atan({t} / sqrt({df})) / 2000), {df} - 1)
    for k in range(0, 2001)]))"""


@query("trend_significance", "WITH " + _TREND + """,
f AS (SELECT *, abs(slope / se) AS tt, n - 2.0::DOUBLE AS d1, n_eff - 2 AS d2 FROM e)
SELECT series, start, n, CASE WHEN n >= 10 THEN round(slope * 100, 6) + 0.0 END AS trend,
       CASE WHEN n >= 10 THEN round(se * 100, 6) + 0.0 END AS se,
       CASE WHEN n >= 10 THEN round(""" + _T_TAIL.format(df="d1", t="tt") + """, 6) + 0.0 END AS p_ols,
       CASE WHEN n >= 10 THEN round(r1, 6) + 0.0 END AS r1, CASE WHEN n >= 10 THEN round(n_eff, 6) + 0.0 END AS n_eff,
       CASE WHEN n >= 10 AND n_eff <= 2.5 THEN 1.0
            WHEN n >= 10 THEN round(""" + _T_TAIL.format(df="greatest(d2, 0.5)", t="(tt / sqrt(d1 / greatest(d2, 0.5)))") + """, 6) + 0.0 END AS p_ar1
FROM f
""", ("month_series",))
def trend_significance(spark, d):
    return tidy(_trends(spark, d), 6)


@query("full_window_trend", """
SELECT series, CASE WHEN count(*) FILTER (WHERE year BETWEEN 10 AND 60) = 51
  THEN round(regr_slope(value, year) FILTER (WHERE year BETWEEN 10 AND 60) * 100, 6) + 0.0 END AS trend
FROM month_series GROUP BY series
""", ("month_series",))
def full_window_trend(spark, d):
    return tidy(series.full_window_trend(views.month_series(spark, d), 10, 60))


_TWO = """
hi AS (SELECT series, year AS x, value + (series * 5 % 7) / 10.0 + year / 100.0 AS y FROM month_series),
lo AS (SELECT series, year AS x, value AS y FROM month_series),"""


def _legs(spark, d):
    lo = views.month_series(spark, d)
    bump = (F.col("series") * 5 % 7) / 10.0 + F.col("year") / 100.0
    return lo, lo.withColumn("value", F.col("value") + bump)


@query("homogenization_signal", "WITH " + _TWO + lowess_sql("a", "hi") + "," + lowess_sql("b", "lo") + """
SELECT series, round(avg(a.smooth - b.smooth) FILTER (WHERE x BETWEEN 1 AND 24), 6) + 0.0 AS early,
       round(avg(a.smooth - b.smooth) FILTER (WHERE x BETWEEN 50 AND 80), 6) + 0.0 AS late
FROM a JOIN b USING (series, x) GROUP BY series
""", ("month_series",))
def homogenization_signal(spark, d):
    raw, adj = _legs(spark, d)
    return tidy(anomaly_plans.homogenization_signal(raw, adj, {"early": (1, 24), "late": (50, 80)}))


# network means per month, of all units and of those on land
_NETS = """
full_net AS (SELECT 'f' AS series, year AS x, avg(value) AS y FROM month_series GROUP BY year),
part_net AS (SELECT 'p' AS series, year AS x, avg(m.value) AS y FROM month_series m JOIN station ON unit = m.series
             WHERE land GROUP BY year),"""


@query("sampling_correction", "WITH " + _NETS + lowess_sql("a", "full_net") + "," + lowess_sql("b", "part_net") + """
SELECT x AS year, round(p.y * a.smooth / b.smooth, 6) + 0.0 AS value
FROM part_net p LEFT JOIN a USING (x) LEFT JOIN b USING (x)
""", ("month_series", "station"))
def sampling_correction(spark, d):
    months = views.month_series(spark, d)
    land = views.station(spark, d).filter("land").select(F.col("unit").alias("series"), F.lit(True).alias("land"))
    means = written(months.join(land, "series", "left").groupBy("year").agg(
        F.avg("value").alias("full"), F.avg(F.when(F.col("land"), F.col("value"))).alias("sampled"), F.count("land").alias("n")))
    full = means.select("year", F.col("full").alias("value"))
    sampled = means.filter("n > 0").select("year", F.col("sampled").alias("value"))
    return tidy(record_plans.sampling_correction(sampled, full, sampled))


@query("mean_of_series_pair", "WITH " + _NETS.rstrip(",") + """
SELECT x AS year, round(0.5 * (f.y + p.y), 6) + 0.0 AS value FROM full_net f FULL JOIN part_net p USING (x)
""", ("month_series", "station"))
def mean_of_series_pair(spark, d):
    months = views.month_series(spark, d)
    land = views.station(spark, d).filter("land").select(F.col("unit").alias("series"))
    whole = months.groupBy("year").agg(F.avg("value").alias("value"))
    part = months.join(land, "series", "left_semi").groupBy("year").agg(F.avg("value").alias("value"))
    return tidy(series.mean_pair(whole, part))
