"""Queries: record credit, record series on every footprint, sampling correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayspell.operators import guards, joins, qc, records
from dayspell.plans import records as plans
from dayspell.plans.store import written
from dayspell.queries import views
from dayspell.queries.monthly import AREAS_SQL
from dayspell.queries.registry import query, tidy

_MD = "CAST(month(day) * 100 + day(day) AS INTEGER)"


def _credit(name: str, source: str, key: str) -> str:
    return f"""
{name}_top AS (SELECT *, max(value) OVER (PARTITION BY {key}, {_MD}) AS mx FROM {source}),
{name} AS (SELECT {key}, day, year, value, {_MD} AS month_day,
     1.0::DOUBLE / count(*) OVER (PARTITION BY {key}, {_MD}) AS credit FROM {name}_top WHERE value = mx),
{name}_n AS (SELECT {key}, CAST(year AS INTEGER) AS year, sum(credit) AS records FROM {name} GROUP BY {key}, year)"""


def _series(counts: str, key: str, weights: str | None = None) -> str:
    w = f"JOIN {weights} w ON w.{key} = c.{key}" if weights else ""
    v = "w.weight" if weights else "1.0"
    return f"""
SELECT y.year, coalesce(sum(v.w * v.records), 0) / max(t.total) AS value
FROM (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)) y
CROSS JOIN (SELECT sum(w) AS total FROM (SELECT DISTINCT c.{key}, {v} AS w FROM {counts} c {w})) t
LEFT JOIN (SELECT c.year, c.records, {v} AS w FROM {counts} c {w}) v ON v.year = y.year GROUP BY y.year"""


@query("record_credit", "WITH " + _credit("cr", "panel", "unit") + """
SELECT unit, day, value, month_day, round(credit, 6) + 0.0 AS credit FROM cr
""", ("panel",))
def record_credit(spark, d):
    out = records.record_credit(views.panel(spark, d))
    return tidy(out.select("unit", "day", "value", "month_day", "credit"))


@query("record_counts_by_unit", "WITH " + _credit("cr", "panel", "unit") + """
SELECT unit, year, round(records, 6) + 0.0 AS records FROM cr_n
""", ("panel",))
def record_counts_by_unit(spark, d):
    return tidy(records.unit_record_counts(views.panel(spark, d)))


_COMPLETE = """
full_units AS (SELECT unit FROM panel GROUP BY unit HAVING count(DISTINCT year) >= 5 AND count(*) / (7.0 * 153) >= 0.8),
kept AS (SELECT p.* FROM panel p JOIN full_units USING (unit)),"""
_RULE = dict(min_years=5, min_share=0.8)


@query("record_series_network", "WITH " + _COMPLETE + _credit("cr", "kept", "unit") + """
SELECT year, round(value, 6) + 0.0 AS value FROM (""" + _series("cr_n", "unit") + ")", ("panel",))
def record_series_network(spark, d):
    return tidy(plans.network_series(views.panel(spark, d), views.YEARS, **_RULE))


@query("record_integral", "WITH " + _COMPLETE + _credit("cr", "kept", "unit") + """
SELECT round(sum(value), 6) + 0.0 AS integral, abs(sum(value) - 153) < 0.5 AS ok FROM ("""
       + _series("cr_n", "unit") + ")", ("panel",))
def record_integral(spark, d):
    return tidy(records.integral(plans.network_series(views.panel(spark, d), views.YEARS, **_RULE)))


@query("record_expected_rate", """
SELECT unit, round(153.0 / count(DISTINCT year), 6) + 0.0 AS expected FROM panel GROUP BY unit
""", ("panel",))
def record_expected_rate(spark, d):
    held = views.panel(spark, d).groupBy("unit", "year").agg(F.avg("value").alias("value"))
    return tidy(records.expected_rate(held, ("unit",)))


# ---- a gridded field on the two-degree grid ------------------------------------

FIELD_SQL = """
field AS (SELECT CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell, day,
                 CAST(year(day) AS INTEGER) AS year, avg(value) AS value
          FROM days JOIN station USING (unit)
          WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29
          GROUP BY ALL)"""


def field(spark, d):
    """Whole-year daily cell means of the units in each cell."""
    located = views.days(spark, d).join(views.station(spark, d).select("unit", "lat", "lon"), "unit")
    return views.GRID.snap(located).groupBy("cell", "day").agg(
        F.avg("value").alias("value")).withColumn("year", F.year("day"))


_GRID_RECORDS = AREAS_SQL + "," + FIELD_SQL + """,
dom AS (SELECT a.cell, a.fraction AS weight FROM area a JOIN grid g USING (cell) WHERE fraction >= 0.5 AND land),
season AS (SELECT f.* FROM field f JOIN dom USING (cell) WHERE month(day) BETWEEN 5 AND 9),
kept AS (SELECT s.* FROM season s JOIN (SELECT cell FROM season GROUP BY cell
         HAVING count(DISTINCT year) >= 5 AND count(*) / (7.0 * 153) >= 0.8) USING (cell)),""" + _credit(
    "cr", "kept", "cell")
_USES = ("days", "station", "grid", "edges")


def _cells(spark):
    from dayspell.queries.monthly import polygon_cells

    return polygon_cells(spark).join(views.grid(spark).select("cell", "land"), "cell")


def _cell_days(spark, d):
    """The field as a table: counts, time axis and masks read it, none builds it again."""
    return written(field(spark, d))


def _grid_counts(days, cells):
    return plans.grid_counts(days, cells, views.YEARS, axis=days, **_RULE)


@query("record_series_grid", "WITH " + _GRID_RECORDS + """
SELECT year, CASE WHEN year <= (SELECT CASE WHEN strftime(max(day), '%m%d') = '1231' THEN year(max(day))
    ELSE year(max(day)) - 1 END FROM field) THEN round(value, 6) + 0.0 END AS value FROM ("""
       + _series("cr_n", "cell", "dom") + ")", _USES)
def record_series_grid(spark, d):
    cells, days = written(_cells(spark)), _cell_days(spark, d)
    return tidy(plans.grid_series(_grid_counts(days, cells), cells, days, views.YEARS))


_SITES = """,
sited AS (SELECT unit, CAST(round_even((lat - 25) / 2, 0) * 30 + round_even((lon + 124) / 2, 0) AS BIGINT) AS cell
  FROM site WHERE round_even((lat - 25) / 2, 0) BETWEEN 0 AND 12 AND round_even((lon + 124) / 2, 0) BETWEEN 0 AND 29),
"""


@query("record_series_at_network", "WITH " + _GRID_RECORDS + _SITES + """
nw AS (SELECT cell, count(*) AS weight FROM sited GROUP BY cell)
SELECT year, round(value, 6) + 0.0 AS value FROM (""" + _series("cr_n", "cell", "nw") + ")", (*_USES, "site"))
def record_series_at_network(spark, d):
    counts = _grid_counts(_cell_days(spark, d), _cells(spark))
    return tidy(plans.at_network_series(counts, views.site(spark, d), views.GRID, views.YEARS))


@query("record_series_at_network_cells", "WITH " + _GRID_RECORDS + _SITES + """
nw AS (SELECT cell, fraction AS weight FROM area WHERE cell IN (SELECT cell FROM sited))
SELECT year, round(value, 6) + 0.0 AS value FROM (""" + _series("cr_n", "cell", "nw") + ")", (*_USES, "site"))
def record_series_at_network_cells(spark, d):
    cells = written(_cells(spark))
    return tidy(plans.at_network_cells_series(_grid_counts(_cell_days(spark, d), cells), views.site(spark, d), views.GRID,
                                              cells, views.YEARS))


# every station has a silent twin in its cell, which never reports and stays in the mean's denominator
@query("record_series_masked", "WITH " + _GRID_RECORDS.replace("cr", "gcr") + """,
rep AS (SELECT DISTINCT l_suppkey AS unit, CAST(l_shipdate AS DATE) AS day FROM lineitem)""" + _SITES + """
own AS (SELECT unit, cell FROM (SELECT unit, cell FROM sited UNION ALL SELECT -unit, cell FROM sited) WHERE cell IN (SELECT cell FROM gcr_n)),
carried AS (SELECT unit, day, f.year, f.value FROM rep JOIN own USING (unit) JOIN field f USING (cell, day)
            WHERE month(day) BETWEEN 5 AND 9),""" + _credit("cr", "carried", "unit") + """
SELECT y.year, CASE WHEN y.year <= (SELECT CASE WHEN strftime(max(day), '%m%d') = '1231' THEN year(max(day))
    ELSE year(max(day)) - 1 END FROM field)
  THEN round(coalesce(sum(n.records), 0) / (SELECT nullif(count(*), 0) FROM own), 6) + 0.0 END AS value
FROM (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)) y LEFT JOIN cr_n n USING (year) GROUP BY y.year
""", (*_USES, "site"))
def record_series_masked(spark, d):
    reports = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_shipdate").cast("date").alias("day")).distinct()
    days = _cell_days(spark, d)
    season = days.filter(F.month("day").between(5, 9))
    kept = written(_grid_counts(days, _cells(spark)).select("cell").distinct())
    site = views.site(spark, d)
    both = site.unionByName(site.withColumn("unit", -F.col("unit")))
    return tidy(plans.at_network_masked_series(season, both, reports, views.GRID, kept, days, views.YEARS))


@query("mask_to_reporting", "WITH " + FIELD_SQL + """,
rep AS (SELECT DISTINCT unit, day FROM obs WHERE elem = 'TMAX' AND qflag = '')
SELECT days.unit, days.day, CASE WHEN rep.unit IS NOT NULL THEN days.value END AS value
FROM days LEFT JOIN rep USING (unit, day)
""", ("days", "obs", "station"))
def mask_to_reporting(spark, d):
    seen = views.obs(spark, d).filter((F.col("elem") == "TMAX") & (F.col("qflag") == ""))
    return joins.mask_to_reporting(views.days(spark, d), seen).select("unit", "day", "value")


# ---- the matched pair ------------------------------------------------------------

_PAIR = """
legs AS (SELECT unit, day, CAST(year(day) AS INTEGER) AS year, value AS raw,
     round(value + ((unit * 7 + year(day) * 3 + month(day) * 11) % 21 - 10) / 10.0, 1) AS adj FROM panel),
praw AS (SELECT unit, day, year, raw AS value FROM legs), padj AS (SELECT unit, day, year, adj AS value FROM legs),"""


def pair_days(spark, d):
    y, m, u = F.col("year"), F.month("day"), F.col("unit")
    shift = ((u * 7 + y * 3 + m * 11) % 21 - 10) / 10.0
    p = views.panel(spark, d)
    raw = p.select("unit", "day", "value")
    adj = p.select("unit", "day", F.round(F.col("value") + shift, 1).alias("value"))
    return joins.matched_legs(raw, adj)


@query("record_series_pair", "WITH " + _PAIR + _credit("a", "praw", "unit") + "," + _credit("b", "padj", "unit") + """
SELECT 'raw' AS series, year, round(value, 6) + 0.0 AS value FROM (""" + _series("a_n", "unit") + """)
UNION ALL SELECT 'adj', year, round(value, 6) + 0.0 FROM (""" + _series("b_n", "unit") + ")", ("panel",))
def record_series_pair(spark, d):
    return tidy(plans.pair_series(pair_days(spark, d), views.YEARS, min_years=1, min_share=0.0))


@query("pair_match_guard", "WITH " + _PAIR.rstrip(",") + """
SELECT count(*) FILTER (WHERE (raw IS NULL) <> (adj IS NULL)) AS n_unmatched FROM legs
""", ("panel",))
def pair_match_guard(spark, d):
    return guards.unmatched_legs(pair_days(spark, d))


@query("decade_record_share", "WITH " + _credit("cr", "panel", "unit") + """
SELECT unit, CAST(year // 10 * 10 AS INTEGER) AS decade, round(sum(records) / 153.0, 6) + 0.0 AS share
FROM cr_n GROUP BY ALL
""", ("panel",))
def decade_record_share(spark, d):
    counts = records.unit_record_counts(views.panel(spark, d))
    decade = (F.floor(F.col("year") / 10) * 10).cast("int")
    return tidy(counts.groupBy("unit", decade.alias("decade")).agg((F.sum("records") / 153.0).alias("share")))
