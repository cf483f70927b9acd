"""Queries: local days from sub-daily samples."""

from __future__ import annotations

from dayspell.operators import guards, localday
from dayspell.plans import localday as plans
from dayspell.queries import views
from dayspell.queries.registry import query, tidy


def _sql(source: str, need: int, months: str | None = None) -> str:
    cut = f"WHERE month(day) IN ({months})" if months else ""
    return f"""
WITH s AS (SELECT cell, value, hours + CAST(round_even(((lon + 540) % 360 - 180) / 15, 0) AS BIGINT) AS local FROM {source}),
g AS (SELECT cell, DATE '1970-01-01' + CAST(floor(local / 24) AS INTEGER) AS day, count(*) AS n_samples,
   max(value) AS mx, min(value) AS mn, avg(value) AS me FROM s GROUP BY ALL)
SELECT cell, day, n_samples, CASE WHEN n_samples = {need} THEN round(mx, 9) + 0.0 END AS tmax,
   CASE WHEN n_samples = {need} THEN round(mn, 9) + 0.0 END AS tmin, CASE WHEN n_samples = {need} THEN round(me, 9) + 0.0 END AS tmean,
   CASE WHEN n_samples = {need} THEN round((mx + mn) / 2, 9) + 0.0 END AS tavg FROM g {cut}"""


@query("local_days_3h", _sql("samples", 8), ("samples",))
def local_days_3h(spark, d):
    return tidy(localday.local_days(views.samples(spark, d, 3), 3), 9)


@query("local_days_6h", _sql("samples6", 4), ("samples6",))
def local_days_6h(spark, d):
    return tidy(localday.local_days(views.samples(spark, d, 6), 6), 9)


# the events are no even samples, which the plan would refuse
@query("local_day_extract", _sql("(SELECT * FROM samples WHERE lat BETWEEN 24 AND 40)", 8, "1"), ("samples",))
def local_day_extract(spark, d):
    out = plans.local_day_product(views.samples(spark, d, 3), 3, months=(1,), lat_bounds=(24.0, 40.0), check=False)
    return tidy(out.drop("year"), 9)


@query("sample_spacing", """
WITH g AS (SELECT cell, hours - lag(hours) OVER (PARTITION BY cell ORDER BY hours) AS gap FROM samples)
SELECT cell, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL
""", ("samples",))
def sample_spacing(spark, d):
    return localday.spacing(views.samples(spark, d, 3))


@query("missing_sample_steps", """
WITH t AS (SELECT DISTINCT cell, hours FROM samples), m AS (SELECT cell, max(hours) AS h FROM t GROUP BY cell)
SELECT t.cell, t.hours FROM t JOIN m USING (cell) WHERE t.hours < m.h
AND NOT EXISTS (SELECT 1 FROM t u WHERE u.cell = t.cell AND u.hours = t.hours + 3)
""", ("samples",))
def missing_sample_steps(spark, d):
    return localday.missing_steps(views.samples(spark, d, 3), 3, ("cell",)).select("cell", "hours")


@query("sample_sanity", """
WITH f AS (SELECT DISTINCT hours FROM samples ORDER BY hours LIMIT 8)
SELECT round(avg(value), 6) + 0.0 AS mean, avg(value) > -60 AND avg(value) < 60 AS ok
FROM samples WHERE hours IN (SELECT hours FROM f)
""", ("samples",))
def sample_sanity(spark, d):
    return tidy(guards.sanity_mean(views.samples(spark, d, 3)))
