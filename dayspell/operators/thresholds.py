"""Day-of-year percentile thresholds from pooled neighbouring days.

The panel is laid out by unit once. Each unit keeps one array of values per
calendar day, and a sliding frame over those at most 366 rows pools the
neighbours, so the data is never multiplied by the window width in a shuffle.
A unit holds at most one row per date (see `qc.first_wins`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import (
    EXCEED_PERCENTILE, EXCEED_WINDOW_AFTER, EXCEED_WINDOW_BEFORE, HEAT_HALF_WINDOW, HEAT_MIN_POOL,
    HEAT_PERCENTILE, SEASON_DAYS,
)
from dayspell.operators.guards import stop


def nearest_rank(ordered: Column, percentile: float) -> Column:
    """ordered[min(int(n * p * 0.01), n - 1)] of a sorted array; NULL when it is empty."""
    n = F.size(ordered)
    rank = F.floor(n * F.lit(float(percentile)) * F.lit(0.01)).cast("int")
    return F.get(ordered, F.least(rank, n - 1))


def linear_percentile(ordered: Column, percentile: float) -> Column:
    """Percentile of a sorted array, interpolated between the two nearest ranks."""
    n = F.size(ordered)
    at = (n - 1) * F.lit(float(percentile) / 100.0)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, n - 1))
    return a + (b - a) * (at - low)


def by_day(panel: DataFrame, unit: Sequence[str], doy: str, value: str,
           first: int, last: int, laid_out: bool = False, carry: str | None = None, check: bool = True) -> DataFrame:
    """(unit, doy, own) for every doy in [first, last]; `own` lists (year, v), or (year, v, c) with a carried
    column, which then also keeps days without a value.

    Days without data get an empty list, filled in between the unit's own days
    without another table or shuffle. `laid_out` says the rows already lie by unit. A
    second row for a unit and date fails the job unless `check` is off.
    """
    known = F.col(value).isNotNull() if carry is None else F.col(value).isNotNull() | F.col(carry).isNotNull()
    rows = panel.filter(known & F.col(doy).between(first, last))
    rows = rows.select(*unit, doy, "year", value, *([carry] if carry else []))
    if not laid_out:
        rows = rows.repartition(*unit)
    held = rows.groupBy(*unit, doy).agg(
        F.collect_list(F.struct(F.col("year"), F.col(value).alias("v"), *([F.col(carry).alias("c")] if carry else []))).alias("own"))
    if check:
        years = F.transform("own", lambda r: r["year"])
        held = held.withColumn("own", stop(F.size(F.array_distinct(years)) == F.size(years), "a unit holds two rows for one day", F.col("own")))
    w = Window.partitionBy(*unit).orderBy(doy)
    begin = F.when(F.lag(doy).over(w).isNull(), F.lit(first)).otherwise(F.col(doy))
    end = F.coalesce(F.lead(doy).over(w) - 1, F.lit(last))
    spread = held.withColumn("_range", F.sequence(begin, end)).select(
        *unit, "own", F.col(doy).alias("_at"), F.explode("_range").alias(doy))
    return spread.withColumn(
        "own", F.when(F.col("_at") == F.col(doy), F.col("own")).otherwise(F.slice("own", 1, 0))
    ).drop("_at")


def _pooled(days: DataFrame, unit: Sequence[str], doy: str, before: int, after: int) -> DataFrame:
    """Add `pool`, the sorted values of days [doy - before, doy + after] inside the range."""
    w = Window.partitionBy(*unit).orderBy(doy).rangeBetween(-before, after)
    values = F.array_compact(F.transform("own", lambda r: r["v"]))
    return days.withColumn("_v", values).withColumn(
        "pool", F.sort_array(F.flatten(F.collect_list("_v").over(w)))).drop("_v")


def heat_thresholds(panel: DataFrame, unit: Sequence[str] = ("unit",), doy: str = "doy",
                    value: str = "value", percentile: float = HEAT_PERCENTILE,
                    half_window: int = HEAT_HALF_WINDOW, min_pool: int = HEAT_MIN_POOL,
                    method: str = "nearest_rank", season_days: int = SEASON_DAYS,
                    keep_days: bool = False, laid_out: bool = False, carry: str | None = None) -> DataFrame:
    """Threshold per unit and season day from the +/- `half_window` day pool.

    The pool is clipped to the season, and a day with fewer than `min_pool`
    values has no threshold. With `keep_days` the (year, value) list of each day
    stays beside its threshold, which saves a join back to the days.
    """
    days = by_day(panel, unit, doy, value, 1, season_days, laid_out, carry)
    pooled = _pooled(days, unit, doy, half_window, half_window)
    rule = nearest_rank if method == "nearest_rank" else linear_percentile
    n = F.size("pool")
    out = pooled.withColumn("n_pool", n).withColumn(
        "threshold", F.when(n >= min_pool, rule(F.col("pool"), percentile)))
    return out.select(*unit, doy, "n_pool", "threshold", *(["own"] if keep_days else []))


def season_doy_range(months: Sequence[int]) -> tuple[int, int]:
    """First and last day-of-year the months can have, over common and leap years."""
    starts = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365)
    first = starts[min(months) - 1] + 1
    last = starts[max(months)] + (1 if max(months) >= 2 else 0)
    return first, last


def exceedance_thresholds(field: DataFrame, unit: Sequence[str] = ("cell",), doy: str = "doy",
                          value: str = "value", percentile: float = EXCEED_PERCENTILE,
                          before: int = EXCEED_WINDOW_BEFORE, after: int = EXCEED_WINDOW_AFTER,
                          months: Sequence[int] = (6, 7, 8), keep_days: bool = False) -> DataFrame:
    """Interpolated percentile per place and day of year over d - 14 .. d + 16.

    The field must already be limited to the months. A season inside one year cannot reach
    across the year's end; the whole year can, and there day numbers wrap on a
    366-day ring, for which the days near the ends are repeated outside it.
    """
    first, last = season_doy_range(months)
    days = by_day(field, unit, doy, value, first, last)
    if first - before < 1 or last + after > 366:
        turn = F.array(*[F.lit(s) for s in (-366, 0, 366)])
        ring = days.withColumn("_turn", F.explode(turn)).withColumn(
            "_d", F.col(doy) + F.col("_turn"))
        ring = ring.filter(F.col("_d").between(1 - before, 366 + after))
        days = _pooled(ring, unit, "_d", before, after).filter(F.col("_turn") == 0)
    else:
        days = _pooled(days, unit, doy, before, after)
    out = days.withColumn("n_pool", F.size("pool")).withColumn(
        "threshold", F.when(F.size("pool") > 0, linear_percentile(F.col("pool"), percentile)))
    return out.select(*unit, doy, "n_pool", "threshold", *(["own"] if keep_days else []))
