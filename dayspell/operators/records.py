"""All-time daily records with split ties, and their annual means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import SEASON_DAYS
from dayspell.functions.dates import month_day
from dayspell.operators.guards import stop


def _names(unit: str | Sequence[str]) -> list[str]:
    return [unit] if isinstance(unit, str) else list(unit)


def record_credit(panel: DataFrame, unit: str | Sequence[str] = "unit", day: str = "day",
                  value: str = "value", laid_out: bool = False, check: bool = True) -> DataFrame:
    """Rows that hold the all-time maximum of their unit and calendar day.

    N years that share a maximum get 1/N each. The data is laid out by unit
    once (not again when `laid_out` says it already is), and both windows and
    the sums after them stay inside that layout. A second row for a unit and day
    would share a record with itself: it fails the job unless `check` is off.
    """
    keys = _names(unit)
    rows = panel.filter(F.col(value).isNotNull())
    if not laid_out:
        rows = rows.select(*keys, day, value).repartition(*keys)
    rows = rows.withColumn("month_day", month_day(F.col(day)))
    w = Window.partitionBy(*keys, "month_day")
    if check:
        first = F.coalesce(F.col(day) > F.lag(day).over(w.orderBy(day)), F.lit(True))
        rows = rows.withColumn(value, stop(first, "a unit holds two rows for one day", F.col(value)))
    top = rows.withColumn("_max", F.max(value).over(w)).filter(F.col(value) == F.col("_max"))
    return top.withColumn("credit", F.lit(1.0) / F.count("*").over(w)).drop("_max")


def days_in_two_years(dates: DataFrame, day: str = "day") -> DataFrame:
    """Calendar days that a dataset's own date axis carries in at least two years."""
    return (
        dates.select(day).distinct()
        .groupBy(month_day(F.col(day)).alias("month_day")).agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= 2).select("month_day")
    )


def unit_record_counts(panel: DataFrame, unit: str | Sequence[str] = "unit", day: str = "day",
                       value: str = "value", axis: DataFrame | None = None,
                       laid_out: bool = False, check: bool = True) -> DataFrame:
    """Record credit per unit and year. `axis` gives the dataset's dates when they
    are not the canonical many-year calendar."""
    credit = record_credit(panel, unit, day, value, laid_out, check)
    if axis is not None:
        credit = credit.join(days_in_two_years(axis, day), "month_day", "left_semi")
    return credit.groupBy(*_names(unit), F.year(day).alias("year")).agg(F.sum("credit").alias("records"))


def record_series(counts: DataFrame, years: tuple[int, int], unit: str = "unit",
                  weights: DataFrame | None = None, by: Sequence[str] = (),
                  members: DataFrame | None = None, expected: float | None = None,
                  tolerance: float = 0.5) -> DataFrame:
    """Weighted mean record count per year; a year without records is 0.

    One series, or one per `by` key. `weights` (unit, weight) limits and weighs the units. Every unit with data
    holds a record, so the units and their total weight come out of the counts
    themselves in the same pass: each unit's first row carries its weight. Where
    units without data belong to the mean, `members` (unit) names all units.

    Every unit holds one record per calendar day it observed, so a complete series sums to the days of the season.
    `expected` makes a series that does not fail the job, from the row that holds its total anyway.
    """
    if members is not None:
        idle = members.select(unit, F.lit(years[0]).alias("year"), F.lit(0.0).alias("records")).distinct()
        counts = counts.select(unit, "year", "records").unionByName(idle)
    if weights is not None:
        counts = counts.join(
            weights.select(unit, F.col("weight").cast("double").alias("_w")), unit, "inner")
    else:
        counts = counts.withColumn("_w", F.lit(1.0))
    first = F.row_number().over(Window.partitionBy(*by, unit).orderBy("year")) == 1
    marked = counts.withColumn("_member", F.when(first, F.col("_w")).otherwise(0.0))
    yearly = marked.groupBy(*by, "year").agg(F.sum(F.col("_w") * F.col("records")).alias("_s"),
                                        F.sum("_member").alias("_m"))
    # one row per series, holding at most one entry per year
    whole = yearly.groupBy(*by).agg(F.sum("_m").alias("_total"), F.map_from_entries(
        F.collect_list(F.struct("year", "_s"))).alias("_by_year"))
    if expected is not None:
        held = F.aggregate(F.map_values("_by_year"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
        gap = F.abs(F.try_divide(held, F.col("_total")) - expected)
        told = F.concat(F.lit(f"a record series must sum to {expected:g}; this one is off by "), gap.cast("string"))
        whole = whole.withColumn("_total", stop(gap < tolerance, told, F.col("_total")))
    return whole.select(
        *by, F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"),
        "_total", "_by_year",
    ).select(*by, "year", F.try_divide(F.coalesce(F.try_element_at("_by_year", "year"), F.lit(0.0)),
                                  F.col("_total")).alias("value"))


def integral(series: DataFrame, expected: float = float(SEASON_DAYS),
             tolerance: float = 0.5) -> DataFrame:
    """Sum of a record series and whether it equals the number of season days."""
    total = series.agg(F.sum("value").alias("integral"))
    return total.withColumn("ok", F.abs(F.col("integral") - expected) < tolerance)


def expected_rate(series: DataFrame, keys: tuple[str, ...] = (),
                  season_days: int = SEASON_DAYS) -> DataFrame:
    """Records a year would hold in a stationary climate: season days / years with a value."""
    return series.groupBy(*keys).agg(
        F.try_divide(F.lit(float(season_days)), F.count("value")).alias("expected"))
