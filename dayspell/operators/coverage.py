"""How much of the possible record a unit holds, and screens built on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import (
    HEAT_HALF_WINDOW, HEAT_MIN_POOL, HEAT_MIN_SHARE, RECORD_MIN_SHARE, RECORD_MIN_YEARS, SEASON_DAYS,
)


def year_counts(panel: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Days with a value per unit and year."""
    return (
        panel.filter(F.col(value).isNotNull())
        .groupBy(unit, F.col("year")).agg(F.count("*").alias("n_days"))
    )


def coverage(panel: DataFrame, span_years: int, unit: str = "unit", value: str = "value",
             season_days: int = SEASON_DAYS) -> DataFrame:
    """Years with data and share of possible days per unit.

    Two plain aggregates; a distinct count would carry every (unit, year) twice.
    """
    return (
        year_counts(panel, unit, value).groupBy(unit)
        .agg(F.count("*").alias("n_years"), F.sum("n_days").alias("n_days"))
        .withColumn("share", F.col("n_days") / F.lit(float(span_years * season_days)))
    )


def coverage_matrix(panel: DataFrame, years: tuple[int, int], unit: str = "unit",
                    value: str = "value") -> DataFrame:
    """Unit x year table of day counts, 0 where a year has none."""
    names = list(range(years[0], years[1] + 1))
    wide = year_counts(panel, unit, value).groupBy(unit).pivot("year", names).agg(F.sum("n_days"))
    return wide.na.fill(0)


def keep_complete(panel: DataFrame, span_years: int, min_years: int = RECORD_MIN_YEARS,
                  min_share: float = RECORD_MIN_SHARE, unit: str | Sequence[str] = "unit",
                  value: str = "value", season_days: int = SEASON_DAYS) -> DataFrame:
    """Rows of units that pass the completeness rule.

    Windows over the unit instead of a second scan and a semi join: a unit holds
    at most one row per calendar day, and the records step reuses the same
    partitioning.
    """
    w = Window.partitionBy(*([unit] if isinstance(unit, str) else unit))
    has = F.col(value).isNotNull()
    return (
        panel.withColumn("_y", F.size(F.collect_set(F.when(has, F.col("year"))).over(w)))
        .withColumn("_d", F.count(F.when(has, 1)).over(w))
        .filter((F.col("_y") >= min_years)
                & (F.col("_d") / F.lit(float(span_years * season_days)) >= min_share))
        .drop("_y", "_d")
    )


def lossless_bounds(min_share: float = HEAT_MIN_SHARE, season_days: int = SEASON_DAYS,
                    min_pool: int = HEAT_MIN_POOL,
                    half_window: int = HEAT_HALF_WINDOW) -> tuple[int, int]:
    """(days a year needs, days a unit needs in all) before any heat-wave count can exist."""
    per_year = math.ceil(min_share * season_days)
    return per_year, math.ceil(per_year * min_pool / (2 * half_window + 1))


def lossless_screen(panel: DataFrame, unit: str = "unit", value: str = "value",
                    season_days: int = SEASON_DAYS, **kw) -> DataFrame:
    """Drop units whose every heat-wave count would be NULL anyway.

    Windows inside one layout by unit, which `spells.heatwave_counts` can use as it
    is (`laid_out=True`), so the screen costs no shuffle and no second scan.
    """
    per_year, total = lossless_bounds(season_days=season_days, **kw)
    whole, year = Window.partitionBy(unit), Window.partitionBy(unit, "year")
    return (
        panel.filter(F.col(value).isNotNull()).repartition(unit)
        .withColumn("_in_year", F.count("*").over(year))
        .withColumn("_best", F.max("_in_year").over(whole))
        .withColumn("_total", F.count("*").over(whole))
        .filter((F.col("_total") >= total) & (F.col("_best") >= per_year))
        .drop("_in_year", "_best", "_total")
    )


def blank_after_last_full_year(series: DataFrame, daily: DataFrame, day: str = "day",
                               value: str = "value") -> DataFrame:
    """NULL for years past the last one the daily data covers to 31 December.

    An absent year is not a year of zero.
    """
    return blank_after(series, last_full_year(daily, day), value)


def last_full_year(daily: DataFrame, day: str = "day") -> Column:
    """Last year the data covers to 31 December, as one value."""
    last = F.max(day)
    return daily.agg(
        (F.year(last) - F.when(F.date_format(last, "MMdd") == "1231", 0).otherwise(1)).alias("y")).scalar()


def blank_after(series: DataFrame, year: Column, value: str = "value") -> DataFrame:
    return series.withColumn(value, F.when(F.col("year") <= year, F.col(value)))
