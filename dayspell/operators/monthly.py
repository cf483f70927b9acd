"""Station-month tables and monthly means of daily fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import MIN_MONTH_DAYS, MONTH_COMPLETENESS, STATION_MONTH_BOUNDS
from dayspell.functions.dates import days_in_month


def station_months(daily: DataFrame, elements: Sequence[str] = ("tmax", "tmin", "tavg"),
                   unit: str = "unit", day: str = "day") -> DataFrame:
    """Sums and counts per unit and month, so that partial results add up."""
    aggs = []
    for e in elements:
        aggs += [F.sum(e).alias(f"{e}_s"), F.count(e).alias(f"{e}_n")]
    aggs += [F.min(c).alias(c) for c in ("lat", "lon") if c in daily.columns]
    return daily.groupBy(
        unit, F.year(day).alias("year"), F.month(day).alias("month")).agg(*aggs)


def complete_months(months: DataFrame, sum_col: str, count_col: str,
                    completeness: float = MONTH_COMPLETENESS,
                    bounds: tuple[float, float] = STATION_MONTH_BOUNDS,
                    value: str = "value") -> DataFrame:
    """Means of months with enough days, inside open bounds."""
    n = F.col(count_col)
    need = F.lit(completeness) * days_in_month(F.col("year"), F.col("month"))
    mean = F.try_divide(F.col(sum_col), n)
    return (
        months.filter((n > 0) & (n >= need))
        .withColumn(value, mean)
        .filter((F.col(value) > bounds[0]) & (F.col(value) < bounds[1]))
        .drop(sum_col, count_col)
    )


def field_month_means(field: DataFrame, keys: Sequence[str] = ("cell",), day: str = "day",
                      value: str = "value", min_days: int = MIN_MONTH_DAYS) -> DataFrame:
    """Monthly mean of a daily field; NULL below `min_days` days."""
    return (
        field.groupBy(*keys, F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(F.avg(value).alias("_m"), F.count(value).alias("n_days"))
        .withColumn(value, F.when(F.col("n_days") >= min_days, F.col("_m")))
        .drop("_m")
    )


def season_year_means(field: DataFrame, keys: Sequence[str] = ("cell",), day: str = "day",
                      value: str = "value", months: Sequence[int] = (6, 7, 8),
                      min_days: int = 75) -> DataFrame:
    """Mean over a season's days per place and year; NULL below `min_days` days."""
    return (
        field.filter(F.month(day).isin(list(months)))
        .groupBy(*keys, F.year(day).alias("year"))
        .agg(F.avg(value).alias("_m"), F.count(value).alias("n_days"))
        .withColumn(value, F.when(F.col("n_days") >= min_days, F.col("_m")))
        .drop("_m")
    )


def paired_months(pairs: DataFrame, unit: str = "unit") -> DataFrame:
    """Sums and counts of the raw and adjusted legs, months without tmax and tmin dropped."""
    legs = [f"{e}_{leg}" for e in ("tmax", "tmin", "tavg") for leg in ("raw", "adj")]
    aggs = []
    for c in legs:
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    aggs += [F.min(c).alias(c) for c in ("lat", "lon") if c in pairs.columns]
    return pairs.groupBy(unit, "year", "month").agg(*aggs).filter(
        F.col("tmax_raw_n") + F.col("tmin_raw_n") > 0)
