"""Exceedance, runs of consecutive days and heat-wave day counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import (
    EXCEED_PERCENTILE, HEAT_MIN_RUN, HEAT_MIN_SHARE, HEAT_MIN_POOL, HEAT_HALF_WINDOW, HEAT_PERCENTILE,
    SEASON_DAYS,
)
from dayspell.operators.thresholds import exceedance_thresholds, heat_thresholds


def exceeds(value: Column, threshold: Column, inclusive: bool = True) -> Column:
    """False, not NULL, when either side is missing."""
    test = value >= threshold if inclusive else value > threshold
    return F.coalesce(test, F.lit(False))


def spell_days(days: DataFrame, hot: Column, unit: Sequence[str] = ("unit",), doy: str = "doy",
               min_run: int = HEAT_MIN_RUN) -> DataFrame:
    """Hot days with the length of their run, runs of `min_run` and longer.

    Consecutive days share doy - row_number; a missing day breaks the run.
    """
    key = [*unit, "year"]
    order = Window.partitionBy(*key).orderBy(doy)
    runs = days.filter(hot).withColumn("_island", F.col(doy) - F.row_number().over(order))
    same = Window.partitionBy(*key, "_island")
    return (
        runs.withColumn("run_length", F.count("*").over(same))
        .filter(F.col("run_length") >= min_run).drop("_island")
    )


def days_in_runs(hot_days: Column, min_run: int) -> Column:
    """Days that belong to runs of at least `min_run`, from an array of day numbers.

    A fold over one unit-year's hot days, at most a season long.
    """
    start = F.struct(F.lit(-9).alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(state: Column, d: Column) -> Column:
        run = F.when(d == state["prev"] + 1, state["run"] + 1).otherwise(F.lit(1))
        gain = F.when(run == min_run, F.lit(min_run)).when(run > min_run, F.lit(1)).otherwise(F.lit(0))
        return F.struct(d.alias("prev"), run.alias("run"), (state["total"] + gain).alias("total"))

    return F.aggregate(F.sort_array(hot_days), start, step, lambda s: s["total"])


def heatwave_counts(panel: DataFrame, unit: Sequence[str] = ("unit",), doy: str = "doy",
                    value: str = "value", percentile: float = HEAT_PERCENTILE,
                    half_window: int = HEAT_HALF_WINDOW, min_pool: int = HEAT_MIN_POOL,
                    min_run: int = HEAT_MIN_RUN, min_share: float = HEAT_MIN_SHARE,
                    season_days: int = SEASON_DAYS, method: str = "nearest_rank",
                    inclusive: bool = True, need_thresholds: bool = True,
                    laid_out: bool = False) -> DataFrame:
    """Heat-wave days per unit and year: (unit, year, n_days, hw_days).

    hw_days is NULL below `min_share` valid days, and, for stations
    (`need_thresholds`), when too few season days have a threshold: a short
    record is unknown, not zero. One shuffle by unit carries the thresholds, the
    runs and the counts.
    """
    thresholds = heat_thresholds(panel, unit, doy, value, percentile, half_window, min_pool,
                                 method, season_days, keep_days=True, laid_out=laid_out)
    whole = Window.partitionBy(*unit)
    thresholds = thresholds.withColumn(
        "_tshare", F.count("threshold").over(whole) / F.lit(float(season_days)))
    days = thresholds.select(*unit, doy, "threshold", "_tshare", F.inline("own"))
    hot = exceeds(F.col("v"), F.col("threshold"), inclusive)
    counts = days.groupBy(*unit, "year").agg(
        F.count("*").alias("n_days"),
        F.min("_tshare").alias("_tshare"),
        F.collect_list(F.when(hot, F.col(doy))).alias("_hot"),
    )
    known = F.col("n_days") / F.lit(float(season_days)) >= min_share
    if need_thresholds:
        known = known & (F.col("_tshare") >= min_share)
    return counts.withColumn(
        "hw_days", F.when(known, days_in_runs(F.col("_hot"), min_run))
    ).drop("_tshare", "_hot")


def unit_years(panel: DataFrame, unit: Sequence[str] = ("unit",), doy: str = "doy", value: str = "value",
               records_of: str | None = None, record_years: tuple[int, int] | None = None,
               mean_days: tuple[int, int] | None = None, percentile: float = HEAT_PERCENTILE,
               half_window: int = HEAT_HALF_WINDOW, min_pool: int = HEAT_MIN_POOL, min_run: int = HEAT_MIN_RUN,
               min_share: float = HEAT_MIN_SHARE, season_days: int = SEASON_DAYS, method: str = "nearest_rank",
               inclusive: bool = True, need_thresholds: bool = True, laid_out: bool = False) -> DataFrame:
    """Everything a season tells about a unit and a year, in one chain behind one layout by unit:
    (unit, year, n_days, hw_days, n_records_of, credits, n_mean, mean).

    hw_days as `heatwave_counts`. `credits` lists (doy, credit) of the calendar days whose all-time maximum, over
    `record_years`, falls into the year, N years sharing it with 1/N each; `records_of` names the column it is
    taken from when that is not `value`. `mean` is the average over the season days in `mean_days`.
    """
    thresholds = heat_thresholds(panel, unit, doy, value, percentile, half_window, min_pool, method, season_days,
                                 keep_days=True, laid_out=laid_out, carry=records_of)
    field = "c" if records_of else "v"

    def counts_for_records(r: Column) -> Column:
        live = r[field].isNotNull()
        return live if record_years is None else live & r["year"].between(*record_years)

    whole = Window.partitionBy(*unit)
    thresholds = thresholds.withColumn("_tshare", F.count("threshold").over(whole) / F.lit(float(season_days)))
    thresholds = thresholds.withColumn("_rec", F.transform(F.filter("own", counts_for_records), lambda r: r[field]))
    thresholds = thresholds.withColumn("_top", F.array_max("_rec"))
    thresholds = thresholds.withColumn("_credit", F.lit(1.0) / F.size(F.filter("_rec", lambda v: v == F.col("_top"))))
    days = thresholds.select(*unit, doy, "threshold", "_tshare", "_top", "_credit", F.inline("own"))
    hot = exceeds(F.col("v"), F.col("threshold"), inclusive)
    live = F.col(field).isNotNull() & (F.lit(True) if record_years is None else F.col("year").between(*record_years))
    credit = F.struct(F.col(doy).alias("doy"), F.col("_credit").alias("credit"))
    in_mean = F.col("v") if mean_days is None else F.when(F.col(doy).between(*mean_days), F.col("v"))
    counts = days.groupBy(*unit, "year").agg(
        F.count("v").alias("n_days"), F.min("_tshare").alias("_tshare"),
        F.collect_list(F.when(hot, F.col(doy))).alias("_hot"), F.count(F.when(live, 1)).alias("n_records_of"),
        F.collect_list(F.when(live & (F.col(field) == F.col("_top")), credit)).alias("credits"),
        F.count(in_mean).alias("n_mean"), F.avg(in_mean).alias("mean"))
    known = F.col("n_days") / F.lit(float(season_days)) >= min_share
    if need_thresholds:
        known = known & (F.col("_tshare") >= min_share)
    return counts.withColumn("hw_days", F.when(known, days_in_runs(F.col("_hot"), min_run))).drop("_tshare", "_hot")


def axis_days(field: DataFrame, doy: str = "doy") -> DataFrame:
    """Days a dataset's own time axis has in each year: (year, n_axis)."""
    return field.select("year", doy).distinct().groupBy("year").agg(F.count("*").alias("n_axis"))


def exceedance_share(field: DataFrame, eras: dict[str, tuple[int, int]],
                     unit: Sequence[str] = ("cell",), doy: str = "doy", value: str = "value",
                     percentile: float = EXCEED_PERCENTILE, months: Sequence[int] = (6, 7, 8),
                     axis: DataFrame | None = None, **window) -> DataFrame:
    """Mean yearly share (%) of days strictly above the threshold, per place and era.

    A missing value counts as not exceeding, each year divides by the days the
    dataset has that year (`axis`, read from the field when not given), and an
    era averages over the dataset's years in it. The last era minus the first is
    added as `difference`.
    """
    axis = axis_days(field, doy) if axis is None else axis
    thresholds = exceedance_thresholds(field, unit, doy, value, percentile, months=months,
                                       keep_days=True, **window)
    days = thresholds.select(*unit, "threshold", F.inline("own"))
    hot = exceeds(F.col("v"), F.col("threshold"), inclusive=False)
    yearly = days.groupBy(*unit, "year").agg(F.count(F.when(hot, 1)).alias("_hot"))
    # the axis as one value: at most one map entry per year, and the years of every era
    facts = axis.agg(F.struct(
        F.map_from_entries(F.collect_list(F.struct("year", "n_axis"))).alias("days"),
        *[F.count(F.when(F.col("year").between(a, b), 1)).alias(name) for name, (a, b) in eras.items()],
    )).scalar()
    share = F.try_divide(F.col("_hot"), F.try_element_at(facts["days"], F.col("year"))) * 100.0
    yearly = yearly.withColumn("_share", share)
    totals = yearly.groupBy(*unit).agg(*[
        F.coalesce(F.sum(F.when(F.col("year").between(a, b), F.col("_share"))), F.lit(0.0)).alias(name)
        for name, (a, b) in eras.items()])
    names = list(eras)
    out = totals.select(*unit, *[F.try_divide(F.col(n), facts[n]).alias(n) for n in names])
    return out.withColumn("difference", F.col(names[-1]) - F.col(names[0]))
