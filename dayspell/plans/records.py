"""Record-count series, the sampling correction and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import (
    LOWESS_YEARS, MIN_CELL_FRACTION, RECORD_MIN_SHARE, RECORD_MIN_YEARS, RECORD_YEARS, SEASON_DAYS, TREND_STARTS,
)
from dayspell.operators import coverage, guards, joins, qc, records, series, spatial


def _span(years: tuple[int, int]) -> int:
    return years[1] - years[0] + 1


def complete_unit_counts(panel: DataFrame, years: tuple[int, int] = RECORD_YEARS,
                         min_years: int = RECORD_MIN_YEARS, min_share: float = RECORD_MIN_SHARE,
                         unit: str | Sequence[str] = "unit", axis: DataFrame | None = None) -> DataFrame:
    """Record counts per year of the units that pass the completeness rule.

    `panel` is (unit, day, year, value), one row per day, season months only.
    Completeness, credit and counts share one layout by unit.
    """
    keys = [unit] if isinstance(unit, str) else list(unit)
    kept = coverage.keep_complete(
        panel.select(*keys, "day", "year", "value"), _span(years), min_years, min_share, keys)
    return records.unit_record_counts(kept, keys, axis=axis, laid_out=True)


def _sum_of(check: bool) -> float | None:
    """What a record series must sum to: every unit holds one record on each season day."""
    return float(SEASON_DAYS) if check else None


def network_series(panel: DataFrame, years: tuple[int, int] = RECORD_YEARS, check: bool = True, **kw) -> DataFrame:
    """Mean record count per station and year: (year, value)."""
    return records.record_series(complete_unit_counts(panel, years, **kw), years, expected=_sum_of(check))


def pair_series(pairs: DataFrame, years: tuple[int, int] = RECORD_YEARS,
                min_years: int = RECORD_MIN_YEARS, min_share: float = RECORD_MIN_SHARE, check: bool = True) -> DataFrame:
    """Record series of both legs: (series, year, value), completeness judged on the raw leg.

    The legs share their days, so each leg's own coverage is the same.
    """
    if check:
        pairs = guards.require_both_legs(pairs)
    long = pairs.select("unit", "day", F.year("day").alias("year"), "raw", "adj").unpivot(
        ["unit", "day", "year"], ["raw", "adj"], "series", "value")
    counts = complete_unit_counts(long, years, min_years, min_share, ("series", "unit"))
    return records.record_series(counts, years, by=("series",), expected=_sum_of(check))


def grid_counts(field: DataFrame, cells: DataFrame, years: tuple[int, int] = RECORD_YEARS,
                min_fraction: float = MIN_CELL_FRACTION, axis: DataFrame | None = None, **kw) -> DataFrame:
    """Record counts per cell and year of a whole-year field's season, complete cells of the
    domain only. `cells` is (cell, fraction[, land]); `axis` lists the field's dates and is
    read from the field when the caller has no cheaper list."""
    axis = field if axis is None else axis
    own = joins.keep_listed(field, domain_cells(cells, min_fraction).select("cell"), "cell")
    season = qc.in_months(own, years=years).withColumn("year", F.year("day"))
    return complete_unit_counts(season, years, unit="cell", axis=qc.in_months(axis, years=years), **kw)


def domain_cells(cells: DataFrame, min_fraction: float = MIN_CELL_FRACTION) -> DataFrame:
    """Cells with enough of their area inside the polygon, and on land where that is known."""
    kept = cells.filter(F.col("fraction") >= min_fraction)
    return kept.filter(F.col("land")) if "land" in cells.columns else kept


def grid_series(counts: DataFrame, cells: DataFrame, axis: DataFrame | None,
                years: tuple[int, int] = RECORD_YEARS, blank: bool = True, check: bool = True) -> DataFrame:
    """Record series of a grid, cells weighted by their share; years past the last full one
    of the whole-year axis are blanked, because absent is not zero."""
    out = records.record_series(counts, years, "cell",
                                cells.select("cell", F.col("fraction").alias("weight")), expected=_sum_of(check))
    return coverage.blank_after_last_full_year(out, axis) if blank else out


def at_network_series(cell_counts: DataFrame, stations: DataFrame, grid: spatial.Grid,
                      years: tuple[int, int] = RECORD_YEARS, axis: DataFrame | None = None,
                      check: bool = True) -> DataFrame:
    """Cell record counts seen at station sites: a cell counts once per station in it.

    The duplicates of a cell are one weight, so the counts are not copied per
    station. With the field's whole-year `axis`, years past its last full one are
    blanked.
    """
    placed = guards.require_positions(stations) if check else stations
    weights = grid.snap(placed).groupBy("cell").agg(F.count("*").cast("double").alias("weight"))
    out = records.record_series(cell_counts, years, "cell", weights, expected=_sum_of(check))
    return out if axis is None else coverage.blank_after_last_full_year(out, axis)


def at_network_cells_series(cell_counts: DataFrame, stations: DataFrame, grid: spatial.Grid,
                            cells: DataFrame, years: tuple[int, int] = RECORD_YEARS, check: bool = True) -> DataFrame:
    """The same cells without the density weighting: each once, weighted by its share."""
    placed = guards.require_positions(stations) if check else stations
    used = grid.snap(placed).select("cell").distinct()
    weights = cells.join(used, "cell", "left_semi").select("cell", F.col("fraction").alias("weight"))
    return records.record_series(cell_counts, years, "cell", weights, expected=_sum_of(check))


def at_network_masked_series(field: DataFrame, stations: DataFrame, station_days: DataFrame,
                             grid: spatial.Grid, kept_cells: DataFrame, axis: DataFrame,
                             years: tuple[int, int] = RECORD_YEARS) -> DataFrame:
    """Each station in a kept cell carries its cell's values, only on days the station reported.

    `kept_cells` (cell) passed share, land and completeness. A station that never
    reports holds no record but counts in the mean; years past the last full one
    of the whole-year `axis` are blanked.
    """
    sites = joins.keep_listed(grid.snap(stations).select("unit", "cell"), kept_cells, "cell")
    carried = station_days.select("unit", "day").join(sites, "unit").join(field, ["cell", "day"])
    counts = records.unit_record_counts(carried, axis=field)
    out = records.record_series(counts, years, members=sites.select("unit"))
    return coverage.blank_after_last_full_year(out, axis)


def sampling_factor(full: DataFrame, sampled: DataFrame, years: int = LOWESS_YEARS,
                    smooth: bool = True) -> DataFrame:
    """Full-grid series over the same field at network sites, smoothed first: (year, value)."""
    if not smooth:
        return joins.ratio_of(full, sampled)
    both = full.select(F.lit("full").alias("series"), "year", "value").unionByName(
        sampled.select(F.lit("sampled").alias("series"), "year", "value"))
    side = {s: F.max(F.when(F.col("series") == s, F.col("smooth"))) for s in ("full", "sampled")}
    # one smoothing pass over both, set side by side per year
    return series.lowess(both, years=years).groupBy("year").agg(
        F.try_divide(side["full"], side["sampled"]).alias("value"))


def sampling_correction(target: DataFrame, full: DataFrame, sampled: DataFrame,
                        years: int = LOWESS_YEARS, smooth: bool = True) -> DataFrame:
    return joins.product_of(target, sampling_factor(full, sampled, years, smooth))


def trend_table(all_series: DataFrame, starts: Sequence[int] = TREND_STARTS,
                last: int = RECORD_YEARS[1], keys: Sequence[str] = ("series",), **kw) -> DataFrame:
    return series.trends(all_series, keys, starts=starts, last=last, **kw)


def robustness_table(all_series: DataFrame, era: tuple[int, int] = (1930, 1939),
                     years: int = LOWESS_YEARS, passes: int = 3,
                     keys: Sequence[str] = ("series",)) -> DataFrame:
    """Peak of an era: annual, plain smooth and robust smooth, and how much it is lowered."""
    smoothed = series.lowess(all_series, keys, years=years, passes=passes, plain="plain")
    inside = F.col("year").between(*era)
    out = smoothed.groupBy(*keys).agg(*[
        F.max(F.when(inside, F.col(c))).alias(name)
        for c, name in (("value", "annual"), ("plain", "smooth_plain"), ("smooth", "smooth_robust"))])
    return out.withColumn("lowered", 1 - F.try_divide("smooth_robust", "smooth_plain"))
