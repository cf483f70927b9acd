"""Season-mean temperature anomalies of stations, fields and official series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import (
    BAND_LAT, BASELINE, IDW_NEIGHBOURS, IDW_POWER, IDW_RADIUS_KM, JJA, MAD_K, MIN_AREA_FRACTION,
    MIN_BASE_YEARS_BAND, MIN_BASE_YEARS_CELL, MIN_BASE_YEARS_STATION, MIN_JJA_DAYS,
    MIN_LAND_FRACTION, MONTH_COMPLETENESS,
)
from dayspell.operators import anomaly, gridding, monthly, series, spatial


def station_month_values(months: DataFrame, elem: str, leg: str | None = None,
                         completeness: float = MONTH_COMPLETENESS) -> DataFrame:
    """Complete station-month means (unit, year, month, lat, lon, value) of one element."""
    stem = f"{elem}_{leg}" if leg else elem
    names = (f"{stem}_sum", f"{stem}_n") if leg else (f"{stem}_s", f"{stem}_n")
    return monthly.complete_months(
        months.select("unit", "year", "month", "lat", "lon", *names), *names, completeness)


def seasonal_anomaly_field(field_months: DataFrame, weights: DataFrame, months: Sequence[int] = JJA,
                           years: tuple[int, int] | None = None, baseline: tuple[int, int] = BASELINE,
                           min_base: int = MIN_BASE_YEARS_CELL, check: bool = True) -> DataFrame:
    """Monthly field -> cell anomalies -> area mean -> season mean: (year, value, fraction).

    With `years` every year of the span has a row. A field that lacks a month of the season anywhere in the baseline
    would silently lose that baseline: it fails the job unless `check` is off.
    """
    anomalies = anomaly.anomalies(field_months, ("cell", "month"), baseline=baseline, min_years=min_base)
    area = anomaly.weighted_area_mean(anomalies, weights)
    return anomaly.season_means(area, months, years, values=("value", "fraction"), spine=True, whole=baseline if check else None)


def station_field(values: DataFrame, cells: DataFrame, baseline: tuple[int, int] = BASELINE,
                  min_base: int = MIN_BASE_YEARS_STATION, k: int = IDW_NEIGHBOURS,
                  power: float = IDW_POWER, radius_km: float = IDW_RADIUS_KM, pairs: DataFrame | None = None) -> DataFrame:
    """Station-month values -> station anomalies -> monthly interpolated field. `pairs` are the distances where the
    caller has them already, of all stations in `values` or more."""
    anomalies = anomaly.anomalies(values, ("unit", "month"), baseline=baseline, min_years=min_base)
    if pairs is None:
        stations = values.groupBy("unit").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        pairs = spatial.near_pairs(cells, stations, radius_km)
    return gridding.nearest_idw(anomalies, pairs, k=k, power=power)


def seasonal_anomaly_stations(values: DataFrame, cells: DataFrame, months: Sequence[int] = JJA,
                              years: tuple[int, int] | None = None,
                              baseline: tuple[int, int] = BASELINE,
                              min_base_station: int = MIN_BASE_YEARS_STATION,
                              min_base_cell: int = MIN_BASE_YEARS_CELL, check: bool = True, **idw) -> DataFrame:
    """The whole station chain; `cells` holds (cell, lat, lon, weight)."""
    live = cells.filter(F.col("weight") > 0)
    field = station_field(values, live, baseline, min_base_station, **idw)
    return seasonal_anomaly_field(field, live, months, years, baseline, min_base_cell, check)


def official_series(national: DataFrame, months: Sequence[int] = JJA,
                    years: tuple[int, int] | None = None, baseline: tuple[int, int] = BASELINE,
                    min_base: int = MIN_BASE_YEARS_CELL, keys: Sequence[str] = (), check: bool = True) -> DataFrame:
    """National monthly means -> monthly anomalies -> season mean: (keys..., year, value); every year of `years` has a
    row, and each series must have every month of the baseline unless `check` is off."""
    anomalies = anomaly.anomalies(national, [*keys, "month"], baseline=baseline, min_years=min_base)
    return anomaly.season_means(anomalies, months, years, keys, spine=True, whole=baseline if check else None)


def checked_series(seasons: DataFrame, keys: Sequence[str] = ("series",), gate: bool = False,
                   min_fraction: float = MIN_AREA_FRACTION, k: float = MAD_K) -> DataFrame:
    """Coverage gate (optional), then the MAD guard, then the tail test."""
    if gate:
        seasons = series.gate_coverage(seasons, minimum=min_fraction)
    return series.trim_tail(series.blank_outliers(seasons, keys, k=k), keys)


def anomaly_table(seasons: DataFrame, years: Sequence[int], old: tuple[int, int],
                  modern: tuple[int, int], keys: Sequence[str] = ("series",), min_years: int = 7,
                  gate: bool = False) -> DataFrame:
    """One row per series: single years, an old era and the modern era, after QC."""
    return series.anomaly_rows(checked_series(seasons, keys, gate), years, old, modern, keys,
                               min_years=min_years)


def band_anomaly(field: DataFrame, cells: DataFrame, mask: str = "land", months: Sequence[int] = JJA,
                 min_days: int = MIN_JJA_DAYS, baseline: tuple[int, int] = BASELINE,
                 min_base: int = MIN_BASE_YEARS_BAND, lat_bounds: tuple[float, float] = BAND_LAT,
                 k: float = MAD_K) -> DataFrame:
    """Daily field -> season mean -> cell anomaly -> land mean with coverage -> MAD guard."""
    seasons = monthly.season_year_means(field, ("cell",), months=months, min_days=min_days)
    return band_of_seasons(seasons, cells, mask, baseline, min_base, lat_bounds, k)


def band_of_seasons(seasons: DataFrame, cells: DataFrame, mask: str = "land", baseline: tuple[int, int] = BASELINE,
                    min_base: int = MIN_BASE_YEARS_BAND, lat_bounds: tuple[float, float] = BAND_LAT,
                    k: float = MAD_K) -> DataFrame:
    """The same from season means (cell, year, value)."""
    land = cells.filter(F.col(mask))
    anomalies = anomaly.anomalies(seasons, ("cell",), baseline=baseline, min_years=min_base)
    band = gridding.cosine_mean(anomalies, land, lat_bounds=lat_bounds)
    named = band.withColumn("series", F.lit("band"))
    return series.blank_outliers(named, k=k).drop("series")


def band_anomaly_nearest_mask(field: DataFrame, cells: DataFrame, source_cells: DataFrame,
                              mask: str = "land", **kw) -> DataFrame:
    """Band anomaly on a finer grid with the land mask of another grid's nearest cells."""
    return band_anomaly(field, spatial.carry_mask_nearest(cells, source_cells, mask), mask, **kw)


def band_anomaly_area_mask(field: DataFrame, cells: DataFrame, source_cells: DataFrame,
                           mask: str = "land", min_land: float = MIN_LAND_FRACTION, **kw) -> DataFrame:
    """Band anomaly on a coarse grid; a cell is land when enough of its area is."""
    shares = spatial.land_fraction(cells, source_cells, mask)
    return band_anomaly(field, shares.withColumn("land", F.col("land_fraction") >= min_land), "land", **kw)


def land_area_share(cells: DataFrame, mask: str = "land") -> DataFrame:
    """Share of the cells' cos(lat) area that is land."""
    w = F.cos(F.radians("lat"))
    return cells.agg((F.sum(F.when(F.col(mask), w).otherwise(0.0)) / F.sum(w)).alias("area_share"))


def homogenization_signal(raw: DataFrame, adjusted: DataFrame, eras: dict[str, tuple[int, int]],
                          years: int = 17, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Smoothed adjusted minus smoothed raw, averaged by era."""
    a = series.lowess(adjusted, keys, years=years).select(*keys, "year", F.col("smooth").alias("value"))
    r = series.lowess(raw, keys, years=years).select(*keys, "year", F.col("smooth").alias("value"))
    gap = series.subtract(a, r, [*keys, "year"])
    return gap.groupBy(*keys).agg(*[
        series.period_mean("value", *span).alias(name) for name, span in eras.items()])
