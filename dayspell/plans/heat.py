"""Heat-wave days and exceedance maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import BAND_LAT, COUNT_IDW_RADIUS_CONUS_KM, JJA
from dayspell.functions.dates import season_day
from dayspell.functions.geo import cos_lat
from dayspell.operators import gridding, guards, qc, spatial, spells


def season_panel(daily: DataFrame, unit: Sequence[str] = ("unit",), value: str = "tmax",
                 bounds: tuple[float, float] | None = None) -> DataFrame:
    """May-September rows with year and season day; open bounds blank impossible values."""
    df = qc.in_months(daily)
    if bounds is not None:
        df = qc.within_bounds(df, value, bounds, strict=True)
    return df.select(*unit, F.year("day").alias("year"), season_day(F.col("day")).alias("doy"),
                     F.col(value).alias("value"))


def grid_counts(panel: DataFrame, unit: Sequence[str] = ("cell",), **kw) -> DataFrame:
    """Heat-wave days per cell and year; cells need no threshold-coverage gate."""
    return spells.heatwave_counts(panel, unit, need_thresholds=False, **kw)


def grid_series(counts: DataFrame, cells: DataFrame, lat_bounds: tuple[float, float] = BAND_LAT,
                lon_bounds: tuple[float, float] = (-180.0, 180.0)) -> DataFrame:
    """cos(lat) mean per year over the masked domain: (year, hw_days, coverage)."""
    return gridding.cosine_mean(counts, cells, value="hw_days", lat_bounds=lat_bounds,
                                lon_bounds=lon_bounds)


@dataclass(frozen=True)
class StationReduction:
    """Every way a station network becomes a series."""

    field: DataFrame          # (cell, year, hw_days, n_stations), accepted cells
    coverage: DataFrame       # (year, coverage), cos(lat) share of all masked cells accepted
    series: DataFrame         # (year, hw_days, coverage), both within the latitude bounds
    fixed_series: DataFrame   # (year, hw_days), the same over cells accepted in every year
    station_mean: DataFrame   # (year, hw_days, coverage), mean over stations


def _reduce(counts: DataFrame, weights: DataFrame, cells: DataFrame, station_weights: DataFrame,
            lat_bounds, lon_bounds, **rule) -> StationReduction:
    field = gridding.weighted_counts(counts, weights, **rule)
    on = dict(value="hw_days", lat_bounds=lat_bounds, lon_bounds=lon_bounds)
    domain = cells.select("cell", cos_lat(F.col("lat")).alias("weight"))
    return StationReduction(
        field,
        gridding.mean_over(field, domain, value="hw_days").select("year", "coverage"),
        gridding.cosine_mean(field, cells, **on),
        gridding.fixed_cells_mean(field, gridding.cosine_domain(cells, lat_bounds, lon_bounds)),
        gridding.mean_over(counts, station_weights, value="hw_days", key="unit"),
    )


def reduce_stations(counts: DataFrame, stations: DataFrame, cells: DataFrame,
                    radius_km: float = COUNT_IDW_RADIUS_CONUS_KM,
                    lat_bounds: tuple[float, float] = BAND_LAT,
                    lon_bounds: tuple[float, float] = (-180.0, 180.0), **rule) -> StationReduction:
    """Counts at stations -> interpolated field -> area mean, with its diagnostics.

    `counts` is read by several results; write it to a table first when it comes
    from a large scan.
    """
    weights = gridding.radius_weights(spatial.radial_pairs(cells, stations, radius_km), radius_km)
    own = stations.select("unit", cos_lat(F.col("lat")).alias("weight"))
    return _reduce(counts, weights, cells, own, lat_bounds, lon_bounds, **rule)


def counts_at_network(cell_counts: DataFrame, stations: DataFrame, grid: spatial.Grid) -> DataFrame:
    """Cell counts carried to the stations inside the cells, one pseudo station per station."""
    sites = grid.snap(stations).select("unit", "cell")
    return sites.join(cell_counts, "cell").select("unit", "year", "hw_days")


def reduce_at_network(cell_counts: DataFrame, stations: DataFrame, grid: spatial.Grid, cells: DataFrame,
                      radius_km: float = COUNT_IDW_RADIUS_CONUS_KM,
                      lat_bounds: tuple[float, float] = BAND_LAT,
                      lon_bounds: tuple[float, float] = (-180.0, 180.0), check: bool = True, **rule) -> StationReduction:
    """The reduction of `counts_at_network` without copying a cell's counts to its stations.

    All pseudo stations of a source cell carry the same counts, so their weights
    are summed per source cell first. A network that crowds into one cell then
    costs no more than one station there. A station without a position fails the
    job unless `check` is off.
    """
    sites = grid.snap(guards.require_positions(stations) if check else stations).select("unit", "lat", "lon", F.col("cell").alias("source"))
    pairs = spatial.radial_pairs(cells, sites, radius_km)
    weights = gridding.shared_weights(gridding.radius_weights(pairs, radius_km), sites)
    own = sites.groupBy(F.col("source").alias("unit")).agg(F.sum(cos_lat(F.col("lat"))).alias("weight"))
    counts = cell_counts.withColumnRenamed("cell", "unit")
    return _reduce(counts, weights, cells, own, lat_bounds, lon_bounds, **rule)


def co_sampled_series(cell_counts: DataFrame, footprint: DataFrame, cells: DataFrame,
                      lat_bounds: tuple[float, float] = BAND_LAT,
                      lon_bounds: tuple[float, float] = (-180.0, 180.0)) -> DataFrame:
    """A gridded line averaged, each year, over the cells another line carried a value in."""
    carried = footprint.filter(F.col("hw_days").isNotNull()).select("cell", "year")
    shared = cell_counts.join(carried, ["cell", "year"], "left_semi")
    return grid_series(shared, cells, lat_bounds, lon_bounds)


def exceedance_map(field: DataFrame, eras: dict[str, tuple[int, int]], months: Sequence[int] = JJA,
                   land: DataFrame | None = None, axis: DataFrame | None = None, **kw) -> DataFrame:
    """Share of days above the local percentile in each era, and its change, over land."""
    season = qc.in_months(field, months).select(
        "cell", F.year("day").alias("year"), F.dayofyear("day").alias("doy"), "value")
    return exceedance_map_of_season(season, eras, months, land, axis, **kw)


def exceedance_map_of_season(season: DataFrame, eras: dict[str, tuple[int, int]], months: Sequence[int] = JJA,
                             land: DataFrame | None = None, axis: DataFrame | None = None, **kw) -> DataFrame:
    """The same from season rows (cell, year, doy, value). Without an `axis` they are read a second time for it, so
    they should be a written table."""
    out = spells.exceedance_share(season, eras, months=months, axis=axis, **kw)
    return out if land is None else out.join(land.select("cell"), "cell", "left_semi")
