"""From raw station rows to panels, offsets, pairs and the two-degree field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import BAND_LAT
from dayspell.operators import gridding, joins, monthly, pairs, qc, spatial


def qc_station_band(obs: DataFrame, stations: DataFrame,
                    lat_bounds: tuple[float, float] = BAND_LAT) -> DataFrame:
    """Raw rows -> QC'd daily panel (unit, day, tmax, tmin, lat, lon) of a latitude band.

    Only listed stations are kept before the panel is built, so the shuffle
    carries nothing it will drop.
    """
    band = stations.filter(F.col("lat").between(*lat_bounds))
    kept = joins.keep_listed(obs, band.select("unit"))
    return joins.attach_positions(qc.daily_panel(kept), band)


def qc_cube(obs: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Raw rows -> leap-aligned cube rows, limited to a station axis."""
    return qc.slot_cube(obs if axis is None else joins.keep_listed(obs, axis))


def homogenization_offsets(raw: DataFrame, adjusted: DataFrame | None = None) -> DataFrame:
    """Monthly raw and adjusted legs -> one row of offsets per unit and month.

    One table that holds both legs (a `leg` column, as the reader gives it) is read once.
    """
    offsets = pairs.leg_offsets(raw) if adjusted is None else pairs.monthly_offsets(raw, adjusted)
    return pairs.offsets_wide(offsets)


@dataclass(frozen=True)
class Pair:
    """Daily pair and its station-month sums."""

    daily: DataFrame
    months: DataFrame


def reconstruct_pair(daily: DataFrame, offsets: DataFrame) -> Pair:
    """Daily raw values plus monthly offsets -> raw and adjusted legs.

    Stations without a single paired tmax day drop out.
    """
    legs = pairs.keep_paired_units(pairs.paired_days(daily, offsets))
    return Pair(legs, monthly.paired_months(legs))


def grid_stations(panel: DataFrame, grid: spatial.Grid | None = None, value: str = "tmax") -> DataFrame:
    """Daily two-degree cell means of a station panel with lat and lon; stations outside the
    grid's latitudes drop out instead of joining its edge rows."""
    g = grid or spatial.two_degree_band()
    south, north = g.lat0 - g.dlat / 2, g.lat0 + (g.nlat - 0.5) * g.dlat
    return gridding.bin_daily(panel.filter(F.col("lat").between(south, north)), g, value)
