"""What a master-table run has, and the rules it follows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dayspell.defaults import COUNT_IDW_RADIUS_CONUS_KM, RECORD_YEARS
from dayspell.operators import spatial
from dayspell.plans.master import REANALYSES


@dataclass(frozen=True)
class Inputs:
    """Prepared tables; leave out what a run does not have.

    months[(dataset, elem)]: (cell, year, month, value); weights[dataset]: (cell, weight).
    daily[(dataset, elem)]: (cell, day, value), whole years where the archive has them.
    cells[dataset]: (cell, lat, lon, fraction, conus, land).
    """

    months: Mapping[tuple[str, str], DataFrame] = field(default_factory=dict)
    weights: Mapping[str, DataFrame] = field(default_factory=dict)
    daily: Mapping[tuple[str, str], DataFrame] = field(default_factory=dict)
    cells: Mapping[str, DataFrame] = field(default_factory=dict)
    national: Mapping[str, DataFrame] = field(default_factory=dict)  # elem -> (year, month, value)
    pair_months: DataFrame | None = None   # `stations.reconstruct_pair(...).months`, with lat and lon
    pair_days: DataFrame | None = None     # (unit, day, raw, adj), May-September
    pair_stations: DataFrame | None = None  # (unit, lat, lon)
    station_cells: DataFrame | None = None  # (cell, lat, lon, weight) the pair's anomalies are gridded to
    berkeley_grid: spatial.Grid | None = None
    reanalyses: tuple[str, ...] = REANALYSES  # datasets that take Berkeley's land by area


@dataclass(frozen=True)
class Rules:
    """Keyword arguments passed through to the plans; empty means the defaults."""

    season: dict = field(default_factory=dict)
    stations: dict = field(default_factory=dict)
    record_years: tuple[int, int] = RECORD_YEARS
    records: dict = field(default_factory=dict)
    smooth_years: int = 17
    band: dict = field(default_factory=dict)
    heat: dict = field(default_factory=dict)
    radius_km: float = COUNT_IDW_RADIUS_CONUS_KM
