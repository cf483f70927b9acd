"""Builders of every master-table column from prepared tables.

`Inputs` names the tables a run has; `builders` returns one lazy builder per
column those tables allow. Datasets differ in where their land mask comes from
and in how TAVG is formed, and in nothing else. What columns share comes from
`master_facts.Facts`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.defaults import IDW_RADIUS_KM, MASTER_YEARS
from dayspell.operators import coverage, records, series
from dayspell.plans import anomalies, heat, master
from dayspell.plans import records as record_plans
from dayspell.plans.inputs import Inputs, Rules
from dayspell.plans.master_facts import Facts
from dayspell.plans.store import Store
from dayspell.sinks import writers
from dayspell.sources import tables

CONUS_LON = (-125.0, -65.0)
GRIDDED = ("era5", "berkeley", "20cr", "era20c")
PAIR_LEGS = {"ushcn": "raw", "ushcn_bc": "adj"}

Builder = Callable[[], DataFrame]


def _value(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select("year", F.col(column).alias("value"))


def _mean_of(a: Builder, b: Builder) -> DataFrame:
    return series.mean_pair(a(), b())


def _season_builders(f: Facts) -> dict[str, Builder]:
    """Section 1: season anomalies over the country."""
    t, r = f.t, f.r
    out: dict[str, Builder] = {}

    def name(elem: str, ds: str) -> str:
        return f"conus_jja_{elem}_anom__{ds}"

    for (ds, elem), months in t.months.items():
        if ds in t.weights:
            column = name("tavgmean" if elem == "tmean" else elem, ds)
            out[column] = partial(lambda m, w: _value(anomalies.seasonal_anomaly_field(
                m, w, years=MASTER_YEARS, **r.season)), months, t.weights[ds])
    for ds in GRIDDED:
        if name("tmax", ds) in out and name("tmin", ds) in out:
            out[name("tavg", ds)] = partial(_mean_of, out[name("tmax", ds)], out[name("tmin", ds)])
    for elem, national in t.national.items():
        out[name(elem, "nclimdiv")] = partial(
            lambda n: anomalies.official_series(n, years=MASTER_YEARS, **r.season), national)
    if t.pair_months is not None and t.station_cells is not None:
        rule = {"completeness": r.stations["completeness"]} if "completeness" in r.stations else {}
        chain = {k: v for k, v in r.stations.items() if k != "completeness"}

        def stations(elem: str, leg: str) -> DataFrame:
            return _value(anomalies.seasonal_anomaly_stations(
                anomalies.station_month_values(t.pair_months, elem, leg, **rule), t.station_cells, years=MASTER_YEARS,
                pairs=f.station_pairs(chain.get("radius_km", IDW_RADIUS_KM)), **chain))

        for ds, leg in PAIR_LEGS.items():
            for elem in ("tmax", "tmin", "tavg"):
                out[name(elem, ds)] = partial(stations, elem, leg)
    return out


def _record_builders(f: Facts) -> dict[str, Builder]:
    """Section 2: record counts over the country; a reanalysis is not cut to land here."""
    t, r = f.t, f.r
    out: dict[str, Builder] = {}
    years = r.record_years
    expected = records.SEASON_DAYS if f.check else None

    def pair_leg(leg: str) -> DataFrame:
        counts = f.pair_records().filter(F.col("series") == leg)
        return records.record_series(counts, years, expected=expected)

    if t.pair_days is not None:
        for ds, leg in PAIR_LEGS.items():
            out[f"conus_records__{ds}"] = partial(pair_leg, leg)

    def domain(ds: str) -> DataFrame:
        return t.cells[ds].drop("land") if ds in t.reanalyses else t.cells[ds]

    def grid(ds: str) -> DataFrame:
        full = record_plans.grid_series(f.cell_records(ds, domain(ds)), domain(ds), None, years, blank=False, check=f.check)
        return coverage.blank_after(full, f.last_full_year(ds))

    for ds in ("berkeley", *t.reanalyses):
        if (ds, "tmax") in t.daily and ds in t.cells:
            out[f"conus_records__{ds}"] = partial(grid, ds)
    if "conus_records__berkeley" in out and t.pair_days is not None and t.berkeley_grid is not None:

        def at_network() -> DataFrame:
            seen = record_plans.at_network_series(f.cell_records("berkeley", domain("berkeley")), f.complete_stations(),
                                                  t.berkeley_grid, years, check=f.check)
            return coverage.blank_after(seen, f.last_full_year("berkeley"))

        out["conus_records__berkeley_at_ushcn"] = at_network
        out["conus_records__ushcn_bc_x_sampling"] = lambda: record_plans.sampling_correction(
            pair_leg("adj"), out["conus_records__berkeley"](), at_network(), r.smooth_years)
    return out


def _band_builders(f: Facts) -> dict[str, Builder]:
    """Section 4: land-band anomalies."""
    t = f.t
    out: dict[str, Builder] = {}
    rule = {k: v for k, v in f.r.band.items() if k not in ("months", "min_days", "min_land")}

    def band(ds: str, elem: str) -> DataFrame:
        return _value(anomalies.band_of_seasons(f.season_means(ds, elem), f.mask(ds), **rule))

    for ds, elem in t.daily:
        if ds in GRIDDED and ds in t.cells and "berkeley" in t.cells:
            column = "tavgmean" if elem == "tmean" else elem
            out[f"band_jja_{column}_anom__{ds}"] = partial(band, ds, elem)
    for ds in GRIDDED:
        legs = [out.get(f"band_jja_{e}_anom__{ds}") for e in ("tmax", "tmin")]
        if all(legs):
            out[f"band_jja_tavg_anom__{ds}"] = partial(_mean_of, *legs)
    return out


def _heat_builders(f: Facts) -> dict[str, Builder]:
    """Section 5: heat-wave days over the country and over the land band."""
    t, r = f.t, f.r
    out: dict[str, Builder] = {}

    def grid(ds: str, mask: str, lon) -> DataFrame:
        cells = t.cells[ds].filter(F.col(mask)).select("cell", "lat", "lon")
        return _value(heat.grid_series(f.cell_heat(ds), cells, lon_bounds=lon), "hw_days")

    for ds in GRIDDED:
        if (ds, "tmax") in t.daily and ds in t.cells:
            for domain, mask, lon in (("conus", "conus", CONUS_LON), ("band", "land", (-180.0, 180.0))):
                if mask in t.cells[ds].columns:
                    out[f"{domain}_hw_days__{ds}"] = partial(grid, ds, mask, lon)

    if t.pair_days is not None and "berkeley" in t.cells:
        target = t.cells["berkeley"].filter("conus").select("cell", "lat", "lon")

        def pair(leg: str) -> DataFrame:
            return _value(heat.reduce_stations(f.pair_heat(leg), t.pair_stations, target, r.radius_km,
                                               lon_bounds=CONUS_LON).series, "hw_days")

        for ds, leg in PAIR_LEGS.items():
            out[f"conus_hw_days__{ds}"] = partial(pair, leg)
        if ("berkeley", "tmax") in t.daily and t.berkeley_grid is not None:
            out["conus_hw_days__berkeley_at_ushcn"] = lambda: _value(heat.reduce_at_network(
                f.cell_heat("berkeley").join(target, "cell", "left_semi"), t.pair_stations, t.berkeley_grid, target,
                r.radius_km, lon_bounds=CONUS_LON).series, "hw_days")
    return out


def builders(inputs: Inputs, rules: Rules = Rules(), store: Store | None = None, check: bool = True) -> dict[str, Builder]:
    """Column name -> lazy builder of (year, value), for every column the inputs allow.

    With a store, a builder first writes the shared tables it needs (or finds them), so each daily field
    is scanned once per build however many columns use it; `check` switches the stops on.
    """
    facts = Facts(inputs, rules, store, check)
    out: dict[str, Builder] = {}
    for make in (_season_builders, _record_builders, _band_builders, _heat_builders):
        out.update(make(facts))
    return out


def update(spark: SparkSession, folder: str, inputs: Inputs, rules: Rules = Rules(), sections: Sequence[int] | None = None,
           datasets: Sequence[str] | None = None, rebuild: bool = False, years: tuple[int, int] = MASTER_YEARS,
           check: bool = True, notes: dict[str, str] | None = None) -> list[str]:
    """Build what the table under `folder` lacks of the sections and datasets asked for, and commit table and
    catalogue together; the columns built.

    Shared tables go to `folder/shared` and stay for the next run, also when this one is stopped or refuses an input.
    """
    held = tables.committed_master(spark, folder)
    have = None if held is None else held[0]
    made = builders(inputs, rules, Store(spark, f"{folder.rstrip('/')}/shared"), check)
    todo = [c for c in master.wanted_columns([] if have is None else have.columns, sections, datasets, rebuild) if c in made]
    if todo:
        every = [c for c in master.all_columns() if c in todo or (have is not None and c in have.columns)]
        writers.commit_master(master.build(have, made, todo), every, years, folder, master.labels(spark), notes)
    return todo
