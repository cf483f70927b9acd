"""What the master table's columns share, one table per input field.

A daily field is read once. Its season rows are laid out by cell, and everything that columns need of a cell and a
year comes out of one chain behind that layout: season mean, record credit, heat-wave days. Country and band columns,
both TAVG legs and the corrections then read these small tables. With a `Store` each is written once and found again by
the next run; the same pass observes the field's dates, so that no column reads it for its time axis, and refuses
a field that breaks a rule. Without a store the same plans stay lazy.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import (
    JJA, MAY_SEP, MIN_JJA_DAYS, MIN_LAND_FRACTION, RECORD_MIN_SHARE, RECORD_MIN_YEARS, SEASON_DAYS,
)
from dayspell.functions.dates import season_day
from dayspell.operators import coverage, guards, joins, qc, spatial, spells
from dayspell.plans import records
from dayspell.plans.inputs import Inputs, Rules
from dayspell.plans.store import Store, fingerprint, observed

PAIR_BOUNDS = (-60.0, 60.0)


class Facts:
    """Tables shared by the builders. `check` switches the stops on."""

    def __init__(self, inputs: Inputs, rules: Rules, store: Store | None = None, check: bool = True):
        self.t, self.r, self.store, self.check = inputs, rules, store, check
        self._made: dict[str, DataFrame] = {}

    def _table(self, name: str, build: Callable[[], DataFrame], *sources: object) -> DataFrame:
        if name not in self._made:
            self._made[name] = build() if self.store is None else self.store.table(
                name, fingerprint(name, repr(self.r), *sources), build)
        return self._made[name]

    # ---- daily fields ----

    def _unit_years(self, rows: DataFrame, unit: tuple[str, ...], need_thresholds: bool, records_of: str | None = None) -> DataFrame:
        months = self.r.band.get("months", JJA)
        panel = rows.withColumn("year", F.year("day")).withColumn("doy", season_day(F.col("day")))
        span = [(dt.date(2001, m, 1) - dt.date(2001, 5, 1)).days + 1 for m in (min(months), max(months) + 1)]
        return spells.unit_years(panel, unit, records_of=records_of, record_years=self.r.record_years,
                                 mean_days=(span[0], span[1] - 1), need_thresholds=need_thresholds, **self.r.heat)

    def _field_years(self, field: DataFrame, cells: DataFrame) -> DataFrame:
        own = joins.keep_listed(field.select("cell", "day", "value"), cells.select("cell"), "cell")
        return self._unit_years(qc.in_months(own), ("cell",), need_thresholds=False)

    def cell_years(self, ds: str, elem: str) -> DataFrame:
        """The shared table of a field, from one scan of it."""
        name = f"cell_years__{ds}__{elem}"
        field, cells = self.t.daily[ds, elem], self.t.cells[ds]
        if name not in self._made and self.store is None:
            self._made[name] = self._field_years(field, cells)
        elif name not in self._made:
            key = fingerprint(name, repr(self.r), field, cells)
            if not self.store.holds(name, key):
                watched, watch = observed(field, guards.field_metrics())

                def judge(metrics) -> None:
                    if self.check:
                        guards.judge_field(guards.FieldFacts.of(metrics), f"{ds} {elem}")

                self.store.write(name, key, self._field_years(watched, cells), watch, judge)
            self._made[name] = self.store.table(name, key, lambda: None)
        return self._made[name]

    def _field_facts(self, ds: str) -> guards.FieldFacts:
        self.cell_years(ds, "tmax")
        return guards.FieldFacts.of(self.store.facts(f"cell_years__{ds}__tmax"))

    def season_means(self, ds: str, elem: str) -> DataFrame:
        """(cell, year, value): season means, NULL below the days a season needs."""
        need = self.r.band.get("min_days", MIN_JJA_DAYS)
        return self.cell_years(ds, elem).select("cell", "year", F.when(F.col("n_mean") >= need, F.col("mean")).alias("value"))

    def _complete_counts(self, years: DataFrame, keys: tuple[str, ...], valid: Column | None) -> DataFrame:
        """(keys, year, records) of the units that pass the completeness rule; only calendar days in `valid` count."""
        first, last = self.r.record_years
        rule = {"min_years": RECORD_MIN_YEARS, "min_share": RECORD_MIN_SHARE, **self.r.records}
        w = Window.partitionBy(*keys)
        held = years.withColumn("_y", F.count(F.when(F.col("n_records_of") > 0, 1)).over(w)).withColumn(
            "_d", F.sum("n_records_of").over(w) / F.lit(float((last - first + 1) * SEASON_DAYS)))
        held = held.filter((F.col("_y") >= rule["min_years"]) & (F.col("_d") >= rule["min_share"]) & (F.size("credits") > 0))
        credits = held.select(*keys, "year", F.inline("credits"))
        if valid is not None:
            credits = credits.filter(F.array_contains(valid, F.col("doy")))
        return credits.groupBy(*keys, "year").agg(F.sum("credit").alias("records"))

    def cell_records(self, ds: str, cells: DataFrame) -> DataFrame:
        """Record counts of the complete cells of a domain, over calendar days that the dataset has in two years."""
        kept = joins.keep_listed(self.cell_years(ds, "tmax"), records.domain_cells(cells).select("cell"), "cell")
        if self.store is None:
            axis = qc.in_months(self.t.daily[ds, "tmax"], years=self.r.record_years).select(season_day(F.col("day")).alias("doy"), F.year("day").alias("year"))
            twice = axis.distinct().groupBy("doy").agg(F.count("*").alias("_n")).filter("_n >= 2")
            return self._complete_counts(kept, ("cell",), twice.agg(F.collect_list("doy")).scalar())
        seen: dict[int, set[int]] = {}
        for d in self._field_facts(ds).days:
            if d.month in MAY_SEP and self.r.record_years[0] <= d.year <= self.r.record_years[1]:
                seen.setdefault((d - dt.date(d.year, 4, 30)).days, set()).add(d.year)
        twice = sorted(k for k, years in seen.items() if len(years) >= 2)
        return self._complete_counts(kept, ("cell",), None if len(twice) == SEASON_DAYS else F.lit(twice or [0]))

    def cell_heat(self, ds: str) -> DataFrame:
        return self.cell_years(ds, "tmax").select("cell", "year", "hw_days")

    def last_full_year(self, ds: str) -> Column:
        """Last year the dataset covers to its end."""
        if self.store is None:
            return coverage.last_full_year(self.t.daily[ds, "tmax"])
        return F.lit(self._field_facts(ds).last_full_year)

    # ---- masks, distances ----

    def mask(self, ds: str) -> DataFrame:
        """Cells of a dataset with the land mask the band uses: ERA5 takes Berkeley's by nearest centre, a reanalysis by area."""
        own = self.t.cells[ds]
        if ds == "berkeley":
            return own
        source = self.t.cells["berkeley"].select("lat", "lon", "land")
        bare = own.select("cell", "lat", "lon")

        def build() -> DataFrame:
            if ds in self.t.reanalyses:
                return spatial.land_fraction(bare, source).withColumn("land", F.col("land_fraction") >= MIN_LAND_FRACTION)
            return spatial.carry_mask_nearest(bare, source)

        return self._table(f"mask__{ds}", build, own, source)

    def station_pairs(self, radius_km: float) -> DataFrame:
        """Distances of the target cells and all stations of the pair, for every element and leg."""
        places = self.t.pair_months.groupBy("unit").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        live = self.t.station_cells.filter(F.col("weight") > 0)
        return self._table("station_pairs", lambda: spatial.near_pairs(live, places, radius_km), radius_km, self.t.pair_months, live)

    # ---- the station pair ----

    @cached_property
    def pair_years(self) -> DataFrame:
        """The shared table of both legs, from one layout by leg and station."""

        def build() -> DataFrame:
            pairs = guards.require_both_legs(self.t.pair_days) if self.check else self.t.pair_days
            rows = pairs.select("unit", "day", "raw", "adj").unpivot(["unit", "day"], ["raw", "adj"], "series", "_all")
            heat = F.when(qc.is_within("_all", PAIR_BOUNDS, strict=True), F.col("_all"))
            return self._unit_years(qc.in_months(rows).withColumn("value", heat), ("series", "unit"), True, "_all")

        return self._table("pair_years", build, self.t.pair_days)

    def pair_records(self) -> DataFrame:
        return self._complete_counts(self.pair_years, ("series", "unit"), None)

    def pair_heat(self, leg: str) -> DataFrame:
        return self.pair_years.filter(F.col("series") == leg).select("unit", "year", "hw_days")

    def complete_stations(self) -> DataFrame:
        """Stations whose raw record passed the completeness rule; each holds a record."""
        kept = self.pair_records().filter("series = 'raw'").select("unit").distinct()
        if not self.check:
            return self.t.pair_stations.join(kept, "unit", "left_semi")
        return guards.attach_all(kept, guards.require_positions(self.t.pair_stations), ("lat", "lon"))
