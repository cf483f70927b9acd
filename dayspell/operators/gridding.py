"""Stations to grids: cell means and distance-weighted interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import (
    BAND_LAT, COUNT_IDW_MIN_STATIONS, COUNT_IDW_SOLO, IDW_NEIGHBOURS, IDW_POWER, IDW_RADIUS_KM,
)
from dayspell.functions.geo import cos_lat, lon_between
from dayspell.operators import spatial


def bin_daily(panel: DataFrame, grid: spatial.Grid, value: str = "tmax", day: str = "day",
              within: Sequence[str] = ()) -> DataFrame:
    """Daily mean of the stations in each cell: (cell, day, value, n_stations); `within` names columns of the
    panel that part a cell's stations further."""
    return (
        grid.bin(panel.filter(F.col(value).isNotNull()))
        .groupBy("cell", day, *within).agg(F.avg(value).alias("value"), F.count("*").alias("n_stations"))
    )


def nearest_idw(values: DataFrame, pairs: DataFrame, by: Sequence[str] = ("year", "month"),
                k: int = IDW_NEIGHBOURS, power: float = IDW_POWER, value: str = "value") -> DataFrame:
    """Inverse-distance mean of the k nearest stations that report, per cell and time.

    `pairs` is `spatial.near_pairs` (static, built once). Ranking filters to k
    before the shuffle as well (Spark's window group limit), so a crowded cell
    sends at most k rows per task. A station within 1 m takes the cell alone.
    """
    ranked = Window.partitionBy("cell", *by).orderBy("km", "unit")
    near = (
        values.filter(F.col(value).isNotNull()).select("unit", *by, value)
        .join(pairs, "unit", "inner")
        .withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k)
    )
    exact = F.col("km") < 1e-3
    w = F.pow(F.greatest(F.col("km"), F.lit(1e-6)), F.lit(-float(power)))
    on_cell = F.avg(F.when(exact, F.col(value)))
    around = F.sum(w * F.col(value)) / F.sum(w)
    return near.groupBy("cell", *by).agg(
        F.coalesce(on_cell, around).alias(value), F.count("*").alias("n_stations"))


def radius_weights(pairs: DataFrame, radius_km: float) -> DataFrame:
    """(cell, unit, w, n): weight (R/d)^2 of every pair, d at least 1 m, each one station."""
    ratio = F.lit(float(radius_km)) / F.greatest(F.col("km"), F.lit(1e-3))
    return pairs.select("cell", "unit", (ratio * ratio).alias("w"), F.lit(1).cast("bigint").alias("n"))


def shared_weights(weights: DataFrame, sites: DataFrame) -> DataFrame:
    """Weights of stations that carry the same source cell's values, summed per source cell.

    `sites` is (unit, source). However many stations a source cell holds, the
    yearly join then has one row for it per target cell.
    """
    return (
        weights.join(sites.select("unit", F.col("source").alias("_src")), "unit", "inner")
        .groupBy("cell", "_src").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        .withColumnRenamed("_src", "unit")
    )


def weighted_counts(counts: DataFrame, weights: DataFrame, by: Sequence[str] = ("year",),
                    value: str = "hw_days", min_stations: int = COUNT_IDW_MIN_STATIONS,
                    solo: float = COUNT_IDW_SOLO) -> DataFrame:
    """Weighted mean of the stations in range that report; accepted cells only.

    A cell needs `min_stations` reporters, or one whose weight passes the solo
    rule. Sums are formed map-side per cell, however many stations are in range.
    """
    sums = (
        counts.filter(F.col(value).isNotNull()).select("unit", *by, value)
        .join(weights, "unit", "inner").groupBy("cell", *by)
        .agg(F.sum(F.col("w") * F.col(value)).alias("_wv"), F.sum("w").alias("_ws"),
             F.sum("n").alias("n_stations"))
    )
    ok = (F.col("n_stations") >= min_stations) | (
        (F.col("n_stations") == 1) & (F.sqrt("_ws") > solo))
    return sums.filter(ok).select(
        "cell", *by, (F.col("_wv") / F.col("_ws")).alias(value), "n_stations")


def count_idw(counts: DataFrame, pairs: DataFrame, radius_km: float, by: Sequence[str] = ("year",),
              value: str = "hw_days", **rule) -> DataFrame:
    """Inverse-square mean of station counts within a radius, per cell and year."""
    return weighted_counts(counts, radius_weights(pairs, radius_km), by, value, **rule)


def _inside(lat_bounds, lon_bounds) -> Column:
    inside = F.col("lat").between(*lat_bounds)
    return inside if lon_bounds is None else inside & lon_between(F.col("lon"), *lon_bounds)


def cosine_mean(field: DataFrame, cells: DataFrame, by: Sequence[str] = ("year",),
                value: str = "value", lat_bounds: tuple[float, float] = BAND_LAT,
                lon_bounds: tuple[float, float] | None = None,
                key: str = "cell") -> DataFrame:
    """cos(lat) mean over the cells (or stations) with a value, and their share of the domain.

    `cells` holds the domain, its mask already applied: (key, lat, lon).
    """
    return mean_over(field, cosine_domain(cells, lat_bounds, lon_bounds, key), by, value, key)


def cosine_domain(cells: DataFrame, lat_bounds: tuple[float, float] = BAND_LAT,
                  lon_bounds: tuple[float, float] | None = None, key: str = "cell") -> DataFrame:
    """Cells inside the bounds with weight = cos(lat)."""
    return cells.filter(_inside(lat_bounds, lon_bounds)).select(key, cos_lat(F.col("lat")).alias("weight"))


def mean_over(field: DataFrame, domain: DataFrame, by: Sequence[str] = ("year",), value: str = "value",
              key: str = "cell") -> DataFrame:
    """Mean by the weights of `domain` (key, weight), and the share of all weight with a value."""
    domain = domain.select(key, F.col("weight").alias("_w"))
    total = domain.agg(F.sum("_w")).scalar()
    sums = (
        field.filter(F.col(value).isNotNull()).join(domain, key, "inner").groupBy(*by)
        .agg(F.sum(F.col("_w") * F.col(value)).alias("_wv"), F.sum("_w").alias("_ws"))
    )
    return sums.select(*by, (F.col("_wv") / F.col("_ws")).alias(value),
                       (F.col("_ws") / total).alias("coverage"))


def fixed_cells(field: DataFrame, value: str = "hw_days", key: str = "cell") -> DataFrame:
    """Cells that carry a value in every year the field has any."""
    live = field.filter(F.col(value).isNotNull())
    n_years = live.select("year").distinct().agg(F.count("*")).scalar()
    per_cell = live.groupBy(key).agg(F.count("*").alias("_n"))
    return per_cell.filter(F.col("_n") == n_years).select(key)


def fixed_cells_mean(field: DataFrame, domain: DataFrame, value: str = "hw_days",
                     key: str = "cell") -> DataFrame:
    """Weighted mean per year over the cells that carry a value in every year: (year, value).

    One pass over the field. Sums are kept per year and per number of years a cell
    has, a table no larger than years squared, and that table then tells how many
    years there are in all.
    """
    live = field.filter(F.col(value).isNotNull()).select(key, "year", value)
    counted = live.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    w = F.coalesce(F.col("_w"), F.lit(0.0))
    sums = (
        counted.join(domain.select(key, F.col("weight").alias("_w")), key, "left")
        .groupBy("year", "_n").agg(F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("_ws"))
    )
    table = sums.agg(F.collect_list(F.struct("year", "_n", "_wv", "_ws")).alias("_t"))
    n_years = F.size(F.array_distinct(F.transform("_t", lambda r: r["year"])))
    rows = table.select(n_years.alias("_all"), F.inline("_t"))
    return rows.filter((F.col("_n") == F.col("_all")) & (F.col("_ws") > 0)).select(
        "year", (F.col("_wv") / F.col("_ws")).alias(value))


def mask_similarity(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Jaccard index of two sets of cells; 0 when both are empty."""
    both = a.select(*keys, F.lit(1).alias("_a")).join(
        b.select(*keys, F.lit(1).alias("_b")), list(keys), "full")
    shared = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return both.agg(F.coalesce(F.try_divide(shared.cast("double"), F.count("*")), F.lit(0.0))
                    .alias("jaccard"))
