"""Anomalies against a baseline, area means and season means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import BASELINE, MIN_BASE_YEARS_CELL
from dayspell.functions.dates import days_in_month
from dayspell.functions.geo import cos_lat, lon_between
from dayspell.operators.guards import stop


def _in_base(value: str, baseline: tuple[int, int]) -> Column:
    return F.when(F.col("year").between(*baseline), F.col(value))


def climatology(df: DataFrame, keys: Sequence[str] = ("unit", "month"), value: str = "value",
                baseline: tuple[int, int] = BASELINE,
                min_years: int = MIN_BASE_YEARS_CELL) -> DataFrame:
    """Baseline mean per key, for keys with enough baseline values."""
    base = df.filter(F.col("year").between(*baseline))
    return (
        base.groupBy(*keys).agg(F.avg(value).alias("clim"), F.count(value).alias("n_base"))
        .filter(F.col("n_base") >= min_years)
    )


def anomalies(df: DataFrame, keys: Sequence[str] = ("unit", "month"), value: str = "value",
              baseline: tuple[int, int] = BASELINE, min_years: int = MIN_BASE_YEARS_CELL,
              drop: bool = True) -> DataFrame:
    """value minus the baseline mean of its key.

    The climatology is a window over the key (at most one value per year), so
    the table is shuffled once and not joined with itself. Without a
    climatology rows drop out, or stay with NULL when `drop` is False.
    """
    w = Window.partitionBy(*keys)
    base = _in_base(value, baseline)
    out = df.withColumn("_clim", F.avg(base).over(w)).withColumn("_n", F.count(base).over(w))
    anomaly = F.when(F.col("_n") >= min_years, F.col(value) - F.col("_clim"))
    out = out.withColumn(value, anomaly).drop("_clim", "_n")
    return out.filter(F.col(value).isNotNull()) if drop else out


def weighted_area_mean(field: DataFrame, weights: DataFrame, by: Sequence[str] = ("year", "month"),
                       cell: str | Sequence[str] = "cell", value: str = "value") -> DataFrame:
    """Mean over reporting cells by weight, and the share of all weight they carry."""
    on = [cell] if isinstance(cell, str) else list(cell)
    live = weights.filter(F.col("weight") > 0).select(*on, "weight")
    total = live.agg(F.sum("weight")).scalar()
    w = F.col("weight")
    summed = (
        field.filter(F.col(value).isNotNull()).join(live, on, "inner")
        .groupBy(*by).agg(F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("_w"))
    )
    return summed.select(*by, (F.col("_wv") / F.col("_w")).alias(value),
                         (F.col("_w") / total).alias("fraction"))


def cosine_weights(cells: DataFrame, lat: str = "lat", mask: str | None = None,
                   lat_bounds: tuple[float, float] | None = None,
                   lon_bounds: tuple[float, float] | None = None) -> DataFrame:
    """A cell table with weight = cos(lat), limited to a mask and a box."""
    out = cells
    if mask is not None:
        out = out.filter(F.col(mask))
    if lat_bounds is not None:
        out = out.filter(F.col(lat).between(*lat_bounds))
    if lon_bounds is not None:
        out = out.filter(lon_between(F.col("lon"), *lon_bounds))
    return out.withColumn("weight", cos_lat(F.col(lat)))


def season_offsets(months: Sequence[int]) -> list[int]:
    """Year of each month relative to the year of the season's last month: a month of a greater
    number than the last one belongs to the year before."""
    return [-1 if m > months[-1] else 0 for m in months]


def season_means(monthly: DataFrame, months: Sequence[int] = (6, 7, 8),
                 years: tuple[int, int] | None = None, keys: Sequence[str] = (),
                 values: Sequence[str] = ("value",), spine: bool = False,
                 whole: tuple[int, int] | None = None) -> DataFrame:
    """Day-weighted season means, NULL unless every month of the season is there.

    A season carries the year of its last month, so December of one year joins
    January and February of the next. With `spine` (and `years`) each key has a row
    for every year of the span, NULL where it has no data. `whole` names years for
    which every month must have a row of each key, or the job fails.
    """
    df = monthly.filter(F.col("month").isin(list(months)))
    if years is not None:
        df = df.filter(F.col("year").between(*years))
    label = F.col("year")
    for m, shift in zip(months, season_offsets(months)):
        if shift:
            label = F.when(F.col("month") == m, F.col("year") - shift).otherwise(label)
    length = days_in_month(F.col("year"), F.col("month"))
    aggs = []
    for v in values:
        weighted = F.sum(F.col(v) * length) / F.sum(F.when(F.col(v).isNotNull(), length))
        aggs.append(F.when(F.count(v) == len(months), weighted).alias(v))
    out = df.groupBy(*keys, label.cast("int").alias("_label")).agg(*aggs, F.count_distinct("month").alias("_months"))
    out = out.withColumnRenamed("_label", "year")
    spine = spine and years is not None
    if not (spine or whole):
        out = out.drop("_months")
        return out.filter(F.col("year").between(*years)) if years is not None else out
    # one row per key, with an entry per year at most
    entry = F.struct(F.col("year").alias("k"), F.struct(*values, "_months").alias("v"))
    packed = out.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_by_year"))
    if whole:
        span = F.sequence(F.lit(whole[0]), F.lit(whole[1]))
        lacking = F.filter(span, lambda y: F.coalesce(F.try_element_at("_by_year", y)["_months"], F.lit(0)) < len(months))
        told = F.concat(F.lit("months are missing in "), F.array_join(F.slice(lacking, 1, 5).cast("array<string>"), ", "))
        packed = packed.withColumn("_by_year", stop(F.size(lacking) == 0, told, F.col("_by_year")))
    if spine:
        year = F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year")
        held = packed.select(*keys, "_by_year", year).withColumn("_v", F.try_element_at("_by_year", F.col("year")))
        return held.select(*keys, "year", *[F.col("_v")[v].alias(v) for v in values])
    out = packed.select(*keys, F.explode("_by_year").alias("year", "_v")).select(*keys, "year", *[F.col("_v")[v].alias(v) for v in values])
    return out.filter(F.col("year").between(*years)) if years is not None else out
