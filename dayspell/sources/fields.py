"""Panels and gridded fields kept as long Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.functions.geo import in_box, lon_between, wrap_lon
from dayspell.functions.units import kelvin_to_celsius, null_if_huge
from dayspell.operators.qc import first_wins
from dayspell.operators.spatial import axis_edges

# Names that mean latitude and longitude (fixed values).
COORDINATE_NAMES = {"latitude": "lat", "longitude": "lon"}


def standardise(df: DataFrame, wrap: bool = True) -> DataFrame:
    """Rename coordinate columns to lat and lon and wrap longitude to [-180, 180)."""
    for old, new in COORDINATE_NAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("lon", wrap_lon(F.col("lon"))) if wrap and "lon" in df.columns else df


def read_panel(spark: SparkSession, path: str, columns: Sequence[str],
               box: dict[str, float] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Named columns of a station panel, limited to a box and to years.

    Both limits are plain comparisons on stored columns, so they reach the scan;
    years cut the `year` partitions where there are any, and days otherwise.
    """
    df = spark.read.parquet(path)
    if years is not None:
        df = in_years(df, years)
    if box is not None:
        df = df.filter(in_box(F.col("lat"), F.col("lon"), **box))
    return df.select(*columns)


def read_field(spark: SparkSession, path: str | list[str], lat_bounds: tuple[float, float] | None = None,
               lon_bounds: tuple[float, float] | None = None, months: Sequence[int] | None = None,
               years: tuple[int, int] | None = None, value: str = "value",
               level: tuple[str, int] | None = None) -> DataFrame:
    """A long gridded field (lat, lon, day, value): window, months and years first, then cleaning.

    Latitude limits work for either storage direction; a vertical axis is cut to
    one level.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = standardise(spark.read.parquet(*paths))
    if level is not None:
        df = df.filter(F.col(level[0]) == level[1]).drop(level[0])
    if lat_bounds is not None:
        df = df.filter(F.col("lat").between(min(lat_bounds), max(lat_bounds)))
    if lon_bounds is not None:
        df = df.filter(lon_between(F.col("lon"), *lon_bounds))
    if years is not None:
        df = in_years(df, years)
    if months is not None:
        df = df.filter(F.month("day").isin(list(months)))
    return df.withColumn(value, null_if_huge(F.col(value)))


def in_years(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Rows of the years: by the `year` column, which prunes partitions, and by `day`."""
    held = [c for c in ("year", "day") if c in df.columns]
    if not held:
        raise ValueError("a limit to years needs a year or a day column")
    if "year" in held:
        df = df.filter(F.col("year").between(*years))
    if "day" in held:
        df = df.filter(F.col("day").between(
            F.make_date(F.lit(years[0]), F.lit(1), F.lit(1)),
            F.make_date(F.lit(years[1]), F.lit(12), F.lit(31))))
    return df


def thin(cells: DataFrame, every: int = 4) -> DataFrame:
    """Every `every`-th latitude and longitude of a cell table (lat, lon, ...)."""
    axes = cells.select(F.inline(F.array(
        F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("centre")),
        F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("centre")))))
    kept = axis_edges(axes).filter(F.col("idx") % every == 0)

    def side(axis: str) -> DataFrame:
        return kept.filter(F.col("axis") == axis).select(F.col("centre").alias(axis))

    return cells.join(side("lat"), "lat", "left_semi").join(side("lon"), "lon", "left_semi")


def combine_periods(periods: Sequence[DataFrame], keys: Sequence[str] = ("cell", "day"),
                    value: str = "value") -> DataFrame:
    """Union of overlapping periods; where a key repeats, the earlier period wins."""
    tagged = [p.select(*keys, value).withColumn("_order", F.lit(i)) for i, p in enumerate(periods)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    return first_wins(union, list(keys), "_order", [value])


def celsius_from_attribute(field: DataFrame, units: str, value: str = "value") -> DataFrame:
    kelvin = units.strip().lower() in ("k", "kelvin", "degk") or "kelvin" in units.lower()
    return field.withColumn(value, kelvin_to_celsius(F.col(value))) if kelvin else field


def celsius_by_mean(field: DataFrame, value: str = "value", limit: float = 150.0,
                    by: str | Sequence[str] | None = None) -> DataFrame:
    """Kelvin turned to degC where the mean says so, file by file.

    `by` names what tells the files apart (a file column, or year); without it
    the field is one file. The means are one aggregate, joined back to the rows.
    """
    if by is None:
        mean = field.agg(F.avg(value)).scalar()
        return field.withColumn(value, F.when(mean > limit, kelvin_to_celsius(F.col(value)))
                                .otherwise(F.col(value)))
    keys = [by] if isinstance(by, str) else list(by)
    means = field.groupBy(*keys).agg((F.avg(value) > limit).alias("_kelvin"))
    return field.join(means, keys, "left").withColumn(value, F.when(
        F.col("_kelvin"), kelvin_to_celsius(F.col(value))).otherwise(F.col(value))).drop("_kelvin")


def absolute_from_anomaly(field: DataFrame, climatology: DataFrame, cell: str = "cell",
                          day: str = "day", value: str = "value") -> DataFrame:
    """Anomaly plus its day-of-year climatology (cell, idx 0..364, clim); 31 December of a
    leap year uses the last index."""
    index = F.least(F.dayofyear(day) - 1, F.lit(364)).cast("int")
    joined = field.withColumn("idx", index).join(climatology, [cell, "idx"], "inner")
    return joined.withColumn(value, F.col(value) + F.col("clim")).drop("clim", "idx")
