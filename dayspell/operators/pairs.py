"""Monthly adjustments and the raw / adjusted daily pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.operators.joins import spread_monthly

OFFSET_SCALE = 0.01  # source units of the monthly files to degC


def monthly_offsets(raw: DataFrame, adjusted: DataFrame, unit: str = "unit") -> DataFrame:
    """(adjusted - raw) x 0.01 per unit, month and element, where both files have the year.

    Inputs are long monthly legs (unit, elem, year, month, value, flag); months
    the adjusted leg marks as estimated (flag E) are dropped.
    """
    keys = [unit, "elem", "year", "month"]
    own = F.when(F.coalesce(F.trim("flag"), F.lit("")) != "E", F.col("value"))
    adj = adjusted.select(*keys, own.alias("_a"))
    base = raw.select(*keys, F.col("value").alias("_r"))
    both = adj.join(base, keys, "inner")
    return both.select(*keys, ((F.col("_a") - F.col("_r")) * OFFSET_SCALE).alias("offset")).filter(
        F.col("offset").isNotNull())


def leg_offsets(legs: DataFrame, unit: str = "unit") -> DataFrame:
    """The same from one long table of both legs (unit, leg, elem, year, month, value, flag): one
    conditional aggregate, so the files are read once and not joined with themselves."""
    kept = (F.col("leg") == "raw") | (F.coalesce(F.trim("flag"), F.lit("")) != "E")

    def of(leg: str) -> Column:
        return F.max(F.when((F.col("leg") == leg) & kept, F.col("value")))

    both = legs.groupBy(unit, "elem", "year", "month").agg(((of("adj") - of("raw")) * OFFSET_SCALE).alias("offset"))
    return both.filter(F.col("offset").isNotNull())


def offsets_wide(offsets: DataFrame, unit: str = "unit") -> DataFrame:
    """One row per unit and month with tmax_offset, tmin_offset and tavg_offset."""
    return offsets.groupBy(unit, "year", "month").agg(*[
        F.max(F.when(F.col("elem") == e, F.col("offset"))).alias(f"{e}_offset")
        for e in ("tmax", "tmin", "tavg")])


def paired_days(daily: DataFrame, offsets: DataFrame, unit: str = "unit") -> DataFrame:
    """Raw and adjusted tmax, tmin and tavg on shared valid days.

    A leg pair exists only when the raw value and that element's own offset do;
    tavg needs both raw elements and the tavg offset.
    """
    df = daily.withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    df = spread_monthly(df, offsets, unit)
    raw = {"tmax": F.col("tmax"), "tmin": F.col("tmin"), "tavg": (F.col("tmax") + F.col("tmin")) / 2.0}
    legs: list[Column] = []
    for e, value in raw.items():
        both = value.isNotNull() & F.col(f"{e}_offset").isNotNull()
        legs += [F.when(both, value).alias(f"{e}_raw"),
                 F.when(both, value + F.col(f"{e}_offset")).alias(f"{e}_adj")]
    places = [c for c in ("lat", "lon") if c in daily.columns]
    return df.select(unit, "day", "year", "month", *places, *legs)


def keep_paired_units(pairs: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows of units that have at least one paired tmax day.

    A window over the unit, so the daily pipeline behind `pairs` runs once; a semi
    join would run it again for the list of units.
    """
    any_day = F.count("tmax_raw").over(Window.partitionBy(unit))
    return pairs.withColumn("_n", any_day).filter(F.col("_n") > 0).drop("_n")
