"""Calendar expressions over DateType columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.defaults import MAY_SEP


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1)))).cast("int")


def season_day(day: Column) -> Column:
    """Day of the May-September season: 1 May is 1, 30 September is 153."""
    offset = F.when(is_leap(F.year(day)), 121).otherwise(120)
    return (F.dayofyear(day) - offset).cast("int")


def leap_slot(day: Column) -> Column:
    """Position on a 366-day axis shared by all years; slot 59 is 29 February."""
    doy = F.dayofyear(day)
    return F.when(is_leap(F.year(day)) | (doy <= 59), doy - 1).otherwise(doy).cast("int")


def slot_to_date(year: Column, slot: Column) -> Column:
    """Inverse of `leap_slot`; NULL for slot 59 of a year without 29 February."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    shift = F.when(is_leap(year) | (slot < 59), slot).when(slot > 59, slot - 1)
    return F.date_add(start, shift.cast("int"))


def month_day(day: Column) -> Column:
    """Calendar day as month * 100 + day of month."""
    return (F.month(day) * 100 + F.day(day)).cast("int")


def parse_yyyymmdd(value: Column) -> Column:
    """Date of a yyyymmdd string or integer; NULL when it is not a date."""
    text = F.trim(value.cast("string"))
    return F.when(
        text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    )


def format_yyyymmdd(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")


def epoch_hours(ts: Column) -> Column:
    """Whole hours since 1970-01-01 00 UTC of an instant (TimestampType)."""
    return F.floor(F.unix_timestamp(ts) / 3600).cast("bigint")


def epoch_hours_utc_clock(ts: Column) -> Column:
    """The same for a zone-less timestamp that shows UTC; the session's zone plays no part."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return (days.cast("bigint") * 24 + F.hour(ts)).cast("bigint")


def day_spine(
    spark: SparkSession, first_year: int, last_year: int, months: Sequence[int] = tuple(MAY_SEP)
) -> DataFrame:
    """Every date of the given months and years: (day, year, month)."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
                       F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
        ).alias("day")
    )
    return days.select("day", F.year("day").alias("year"), F.month("day").alias("month")).filter(
        F.col("month").isin(list(months))
    )


def year_spine(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    return spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
