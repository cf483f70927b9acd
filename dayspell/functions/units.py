"""Missing values and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if(value: Column, *sentinels: float) -> Column:
    """NULL for NaN, infinities and the listed sentinel values."""
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if sentinels:
        bad = bad | v.isin([float(s) for s in sentinels])
    return F.when(~bad, v)


def null_if_huge(value: Column, limit: float = 1e4) -> Column:
    """NULL for NaN and for magnitudes of `limit` or more."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < limit), v)


def tenths(value: Column) -> Column:
    return value / 10.0


def kelvin_to_celsius(value: Column) -> Column:
    return value - 273.15


def fahrenheit_to_celsius(value: Column) -> Column:
    return (value - 32.0) * 5.0 / 9.0


def mean_of_pair(a: Column, b: Column) -> Column:
    """(a + b) / 2, NULL unless both exist."""
    return (a + b) / 2.0


def flag_is_blank(flag: Column) -> Column:
    return F.coalesce(F.trim(flag.cast("string")), F.lit("")) == ""
