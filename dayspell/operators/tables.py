"""The master table of annual series and its catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.functions.dates import year_spine


def long_to_wide(series: DataFrame, columns: Sequence[str], years: tuple[int, int]) -> DataFrame:
    """Year x column table on the full year spine; the column list is given, so
    the pivot needs no extra pass to find it."""
    wide = series.groupBy("year").pivot("series", list(columns)).agg(F.first("value"))
    return year_spine(series.sparkSession, *years).join(wide, "year", "left")


def wide_to_long(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns is not None else [c for c in table.columns if c != "year"]
    return table.unpivot(["year"], names, "series", "value").filter(F.col("value").isNotNull())


def missing_columns(table: DataFrame, names: Sequence[str]) -> list[str]:
    """Names the table lacks, in the order asked for."""
    held = set(table.columns)
    return [n for n in names if n not in held]


def require_columns(table: DataFrame, names: Sequence[str], purpose: str) -> DataFrame:
    lacking = missing_columns(table, names)
    if lacking:
        raise ValueError(f"{purpose} needs {', '.join(lacking)}, which this table does not hold")
    return table


def one_series(table: DataFrame, name: str) -> DataFrame | None:
    if name not in table.columns:
        return None
    return table.select(F.lit(name).alias("series"), "year", F.col(name).cast("double").alias("value"))


def describe_columns(series: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Catalogue row per series: domain, quantity and dataset from the name, and its span.

    Names read <domain>_<quantity>__<dataset>. With `columns` each of them has a
    row, with no span and 0 years where it holds no value.
    """
    spans = series.filter(F.col("value").isNotNull()).groupBy("series").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count("*").alias("n_years"))
    if columns is not None:
        every = series.sparkSession.createDataFrame([(c,) for c in columns], "series string")
        spans = every.join(spans, "series", "left").na.fill(0, ["n_years"])
    parts = F.split("series", "__")
    head = F.element_at(parts, 1)
    cut = F.instr(head, "_")
    return spans.select(
        F.col("series"),
        F.substring_index(head, "_", 1).alias("domain"),
        F.substr(head, cut + 1).alias("quantity"),
        F.element_at(parts, -1).alias("dataset"),
        "first_year", "last_year", "n_years")


def merge_series(old: DataFrame, new: DataFrame, rebuilt: Sequence[str]) -> DataFrame:
    """Old series, except those rebuilt, plus the new ones."""
    return old.filter(~F.col("series").isin(list(rebuilt))).unionByName(new)
