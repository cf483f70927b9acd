"""Station archives: daily CSV, fixed-width lists and monthly files, pair CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.functions.dates import parse_yyyymmdd
from dayspell.functions.units import fahrenheit_to_celsius
from dayspell.operators.qc import first_wins

DAILY_SCHEMA = (
    "id string, date string, elem string, value string, mflag string, qflag string, "
    "sflag string, obstime string"
)


def _text(start: int, stop: int, line: str = "value") -> Column:
    """Characters [start, stop) of the line, trimmed."""
    return F.trim(F.substring(line, start + 1, stop - start))


def _number(column: Column) -> Column:
    return column.try_cast("double")


def row_ordinal() -> Column:
    """Ingest order as (file, block, row), also for files that are split.

    Files count in the order of their names; the block's start orders the splits
    of a file, and the row number inside the task orders rows inside a block.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))


def read_daily_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless daily files -> (unit, day, elem, value, qflag, ord), value in archive units.

    Unreadable values and dates become NULL; they never fail the job.
    """
    return _daily(spark.read.schema(DAILY_SCHEMA).option("header", False).csv(path), row_ordinal())


def parse_daily(lines: DataFrame, order: str = "ord") -> DataFrame:
    """The same from lines that are already in a table (value, and their ordinal)."""
    rows = lines.select(F.from_csv("value", DAILY_SCHEMA).alias("_row"), F.col(order).alias("_ord"))
    return _daily(rows.select("_row.*", "_ord"), F.col("_ord"))


def _daily(raw: DataFrame, order: Column) -> DataFrame:
    return raw.select(
        F.col("id").alias("unit"), parse_yyyymmdd(F.col("date")).alias("day"), "elem",
        _number(F.trim("value")).alias("value"), "mflag", "qflag", "sflag", "obstime",
        order.alias("ord"))


def parse_station_list(lines: DataFrame, key: str = "unit") -> DataFrame:
    """Fixed-width list -> (unit, lat, lon)."""
    return lines.select(_text(0, 11).alias(key), _number(_text(12, 20)).alias("lat"),
                        _number(_text(21, 30)).alias("lon"))


def parse_inventory(lines: DataFrame, key: str = "unit") -> DataFrame:
    """Fixed-width inventory -> (unit, lat, lon, elem, first_year, last_year)."""
    return lines.select(
        _text(0, 11).alias(key), _number(_text(12, 20)).alias("lat"),
        _number(_text(21, 30)).alias("lon"), _text(31, 35).alias("elem"),
        _text(36, 40).try_cast("int").alias("first_year"),
        _text(41, 45).try_cast("int").alias("last_year"))


def element_positions(inventory: DataFrame, elem: str = "TMAX", key: str = "unit") -> DataFrame:
    """One position per station that lists the element (the listing's positions agree)."""
    return inventory.filter(F.col("elem") == elem).groupBy(key).agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def parse_monthly(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """12-column monthly lines -> (keep..., year, month, value, flag); -9999 is NULL.

    A line has id, element and year in its first 16 characters, then twelve
    values of six characters with three flags each.
    """
    start = (F.col("month") - 1) * 9 + 17
    value = _number(F.trim(F.substr("value", start, F.lit(6))))
    months = lines.filter(F.length("value") >= 16).select(
        *keep, "value", _text(12, 16).try_cast("int").alias("year"),
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return months.select(
        *keep, "year", "month", F.when(value != -9999, value).alias("_v"),
        F.substr("value", start + 6, F.lit(1)).alias("flag")).withColumnRenamed("_v", "value")


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Monthly station files; id, leg (raw / adj) and element come from the file name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    pattern = r"^(.+?)\.(raw|FLs\.52j)\.(tmax|tmin|tavg)$"
    lines = spark.read.text(path).withColumn("_f", name).filter(F.col("_f").rlike(pattern))
    lines = lines.select(
        F.regexp_extract("_f", pattern, 1).alias("unit"),
        F.when(F.regexp_extract("_f", pattern, 2) == "raw", "raw").otherwise("adj").alias("leg"),
        F.regexp_extract("_f", pattern, 3).alias("elem"), "value")
    return parse_monthly(lines, ("unit", "leg", "elem"))


# Element codes of the statewide file (fixed values).
STATEWIDE_CODES = {"tmax": 27, "tmin": 28, "tavg": 2}


def parse_statewide(lines: DataFrame, elem: str, years: tuple[int, int] | None = None) -> DataFrame:
    """National monthly means in degC of one element: (year, month, value).

    Lines are kept by region and element code; -90 F and below is missing.
    """
    prefix = f"1100{STATEWIDE_CODES[elem]:02d}"
    kept = lines.filter(F.col("value").startswith(prefix)).select(
        "value", _text(6, 10).try_cast("int").alias("year"))
    if years is not None:
        kept = kept.filter(F.col("year").between(*years))
    months = kept.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    text = F.substr("value", (F.col("month") - 1) * 7 + 11, F.lit(7))
    v = _number(F.trim(text))
    return months.select("year", "month",
                         F.when(v > -90.0, fahrenheit_to_celsius(v)).alias("value"))


def read_header_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_pair_csv(spark: SparkSession, path: str, months: Sequence[int] | None = None) -> DataFrame:
    """Per-station pair files -> (unit, day, raw, adj).

    The station is the first 11 characters of the file's name, or the name of its
    `unit=` folder, which the writer makes. A day needs both legs; the first row
    of a repeated day wins.
    """
    rows = spark.read.option("header", True).schema(
        "date string, tmax_raw_c string, tmax_adj_c string").csv(path)
    folder = F.regexp_extract(F.input_file_name(), r"/unit=([^/]+)/[^/]+$", 1)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = rows.select(
        F.when(folder != "", F.url_decode(folder)).otherwise(F.substring(name, 1, 11)).alias("unit"), parse_yyyymmdd(F.col("date")).alias("day"),
        _number(F.col("tmax_raw_c")).alias("raw"), _number(F.col("tmax_adj_c")).alias("adj"),
        row_ordinal().alias("ord"))
    rows = rows.filter(F.col("day").isNotNull() & F.col("raw").isNotNull() & F.col("adj").isNotNull())
    if months is not None:
        rows = rows.filter(F.month("day").isin(list(months)))
    return first_wins(rows, ["unit", "day"], "ord", ["raw", "adj"])
