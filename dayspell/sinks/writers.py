"""Partitioned Parquet and CSV outputs.

Writes are sized with Spark's rebalance hint: small pieces merge and a crowded
partition value is split, so a year or station with very many rows is not
written by one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.operators.tables import describe_columns, long_to_wide
from dayspell.sources.tables import committed_version


def years_present(spark: SparkSession, path: str, column: str = "year") -> DataFrame:
    """Partition values already written; empty when the path does not exist yet."""
    try:
        return spark.read.parquet(path).select(F.col(column).cast("int").alias(column)).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{column} int")


def write_yearly(df: DataFrame, path: str, rebuild: bool = False, column: str = "year") -> None:
    """Yearly Parquet, zstd. Years already there are skipped, or replaced one by one on rebuild."""
    if not rebuild:
        df = df.join(years_present(df.sparkSession, path, column), column, "left_anti")
    (
        df.hint("rebalance", column).write.mode("overwrite" if rebuild else "append")
        .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(column).parquet(path)
    )


def write_station_csv(pairs: DataFrame, path: str, unit: str = "unit",
                      months: Sequence[int] = (5, 6, 7, 8, 9)) -> None:
    """Daily raw and adjusted tmax per station, two decimals, gzip CSV with yyyymmdd dates."""
    rows = pairs.filter(F.col("tmax_raw").isNotNull() & F.month("day").isin(list(months)))
    rows = rows.select(unit, F.date_format("day", "yyyyMMdd").alias("date"),
                       F.bround("tmax_raw", 2).alias("tmax_raw_c"),
                       F.bround("tmax_adj", 2).alias("tmax_adj_c"))
    (
        rows.hint("rebalance", unit).sortWithinPartitions(unit, "date").write.mode("overwrite")
        .option("header", True).option("compression", "gzip").partitionBy(unit).csv(path)
    )


def write_series_csv(series: DataFrame, columns: Sequence[str], years: tuple[int, int], path: str,
                     decimals: int | None = 4) -> None:
    """Year x series CSV. The table has one row per year, so one file is enough."""
    wide = long_to_wide(series, columns, years)
    if decimals is not None:
        wide = wide.select("year", *[F.round(F.col(f"`{c}`"), decimals).alias(c) for c in columns])
    wide.coalesce(1).sortWithinPartitions("year").write.mode("overwrite").option("header", True).csv(path)


def write_master(series: DataFrame, columns: Sequence[str], years: tuple[int, int], table_path: str,
                 catalogue_path: str, labels: DataFrame | None = None,
                 notes: dict[str, str] | None = None) -> None:
    """Master table at full precision plus its catalogue, which has a row for every column, also
    for those without a value, and the columns' notes."""
    write_series_csv(series, columns, years, table_path, decimals=None)
    catalogue = master_catalogue(series, columns, years, labels, notes)
    catalogue.coalesce(1).sortWithinPartitions("series").write.mode("overwrite").option(
        "header", True).csv(catalogue_path)


def master_catalogue(series: DataFrame, columns: Sequence[str], years: tuple[int, int],
                     labels: DataFrame | None = None, notes: dict[str, str] | None = None) -> DataFrame:
    catalogue = describe_columns(series.filter(F.col("year").between(*years)), columns)
    remarks = [(c, (notes or {}).get(c, "")) for c in columns]
    catalogue = catalogue.join(series.sparkSession.createDataFrame(remarks, "series string, note string"), "series", "left")
    if labels is not None:
        catalogue = catalogue.join(labels, "series", "left")
    return catalogue


def commit_master(series: DataFrame, columns: Sequence[str], years: tuple[int, int], folder: str,
                  labels: DataFrame | None = None, notes: dict[str, str] | None = None) -> str:
    """Table and catalogue as one new version under `folder`, replaced together.

    Both are written into a fresh subfolder, and one row in `commits` then makes it the version that
    `sources.tables.committed_master` reads; a run that stops before that leaves the last version in force.
    """
    spark = series.sparkSession
    folder = folder.rstrip("/")
    version = f"{folder}/version-{uuid.uuid4().hex}"
    write_master(series, columns, years, f"{version}/table", f"{version}/catalogue", labels, notes)
    last = committed_version(spark, folder)
    row = spark.createDataFrame([((last[0] if last else 0) + 1, version)], "turn int, path string")
    row.coalesce(1).write.mode("append").json(f"{folder}/commits")
    return version


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def wide_days(panel: DataFrame, units: Sequence[str], unit: str = "unit", day: str = "day",
              value: str = "value") -> DataFrame:
    """Date x station table for a given, limited station list; the long table is preferred."""
    listed = panel.filter(F.col(unit).isin(list(units)))
    return listed.groupBy(day).pivot(unit, list(units)).agg(F.first(value))
