"""Ingest by year: only years whose source files changed are read and written again.

A manifest lists path, size and time of every source file at the last refresh. The files of now are anti-joined with
it; what is new, changed or gone names the years to rebuild.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.sinks.writers import write_yearly

FILES = "path string, bytes bigint, modified timestamp, year int, turn int"


def source_files(spark: SparkSession, paths: str | Sequence[str], year_pattern: str = r"(\d{4})[^/]*$") -> DataFrame:
    """(path, bytes, modified, year) of the files behind `paths`; their contents are not read. The year is what the pattern
    finds in the path."""
    files = spark.read.format("binaryFile").load(paths).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.withColumn("year", F.regexp_extract("path", year_pattern, 1).try_cast("int"))


def listed_files(spark: SparkSession, manifest: str) -> DataFrame:
    """The files of the last refresh; none before the first."""
    try:
        rows = spark.read.schema(FILES).parquet(manifest)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], FILES)
    last = rows.agg(F.max("turn").alias("_last"))
    return rows.join(last, F.col("turn") == F.col("_last")).drop("_last")


def changed_years(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(year, n_files): years with a new, changed or removed file, and how many files they have now."""
    on = ["path", "bytes", "modified"]
    fresh = files.join(listed, on, "left_anti").select("year")
    gone = listed.join(files, "path", "left_anti").select("year")
    have = files.groupBy("year").agg(F.count("*").alias("n_files"))
    return fresh.union(gone).distinct().join(have, "year", "left").na.fill(0, ["n_files"])


def refresh_years(spark: SparkSession, paths: str | Sequence[str], out: str, manifest: str,
                  read: Callable[[list[str]], DataFrame], year_pattern: str = r"(\d{4})[^/]*$") -> list[int]:
    """Bring the yearly table at `out` up to its source files; the years written.

    `read` turns a list of files into rows with a `year` column. All files of a changed year are read, other years are not
    touched. A year that lost all its files keeps its rows until somebody drops them, and an error says so before
    anything is written. The manifest is written last: a stopped refresh does its years again.
    """
    files, listed = source_files(spark, paths, year_pattern), listed_files(spark, manifest)
    stale = {r["year"]: r["n_files"] for r in changed_years(files, listed).collect()}  # a calendar's years
    if None in stale:
        raise ValueError("a source file's path names no year")
    lost = sorted(y for y, n in stale.items() if n == 0)
    if lost:
        raise ValueError(f"no source files are left for {lost}")
    if not stale:
        return []
    own = files.filter(F.col("year").isin(list(stale)))
    rows = read([r["path"] for r in own.select("path").collect()])
    write_yearly(rows.filter(F.col("year").isin(list(stale))), out, rebuild=True)
    turn = listed.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
    files.withColumn("turn", F.lit(turn)).coalesce(1).write.mode("append").parquet(manifest)
    return sorted(stale)
