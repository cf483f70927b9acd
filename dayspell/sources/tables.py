"""The master table as a source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Year x column CSV with numeric columns; empty fields are NULL."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("year").cast("int").alias("year"), *[
        F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != "year"])


def committed_version(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(turn, path) of the version last committed under `folder`; None before the first."""
    try:
        last = spark.read.schema("turn int, path string").json(f"{folder.rstrip('/')}/commits").orderBy(
            F.desc("turn"), F.desc("path")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if last is None else (last["turn"], last["path"])


def committed_master(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Master table and catalogue of the version last committed, which belong together."""
    last = committed_version(spark, folder)
    if last is None:
        return None
    catalogue = spark.read.option("header", True).csv(f"{last[1]}/catalogue")
    return read_master(spark, f"{last[1]}/table"), catalogue
