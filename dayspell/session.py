"""Session helper: settings for tests and local runs.

On a cluster the caller's own session is used as it is; nothing in the
library changes a running session's settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "dayspell", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DAYSPELL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # do not look up the Python call site of every expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
