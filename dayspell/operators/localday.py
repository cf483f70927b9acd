"""Daily statistics over local calendar days from sub-daily UTC samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.functions.geo import utc_offset_hours
from dayspell.functions.units import mean_of_pair
from dayspell.operators.guards import stop


def local_days(samples: DataFrame, step_hours: int, keys: Sequence[str] = ("cell",),
               hours: str = "hours", lon: str = "lon", value: str = "value", check: bool = False,
               bounds: tuple[float, float] = (-100.0, 100.0)) -> DataFrame:
    """Max, min and mean of each place's local day: (keys, day, tmax, tmin, tmean, tavg).

    At offset k, local day D covers the UTC hours [24 D - k, 24 D - k + 24). A day
    needs each of its 24 / step samples once; otherwise its statistics are NULL, so
    a repeated sample cannot stand in for a missing one. The hours seen are kept as
    bits of one number. The grouping key is an expression, so neighbouring
    files need no margin and each row is shuffled at most once, after partial
    aggregation. With `check` the job fails on a day whose samples are not
    `step_hours` apart (a hole inside the day, a repeat, another step) or whose mean cannot be degC;
    a day that the data only begins or ends in stays NULL.
    """
    if 24 % step_hours:
        raise ValueError("the sample step must divide 24 hours")
    need = 24 // step_hours
    local = F.col(hours) + utc_offset_hours(F.col(lon))
    number = F.floor(local / 24.0).cast("int")
    seen = F.call_function("shiftleft", F.lit(1), F.floor(F.pmod(local, F.lit(24))).cast("int"))
    epoch = F.lit("1970-01-01").cast("date")
    stats = samples.groupBy(*keys, number.alias("_n")).agg(
        F.max(value).alias("tmax"), F.min(value).alias("tmin"), F.avg(value).alias("tmean"),
        F.count(value).alias("n_samples"), F.count("*").alias("_rows"),
        (F.max(hours) - F.min(hours)).alias("_span"), F.bit_or(F.when(F.col(value).isNotNull(), seen)).alias("_seen"),
    )
    if check:  # in the column that decides whether a day is whole, so that no later choice of columns skips it
        even = F.col("_span") == (F.col("_rows") - 1) * step_hours
        degrees = F.col("tmean").between(*bounds)
        told = F.concat(F.lit("a daily mean of "), F.col("tmean").cast("string"), F.lit(": not degC?"))
        stats = stats.withColumn("n_samples", stop(even, f"samples are not {step_hours} h apart", stop(degrees, told, F.col("n_samples"))))
    whole = (F.col("n_samples") == need) & (F.bit_count("_seen") == need)
    out = stats.select(
        *keys, F.date_add(epoch, F.col("_n")).alias("day"), "n_samples",
        *[F.when(whole, F.col(c)).alias(c) for c in ("tmax", "tmin", "tmean")])
    return out.withColumn("tavg", mean_of_pair(F.col("tmax"), F.col("tmin")))


def missing_steps(samples: DataFrame, step_hours: int, keys: Sequence[str] = (),
                  hours: str = "hours") -> DataFrame:
    """Sample times without a successor `step_hours` later, the last one excepted.

    Without keys the dataset's own time axis is tested, with keys each place's.
    Empty for an evenly spaced axis. A hash anti join of distinct times; no
    ordered window over all of them.
    """
    on = [*keys, hours]
    times = samples.select(*on).distinct()
    before = times.select(*keys, (F.col(hours) - step_hours).alias(hours))
    open_ended = times.join(before, on, "left_anti")
    if not keys:
        return open_ended.filter(F.col(hours) < times.agg(F.max(hours)).scalar())
    last = times.groupBy(*keys).agg(F.max(hours).alias("_last"))
    return open_ended.join(last, list(keys)).filter(F.col(hours) < F.col("_last")).drop("_last")


def spacing(samples: DataFrame, keys: Sequence[str] = ("cell",), hours: str = "hours") -> DataFrame:
    """Every gap between consecutive samples of a place and how often it occurs."""
    w = Window.partitionBy(*keys).orderBy(hours)
    gaps = samples.withColumn("gap", F.col(hours) - F.lag(hours).over(w))
    return (
        gaps.filter(F.col("gap").isNotNull())
        .groupBy(*keys, "gap").agg(F.count("*").alias("n"))
    )
