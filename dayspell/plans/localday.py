"""Local-day products from sub-daily samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import MAY_SEP
from dayspell.operators import localday


def local_day_product(samples: DataFrame, step_hours: int, months: Sequence[int] | None = MAY_SEP,
                      lat_bounds: tuple[float, float] | None = None,
                      keys: Sequence[str] = ("cell",), check: bool = True) -> DataFrame:
    """Band cut, local-day statistics, and the season's local dates with their year.

    A local day can use samples of the neighbouring UTC month, so samples are
    first cut to the months and one day around them, which spares the shuffle the
    rest of the year, and local days are cut exactly afterwards. `check` refuses
    samples that are unevenly spaced or not in degC.
    """
    if lat_bounds is not None:
        samples = samples.filter(F.col("lat").between(*lat_bounds))
    if months is not None:
        utc = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hours") / 24).cast("int"))
        near = [F.month(F.date_add(utc, shift)).isin(list(months)) for shift in (-1, 0, 1)]
        samples = samples.filter(near[0] | near[1] | near[2])
    days = localday.local_days(samples, step_hours, keys, check=check)
    if months is not None:
        days = days.filter(F.month("day").isin(list(months)))
    return days.withColumn("year", F.year("day"))
