"""Invariants as queries, and as stops inside a plan's own pass.

A query returns the violations, or a one-row verdict. A stop is either a row-level raise in a pass that the plan
makes anyway, or a set of metrics observed by it (`field_metrics`) and judged before its result counts as
written (`FieldFacts`); neither reads the data again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing_months(field: DataFrame, first_year: int, last_year: int, months: Sequence[int],
                   day: str = "day") -> DataFrame:
    """Expected (year, month) pairs the data lacks."""
    spark = field.sparkSession
    expected = spark.range(first_year, last_year + 1).select(
        F.col("id").cast("int").alias("year"),
        F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
    held = field.select(F.year(day).alias("year"), F.month(day).alias("month")).distinct()
    return expected.join(held, ["year", "month"], "left_anti")


def incomplete_years(field: DataFrame, keys: Sequence[str] = ("cell",), day: str = "day",
                     value: str = "value", expected_days: int = 153) -> DataFrame:
    """Places and years without a value on every expected day."""
    counts = field.groupBy(*keys, F.year(day).alias("year")).agg(F.count(value).alias("n_days"))
    return counts.filter(F.col("n_days") != expected_days)


def unmatched_legs(pairs: DataFrame, a: str = "raw", b: str = "adj") -> DataFrame:
    """How many rows have one leg only."""
    one = F.col(a).isNull() != F.col(b).isNull()
    return pairs.agg(F.count(F.when(one, 1)).alias("n_unmatched"))


def broken_axes(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year") -> DataFrame:
    """Series whose index repeats or skips a step: (keys, n_repeats, n_gaps)."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = F.col(x) - F.lag(x).over(w)
    marked = series.select(*keys, x, step.alias("_step"))
    out = marked.groupBy(*keys).agg(F.count(F.when(F.col("_step") == 0, 1)).alias("n_repeats"),
                                    F.count(F.when(F.col("_step") > 1, 1)).alias("n_gaps"))
    return out.filter((F.col("n_repeats") > 0) | (F.col("n_gaps") > 0))


def without_position(units: DataFrame, stations: DataFrame, unit: str = "unit") -> DataFrame:
    """Units of a series that the position table lacks."""
    placed = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return units.select(unit).distinct().join(placed, unit, "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def nan_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN values that survived ingest, per column."""
    return df.agg(*[F.count(F.when(F.isnan(F.col(c)), 1)).alias(c) for c in columns])


def sanity_mean(samples: DataFrame, value: str = "value", order: str = "hours", first: int = 8,
                bounds: tuple[float, float] = (-60.0, 60.0)) -> DataFrame:
    """Mean over the first sample times and whether it can be degC."""
    early = samples.select(order).distinct().orderBy(order).limit(first)
    mean = samples.join(early, order, "left_semi").agg(F.avg(value).alias("mean"))
    return mean.withColumn("ok", (F.col("mean") > bounds[0]) & (F.col("mean") < bounds[1]))


def enforce(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks `condition`."""
    checked = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.filter(checked)


def require_empty(violations: DataFrame, message: str) -> None:
    """Run the guard now and fail when it finds anything: refuse a partial input."""
    if not violations.isEmpty():
        raise ValueError(message)


def require_units(found: str, expected: tuple[str, ...] = ("degC", "celsius", "C")) -> None:
    if found.strip().lower() not in {e.lower() for e in expected}:
        raise ValueError(f"unexpected unit {found!r}; wanted one of {expected}")


# ---- stops -----------------------------------------------------------------------

class RefusedInput(ValueError):
    """The input breaks a rule that the result would silently depend on."""


def stop(condition: Column, message: str | Column, value: Column) -> Column:
    """`value`, or a failed job where `condition` is false; NULL counts as true."""
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(True)), value).otherwise(F.raise_error(said))


def require_both_legs(pairs: DataFrame, a: str = "raw", b: str = "adj") -> DataFrame:
    """Fail on the first day that has one leg only."""
    return enforce(pairs, F.col(a).isNull() == F.col(b).isNull(), f"{a} and {b} must hold a value on the same days")


def require_positions(stations: DataFrame, unit: str = "unit") -> DataFrame:
    """Fail on the first station without a position. The raise is in the columns: a later cut to a box would filter
    the row out before a filter here looked at it."""
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return stations.withColumns({c: stop(placed, "a station has no position", F.col(c)) for c in ("lat", "lon")})


def attach_all(rows: DataFrame, stations: DataFrame, columns: Sequence[str], unit: str = "unit") -> DataFrame:
    """Rows with their station's columns; fail on the first row whose station is not listed."""
    listed = stations.select(unit, F.struct(*columns).alias("_place"))
    joined = rows.join(listed, unit, "left")
    # a raise in the columns themselves: as a filter it would turn the left join into an inner one, which drops the row
    found = stop(F.col("_place").isNotNull(), "a station is missing from the position table", F.col("_place"))
    return joined.withColumn("_place", found).select(*rows.columns, *[F.col("_place")[c].alias(c) for c in columns])


#: Days from here on have a bit in the observed axis: two bitmaps of 32,768 days reach to the year 2029.
AXIS_START = dt.date(1850, 1, 1)
_BITS = 32768


def field_metrics(day: str = "day", value: str = "value", months: Sequence[int] = (5, 6, 7, 8, 9)) -> list[Column]:
    """What one pass over a field tells about it: its dates as two bitmaps, rows, missing and not-finite values of the
    season, the mean of its values and the dates outside the bitmaps. A task sends a few kilobytes."""
    number = F.datediff(F.col(day), F.lit(AXIS_START)).cast("bigint")
    season = F.month(day).isin(list(months))
    v = F.col(value)
    return [
        *[F.bitmap_construct_agg(F.when(number.between(k * _BITS, (k + 1) * _BITS - 1), number - k * _BITS)).alias(f"axis{k}")
          for k in (0, 1)],
        F.count(F.when(~number.between(0, 2 * _BITS - 1) | number.isNull(), 1)).alias("n_outside"),
        F.count("*").alias("n_rows"),
        F.count(F.when(season & v.isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.isnan(v.cast("double")), 1)).alias("n_nan"),
        F.avg(F.when(~F.isnan(v.cast("double")), v)).alias("mean"),
        F.max(day).alias("last_day")]


@dataclass(frozen=True)
class FieldFacts:
    """The metrics of `field_metrics`, read back."""

    days: tuple[dt.date, ...]
    n_rows: int
    n_missing: int
    n_nan: int
    n_outside: int
    mean: float | None
    last_day: dt.date | None

    @classmethod
    def of(cls, metrics: Mapping[str, object]) -> FieldFacts:
        days = []
        for k in (0, 1):
            bits = metrics[f"axis{k}"]
            raw = bytes.fromhex(bits) if isinstance(bits, str) else bytes(bits or b"")
            days += [AXIS_START + dt.timedelta(days=k * _BITS + 8 * i + j) for i, byte in enumerate(raw) if byte
                     for j in range(8) if byte >> j & 1]
        last, mean = metrics["last_day"], metrics["mean"]
        return cls(tuple(days), *(int(metrics[n]) for n in ("n_rows", "n_missing", "n_nan", "n_outside")),
                   None if mean is None else float(mean),
                   dt.date.fromisoformat(last) if isinstance(last, str) else last)

    @property
    def last_full_year(self) -> int | None:
        if self.last_day is None:
            return None
        return self.last_day.year - int((self.last_day.month, self.last_day.day) != (12, 31))

    def missing_months(self, years: tuple[int, int], months: Sequence[int]) -> list[tuple[int, int]]:
        held = {(d.year, d.month) for d in self.days}
        return [(y, m) for y in range(years[0], years[1] + 1) for m in months if (y, m) not in held]

    def broken_years(self, months: Sequence[int]) -> list[int]:
        """Years whose dates inside the months are not consecutive."""
        by_year: dict[int, list[dt.date]] = {}
        for d in self.days:
            if d.month in months:
                by_year.setdefault(d.year, []).append(d)
        return [y for y, ds in sorted(by_year.items()) if (ds[-1] - ds[0]).days + 1 != len(ds)]

    def short_years(self, months: Sequence[int]) -> list[int]:
        """Years with a date in the months, but not all of them."""
        held: dict[int, int] = {}
        for d in self.days:
            if d.month in months:
                held[d.year] = held.get(d.year, 0) + 1
        length = {y: sum((dt.date(y + m // 12, m % 12 + 1, 1) - dt.date(y, m, 1)).days for m in months) for y in held}
        return [y for y in sorted(held) if held[y] != length[y]]


def judge_field(facts: FieldFacts, name: str, months: Sequence[int] = (5, 6, 7, 8, 9), whole_years: bool = False,
                values: bool = False, years: tuple[int, int] | None = None,
                bounds: tuple[float, float] = (-60.0, 60.0)) -> None:
    """Refuse a field: no rows, NaN left in it, a mean that cannot be degC, a broken season axis; with `years` a missing
    month, with `whole_years` a season that lacks days, with `values` a missing value inside the season."""
    def refuse(broken: bool, what: str) -> None:
        if broken:
            raise RefusedInput(f"{name}: {what}")

    refuse(facts.n_rows == 0, "no rows")
    refuse(facts.n_outside > 0, f"{facts.n_outside} rows with no date, or one far outside the calendar")
    refuse(facts.n_nan > 0, f"{facts.n_nan} NaN values")
    refuse(facts.mean is not None and not bounds[0] < facts.mean < bounds[1], f"mean {facts.mean}: not degC?")
    lacking = facts.missing_months(years, months) if years else []
    refuse(bool(lacking), f"{len(lacking)} months missing, first {lacking[:3]}")
    broken = facts.broken_years(months)
    refuse(bool(broken), f"the days of {broken[:3]} are not consecutive")
    short = facts.short_years(months) if whole_years else []
    refuse(bool(short), f"{short[:3]} lack season days")
    refuse(values and facts.n_missing > 0, f"{facts.n_missing} values missing inside the season")
