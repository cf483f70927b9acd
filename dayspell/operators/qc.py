"""Quality control of raw observations: flags, bounds, sentinels, first row wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import MAY_SEP, RECORD_BOUNDS
from dayspell.functions import dates, units

# Names a quality-flag column may carry (fixed values).
FLAG_COLUMNS = ("qflag", "q_flag", "tmax_qflag", "quality_flag")


def select_elements(obs: DataFrame, elements: Sequence[str] = ("TMAX", "TMIN"),
                    elem: str = "elem") -> DataFrame:
    return obs.filter(F.col(elem).isin(list(elements)))


def unflagged(columns: Sequence[str], flags: Iterable[str] = FLAG_COLUMNS) -> Column:
    """True where every quality flag among `columns` is blank or NULL; flags are found by name."""
    blank = F.lit(True)
    for name in flags:
        if name in columns:
            blank = blank & units.flag_is_blank(F.col(name))
    return blank


def keep_unflagged(obs: DataFrame, flags: Iterable[str] = FLAG_COLUMNS) -> DataFrame:
    return obs.filter(unflagged(obs.columns, flags))


def is_real(value: str = "value", day: str = "day", sentinels: Sequence[float] = (-9999,)) -> Column:
    """A real date and a finite value that is no sentinel."""
    return units.null_if(F.col(value), *sentinels).isNotNull() & F.col(day).isNotNull()


def drop_missing(obs: DataFrame, value: str = "value", day: str = "day",
                 sentinels: Sequence[float] = (-9999,)) -> DataFrame:
    return obs.filter(is_real(value, day, sentinels))


def is_within(value: str = "value", bounds: tuple[float, float] = RECORD_BOUNDS, strict: bool = False) -> Column:
    v = F.col(value)
    return (v > bounds[0]) & (v < bounds[1]) if strict else v.between(*bounds)


def within_bounds(obs: DataFrame, value: str = "value",
                  bounds: tuple[float, float] = RECORD_BOUNDS, strict: bool = False) -> DataFrame:
    return obs.filter(is_within(value, bounds, strict))


def is_in_season(months: Sequence[int] = MAY_SEP, day: str = "day", years: tuple[int, int] | None = None) -> Column:
    """In the months, and in the years, whose span is a date range."""
    month = F.month(day).isin(list(months))
    if years is None:
        return month
    return F.col(day).between(F.make_date(F.lit(years[0]), F.lit(1), F.lit(1)),
                              F.make_date(F.lit(years[1]), F.lit(12), F.lit(31))) & month


def in_months(df: DataFrame, months: Sequence[int] = MAY_SEP, day: str = "day",
              years: tuple[int, int] | None = None) -> DataFrame:
    """Season filter. The year span is a date range, so it reaches the scan."""
    return df.filter(is_in_season(months, day, years))


def _ordering(order: str | Sequence[str]) -> Column:
    """One ordinal column stays a plain number, which keeps the hash aggregate."""
    if isinstance(order, str):
        return F.col(order)
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_wins(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
               values: Sequence[str]) -> DataFrame:
    """The first row of every key by the ingest ordinal.

    An aggregate, not a ranked window: repeats of a key collapse map-side, so a
    key that holds a third of all rows sends one row per task.
    """
    ordinal = _ordering(order)
    return df.groupBy(*keys).agg(*[F.min_by(v, ordinal).alias(v) for v in values])


def first_wins_wide(obs: DataFrame, keys: Sequence[str], order: str | Sequence[str],
                    elements: dict[str, str], elem: str = "elem",
                    value: str = "value") -> DataFrame:
    """First row per (key, element), elements turned to columns, in one shuffle."""
    ordinal = _ordering(order)
    return obs.groupBy(*keys).agg(*[
        F.min_by(
            F.when(F.col(elem) == code, F.col(value)), F.when(F.col(elem) == code, ordinal)
        ).alias(name)
        for code, name in elements.items()
    ])


def daily_panel(obs: DataFrame, unit: str = "unit", day: str = "day", order: str | Sequence[str] = "ord",
                value: str = "value", in_tenths: bool = True) -> DataFrame:
    """Raw element rows -> one QC'd row per unit and day with tmax and tmin in degC."""
    wide = first_wins_wide(
        keep_unflagged(select_elements(obs)), [unit, day], order,
        {"TMAX": "tmax", "TMIN": "tmin"}, value=value,
    ).filter(F.col("tmax").isNotNull() | F.col("tmin").isNotNull())
    if not in_tenths:
        return wide
    return wide.select(unit, day, *[units.tenths(F.col(c)).alias(c) for c in ("tmax", "tmin")])


def with_tavg(daily: DataFrame) -> DataFrame:
    return daily.withColumn("tavg", units.mean_of_pair(F.col("tmax"), F.col("tmin")))


def slot_cube(obs: DataFrame, unit: str = "unit", day: str = "day", order: str | Sequence[str] = "ord",
              value: str = "value") -> DataFrame:
    """QC'd leap-aligned table: (unit, year, slot, tmax, tmin), values as archived.

    Missing values and bad dates leave before the first row is chosen.
    """
    clean = drop_missing(keep_unflagged(select_elements(obs)), value, day)
    wide = first_wins_wide(clean, [unit, day], order, {"TMAX": "tmax", "TMIN": "tmin"}, value=value)
    return wide.select(unit, F.year(day).alias("year"), dates.leap_slot(F.col(day)).alias("slot"),
                       "tmax", "tmin")


def slots_to_days(cube: DataFrame) -> DataFrame:
    """Leap-aligned slots back to dates; slot 59 leaves the years without 29 February."""
    day = dates.slot_to_date(F.col("year"), F.col("slot"))
    return cube.withColumn("day", day).filter(F.col("day").isNotNull()).drop("slot")
