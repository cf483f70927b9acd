"""Joins of panels with dimensions, calendars and each other.

No broadcast hints: Spark broadcasts a dimension only when its measured size
is under the session's threshold, and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspell.defaults import MAY_SEP


def attach_positions(panel: DataFrame, stations: DataFrame, unit: str = "unit") -> DataFrame:
    """Add lat and lon; units without a position drop out."""
    places = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return panel.join(places.select(unit, "lat", "lon"), unit, "inner")


def keep_listed(panel: DataFrame, ids: DataFrame, on: str | Sequence[str] = "unit") -> DataFrame:
    return panel.join(ids, on, "left_semi")


def common_ids(a: DataFrame, b: DataFrame, unit: str = "unit") -> DataFrame:
    """Ids that both tables hold."""
    return a.select(unit).intersect(b.select(unit))


def crosswalk_chain(crosswalk: DataFrame, offset_ids: DataFrame, stations: DataFrame,
                    order: str = "ord") -> DataFrame:
    """network id -> archive id -> position, for ids that carry offsets.

    Archive ids must have 11 characters; a network id listed twice keeps the row
    listed first, by the list's ordinal `order`.
    """
    linked = crosswalk.filter(F.length("archive_id") == 11)
    return (
        linked.join(offset_ids.select("archive_id").distinct(), "archive_id", "left_semi")
        .groupBy("network_id").agg(F.min_by("archive_id", order).alias("archive_id"))
        .join(stations.select("network_id", "lat", "lon"), "network_id", "inner")
    )


def spread_monthly(daily: DataFrame, monthly: DataFrame, unit: str = "unit") -> DataFrame:
    """Give every day its station-month columns (left join, days stay)."""
    return daily.join(monthly, [unit, "year", "month"], "left")


def on_calendar(panel: DataFrame, years: tuple[int, int], months: Sequence[int] = MAY_SEP,
                unit: str = "unit", day: str = "day") -> DataFrame:
    """Each unit on the complete calendar of the years, so that gaps stay gaps.

    The calendar is a sequence exploded beside each unit, then one equi-join on
    (unit, day); units and days are never cross-joined as tables.
    """
    days = F.sequence(F.make_date(F.lit(years[0]), F.lit(1), F.lit(1)),
                      F.make_date(F.lit(years[1]), F.lit(12), F.lit(31)))
    season = F.filter(days, lambda d: F.month(d).isin(list(months)))
    frame = panel.select(unit).distinct().select(unit, F.explode(season).alias(day))
    return frame.join(panel, [unit, day], "left")


def matched_legs(raw: DataFrame, adjusted: DataFrame, keys: Sequence[str] = ("unit", "day"),
                 value: str = "value") -> DataFrame:
    """Two legs side by side on the days where both have a value."""
    a = raw.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("raw"))
    b = adjusted.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("adj"))
    return a.join(b, list(keys), "inner")


def mask_to_reporting(field: DataFrame, station_days: DataFrame, unit: str = "unit",
                      day: str = "day", value: str = "value") -> DataFrame:
    """Keep a value only on days the station itself reported; other rows turn NULL."""
    seen = station_days.select(unit, day).distinct().withColumn("_seen", F.lit(True))
    joined = field.join(seen, [unit, day], "left")
    return joined.withColumn(value, F.when(F.col("_seen"), F.col(value))).drop("_seen")


def ratio_of(num: DataFrame, den: DataFrame, value: str = "value",
             keys: Sequence[str] = ("year",)) -> DataFrame:
    """num / den on shared keys; NULL where either is missing or den is zero."""
    a = num.select(*keys, F.col(value).alias("_n"))
    b = den.select(*keys, F.col(value).alias("_d"))
    return a.join(b, list(keys), "inner").select(
        *keys, F.try_divide(F.col("_n"), F.col("_d")).alias(value))


def product_of(series: DataFrame, factor: DataFrame, value: str = "value",
               keys: Sequence[str] = ("year",)) -> DataFrame:
    b = factor.select(*keys, F.col(value).alias("_f"))
    return series.join(b, list(keys), "left").withColumn(
        value, F.col(value) * F.col("_f")).drop("_f")


def on_footprint(field: DataFrame, footprint: DataFrame,
                 keys: Sequence[str] = ("cell", "year")) -> DataFrame:
    """Cells another line carried a value in that year."""
    return field.join(footprint.select(*keys), list(keys), "left_semi")


def _digests(df: DataFrame, groups: Sequence[str], keys: Sequence[str], values: Sequence[str], side: str) -> DataFrame:
    """Per group: rows, values per column, and two sums of row hashes; partial sums, so a group may be of any size."""
    row = [*keys, *values]
    return df.groupBy(*groups).agg(
        F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*row)).alias("a"),
                 F.sum(F.hash(*row).cast("bigint")).alias("b")).alias(f"_d{side}"),
        F.struct(*[F.count(v).alias(v) for v in values]).alias(f"_c{side}"))


def differences(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str],
                tolerance: float = 1e-4, groups: Sequence[str] | None = None) -> DataFrame:
    """One row per value column: counts on each side, unmatched counts, worst gap, verdict.

    Groups of rows (by the first two keys, or `groups`) are compared by digest first. Where all digests agree only they
    are shuffled; rows of the groups that differ meet in one full outer join and one aggregate.
    """
    groups = list(groups or keys[:2])
    doubles = [F.col(v).cast("double").alias(v) for v in values]
    left, right = old.select(*keys, *doubles), new.select(*keys, *doubles)
    told = _digests(left, groups, keys, values, "o").join(_digests(right, groups, keys, values, "n"), groups, "full")
    same = F.coalesce(F.col("_do") == F.col("_dn"), F.lit(False))
    unequal = told.filter(~same).select(*groups)

    def number(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    equal = told.filter(same).agg(*[F.coalesce(F.sum(F.col("_co")[v]), F.lit(0)).alias(v) for v in values])
    settled = equal.select(F.inline(F.array(*[F.struct(
        F.lit(v).alias("name"), F.col(v).alias("n_old"), F.col(v).alias("n_new"), F.lit(0).cast("bigint").alias("only_old"),
        F.lit(0).cast("bigint").alias("only_new"), F.lit(0.0).alias("max_abs_diff")) for v in values])))

    # a null in a group key meets nothing, on either side
    def rest(df: DataFrame, mark: str) -> DataFrame:
        kept = df.join(unequal, [df[g].eqNullSafe(unequal[g]) for g in groups], "left_semi")
        return kept.select(*keys, *[F.col(v).alias(f"_{mark}_{v}") for v in values])

    both = rest(left, "o").join(rest(right, "n"), list(keys), "full")
    aggs = []
    for v in values:
        o, n = F.col(f"_o_{v}"), F.col(f"_n_{v}")
        aggs.append(F.struct(
            F.lit(v).alias("name"),
            F.count(o).alias("n_old"), F.count(n).alias("n_new"),
            number(o.isNotNull() & n.isNull()).alias("only_old"),
            number(o.isNull() & n.isNotNull()).alias("only_new"),
            F.coalesce(F.max(F.abs(o - n)), F.lit(0.0)).alias("max_abs_diff"),
        ).alias(v))
    open_rows = both.agg(*aggs).select(F.inline(F.array(*[F.col(v) for v in values])))
    rows = settled.unionByName(open_rows).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("n_old", "n_new", "only_old", "only_new")], F.max("max_abs_diff").alias("max_abs_diff"))
    return rows.withColumn(
        "same",
        (F.col("only_old") == 0) & (F.col("only_new") == 0) & (F.col("max_abs_diff") < tolerance))
