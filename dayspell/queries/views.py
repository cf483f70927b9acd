"""Climate-shaped views over the driver tables, in Spark and in SQL.

The tables hold no climate data, so every query runs on these views. Units and
cells grow with the tables (ten suppliers, or twenty users, make one), so both
the number of places and the work grow with the data while each place keeps the
same density of days.

FIXTURES.md proposes ten fixed units (suppkey mod 10); these views use
suppkey div 10 instead, which gives the same ten units at sf 0.01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspell.functions.dates import epoch_hours_utc_clock
from dayspell.operators import qc
from dayspell.operators.spatial import Grid

# Parameters that suit seven-year views; the library's defaults stay as they are.
YEARS = (1995, 2001)
BASE = (1995, 1997)
MIN_BASE = 2
ERAS = {"early": (1995, 1997), "late": (1999, 2001)}
GRID = Grid(25.0, 2.0, 13, -124.0, 2.0, 30)
RADIUS_KM = 300.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows: (unit, day, elem, value in tenths, qflag, ord)."""
    v = F.round(F.col("l_quantity") * 10).cast("int")
    return table(spark, d, "lineitem").select(
        F.floor(F.col("l_suppkey") / 10).alias("unit"), F.col("l_shipdate").cast("date").alias("day"),
        F.when(F.col("l_linestatus") == "O", "TMAX").otherwise("TMIN").alias("elem"),
        v.alias("value"), F.when(F.col("l_discount") >= 0.095, "X").otherwise("").alias("qflag"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1024 + v).alias("ord"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """QC'd (unit, day, tmax, tmin) in degC."""
    return qc.daily_panel(obs(spark, d))


def parts(spark: SparkSession, d: str, rows: int = 500_000) -> int:
    """How many tasks the observations are dealt to, so that none holds much more than `rows`: the session's number of
    partitions, or more on large tables. The count reads no column."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // rows))


def days(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """One QC'd value per unit and day, of either element: (unit, day, year, value); in `parts` tasks if given."""
    rows = qc.keep_unflagged(obs(spark, d))
    if parts:
        rows = rows.repartition(parts, "unit", "day")
    first = qc.first_wins(rows, ["unit", "day"], "ord", ["value"])
    return first.select("unit", "day", F.year("day").alias("year"), (F.col("value") / 10.0).alias("value"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """`days` limited to May-September, cut before the first row is chosen."""
    season = qc.in_months(qc.keep_unflagged(obs(spark, d)))
    first = qc.first_wins(season, ["unit", "day"], "ord", ["value"])
    return first.select("unit", "day", F.year("day").alias("year"), (F.col("value") / 10.0).alias("value"))


def station(spark: SparkSession, d: str) -> DataFrame:
    """Position and land flag of every unit: (unit, lat, lon, land)."""
    units = table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 10).alias("unit")).distinct()
    return units.select("unit", *_place("unit"), (F.col("unit") % 4 != 3).alias("land"))


def site(spark: SparkSession, d: str) -> DataFrame:
    """One station per supplier: (unit, lat, lon)."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), *_place("s_suppkey"))


def _place(key: str):
    k = F.col(key)
    return ((F.lit(25.0) + (k * 37 % 240) / 10.0).alias("lat"),
            (F.lit(-124.0) + (k * 53 % 580) / 10.0).alias("lon"))


def grid(spark: SparkSession) -> DataFrame:
    """Two-degree cells with a small-integer land rule."""
    land = (F.col("ilat") * 7 + F.col("ilon") * 3) % 5 != 0
    return GRID.cells(spark).withColumn("land", land)


def site_months(spark: SparkSession, d: str) -> DataFrame:
    """Mean quantity per supplier and month as station-month values with a position."""
    s = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month")).agg(F.avg("l_quantity").alias("value"))
    return s.select("unit", "year", "month", "value", *_place("unit"))


_RINGS = (
    (0, ((-120.0, 27.0), (-100.0, 25.5), (-80.0, 26.0), (-70.0, 35.0), (-69.0, 46.0),
         (-90.0, 49.0), (-118.0, 48.5), (-123.0, 38.0))),
    (1, ((-100.0, 36.0), (-100.0, 40.0), (-95.0, 40.0), (-95.0, 36.0))),
)


def polygon(spark: SparkSession) -> DataFrame:
    """A region with one hole as vertex rows (poly, ring, seq, lon, lat)."""
    rows = [(0, ring, i, x, y) for ring, pts in _RINGS for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "poly int, ring int, seq int, lon double, lat double")


def samples(spark: SparkSession, d: str, step: int = 3) -> DataFrame:
    """Sub-daily values (cell, lat, lon, hours, value): means of event values per slot."""
    e = table(spark, d, "events").select(
        F.floor(F.col("user_id") / 19).alias("cell"),
        (F.floor(epoch_hours_utc_clock(F.col("ts")) / step) * step).alias("hours"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    slots = e.groupBy("cell", "hours").agg(
        (F.sum("cents") / F.count("*") / 100.0).alias("value"))
    return slots.select("cell", (F.lit(25.0) + F.col("cell") % 25).alias("lat"),
                        (F.pmod(F.col("cell") * 45, F.lit(360)) - 177.5).alias("lon"), "hours", "value")


def month_series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means per unit as (series, year, value), year being a running month number."""
    m = days(spark, d).groupBy("unit", (
        (F.col("year") - YEARS[0]) * 12 + F.month("day")).alias("year")).agg(F.avg("value").alias("value"))
    return m.select(F.col("unit").alias("series"), "year", "value")


def offsets(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic monthly adjustments (unit, year, month, elem, offset in hundredths, flag)."""
    # a unit has a daily row in a month when any of its rows there passes quality control
    months = qc.keep_unflagged(obs(spark, d)).select(
        "unit", F.year("day").alias("year"), F.month("day").alias("month")).distinct()
    u, y, m = F.col("unit"), F.col("year"), F.col("month")
    rows = months.select("unit", "year", "month", F.explode(F.array(*[
        F.struct(F.lit(e).alias("elem"), F.lit(k).alias("k"))
        for k, e in enumerate(("tmax", "tmin", "tavg"))])).alias("s")).select("unit", "year", "month", "s.*")
    value = ((u * 7 + y * 3 + m * 11 + F.col("k")) % 21 - 10) * 10
    flag = F.when((u + y + m + F.col("k")) % 5 == 0, "E").otherwise(" ")
    return rows.select("unit", "year", "month", "elem", value.cast("int").alias("hundredths"),
                       flag.alias("flag"))


# ---- the same views in SQL ----------------------------------------------------



def _place_sql(k: str) -> str:
    return (f"CAST(25.0 + ({k} * 37 % 240) / 10.0 AS DOUBLE) AS lat, "
            f"CAST(-124.0 + ({k} * 53 % 580) / 10.0 AS DOUBLE) AS lon")


def _samples_sql(step: int) -> str:
    return f"""
 SELECT cell, CAST(25.0 + cell % 25 AS DOUBLE) AS lat,
        CAST((cell * 45) % 360 - 177.5 AS DOUBLE) AS lon, hours,
        CAST(sum(cents) AS DOUBLE) / count(*) / 100.0 AS value
 FROM (SELECT CAST(user_id // 19 AS BIGINT) AS cell,
              CAST(floor(floor(epoch(ts) / 3600) / {step}) * {step} AS BIGINT) AS hours,
              CAST(round(value * 100) AS BIGINT) AS cents FROM events)
 GROUP BY cell, hours"""


def _edges_sql() -> str:
    rows = []
    for _, pts in _RINGS:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            rows.append(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(x1, y1, x2, y2)"


# name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), """
 SELECT CAST(l_suppkey // 10 AS BIGINT) AS unit, CAST(l_shipdate AS DATE) AS day,
        CASE WHEN l_linestatus = 'O' THEN 'TMAX' ELSE 'TMIN' END AS elem,
        CAST(round(l_quantity * 10) AS INTEGER) AS value,
        CASE WHEN l_discount >= 0.095 THEN 'X' ELSE '' END AS qflag,
        (l_orderkey * 8 + l_linenumber) * 1024 + CAST(round(l_quantity * 10) AS BIGINT) AS ord
 FROM lineitem"""),
    "daily": (("obs",), """
 SELECT unit, day, CAST(arg_min(value, ord) FILTER (WHERE elem = 'TMAX') AS DOUBLE) / 10 AS tmax,
        CAST(arg_min(value, ord) FILTER (WHERE elem = 'TMIN') AS DOUBLE) / 10 AS tmin
 FROM obs WHERE qflag = '' GROUP BY unit, day"""),
    "days": (("obs",), """
 SELECT unit, day, CAST(year(day) AS INTEGER) AS year, CAST(arg_min(value, ord) AS DOUBLE) / 10 AS value
 FROM obs WHERE qflag = '' GROUP BY unit, day"""),
    "panel": (("days",), """
 SELECT unit, day, year, value,
        CAST(dayofyear(day) - CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0)
             THEN 121 ELSE 120 END AS INTEGER) AS doy
 FROM days WHERE month(day) BETWEEN 5 AND 9"""),
    "station": ((), f"""
 SELECT unit, {_place_sql('unit')}, unit % 4 <> 3 AS land
 FROM (SELECT DISTINCT CAST(s_suppkey // 10 AS BIGINT) AS unit FROM supplier)"""),
    "site": ((), f" SELECT s_suppkey AS unit, {_place_sql('s_suppkey')} FROM supplier"),
    "grid": ((), """
 SELECT i * 30 + j AS cell, i AS ilat, j AS ilon, CAST(25 + 2 * i AS DOUBLE) AS lat,
        CAST(-124 + 2 * j AS DOUBLE) AS lon, (i * 7 + j * 3) % 5 <> 0 AS land
 FROM range(13) a(i), range(30) b(j)"""),
    "site_months": ((), f"""
 SELECT unit, year, month, value, {_place_sql('unit')} FROM (
  SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month, avg(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""),
    "edges": ((), _edges_sql()),
    "samples": ((), _samples_sql(3)),
    "samples6": ((), _samples_sql(6)),
    "month_series": (("days",), """
 SELECT unit AS series, CAST((year - 1995) * 12 + month(day) AS INTEGER) AS year, avg(value) AS value
 FROM days GROUP BY ALL"""),
    "offsets": (("daily",), """
 SELECT unit, year, month, elem, CAST(((unit * 7 + year * 3 + month * 11 + k) % 21 - 10) * 10 AS INTEGER)
          AS hundredths,
        CASE WHEN (unit + year + month + k) % 5 = 0 THEN 'E' ELSE ' ' END AS flag
 FROM (SELECT DISTINCT unit, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month
       FROM daily), (VALUES ('tmax', 0), ('tmin', 1), ('tavg', 2)) e(elem, k)"""),
}


def with_views(uses: tuple[str, ...], body: str) -> str:
    """Prefix the SQL with the views it uses, in dependency order."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL_VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    if not order:
        return body
    ctes = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in order]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text
