"""Annual series: runs, LOWESS, outlier guards, period means, trends, revisions.

All series are long: (series, year, value). A series holds at most one row per
year, so windows over a series stay small however many series there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayspell.defaults import LOWESS_PASSES, LOWESS_YEARS, MAD_K, MAD_SCALE, PERIOD_MIN_YEARS, TAIL_Z
from dayspell.functions.student import t_two_sided
from dayspell.operators.guards import enforce


def unbroken_runs(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
                  value: str = "value") -> DataFrame:
    """Rows with a value and `run`, equal inside each stretch of consecutive years.

    A year that occurs twice fails the job: no run could hold it.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    held = series.filter(F.col(value).isNotNull()).withColumn("_step", F.col(x) - F.lag(x).over(w))
    held = enforce(held, F.coalesce(F.col("_step") > 0, F.lit(True)), f"{x} repeats within a series")
    return held.withColumn("run", (F.col(x) - F.row_number().over(w)).cast("int")).drop("_step")


# ---- LOWESS -----------------------------------------------------------------

def lowess_kernel(years: int) -> list[list[float]]:
    """Weights of a window's values by the place of the smoothed point in it.

    Inside an unbroken run the window's years are consecutive, so a local line
    without robustness weights is one fixed weighted sum, the same for every series.
    """
    rows = []
    for at in range(years):
        u = [float(k - at) for k in range(years)]
        reach = max(at, years - 1 - at)
        far = [abs(v) / reach for v in u]
        w = [1.0 if r < 0.001 else 0.0 if r > 0.999 else (1.0 - r**3) ** 3 for r in far]
        w0, w1, w2 = (sum(a * v**n for a, v in zip(w, u)) for n in (0, 1, 2))
        det = w0 * w2 - w1 * w1
        rows.append([a * (w2 - w1 * v) / det if det > 1e-12 * w0 * w0 else a / w0 for a, v in zip(w, u)])
    return rows


def _kernel_value(values: Column, place: Column, years: int) -> Column:
    """Smoothed value at `place` of a window's `years` values."""
    table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in lowess_kernel(years)])
    return F.aggregate(F.zip_with(values, F.get(table, place), lambda y, w: y * w), F.lit(0.0), lambda a, v: a + v)


def _local_line(df: DataFrame, points: str, at: str, out: str) -> DataFrame:
    """Add the value at `at` of a weighted straight line through the points (x, y, rw).

    Points are in order, so the farthest one is the first or the last. Weights
    are the tricube of distance over the farthest distance, times `rw`. One
    weighted point, or none, cannot carry a slope and falls back to the mean, or
    to NULL.
    """
    first, last = F.get(points, 0)["x"], F.element_at(points, -1)["x"]
    df = df.withColumn("_reach", F.greatest(F.col(at) - first, last - F.col(at)).cast("double"))

    def weigh(p: Column) -> Column:
        u = (p["x"] - F.col(at)).cast("double")
        r = F.abs(u) / F.col("_reach")
        core = F.lit(1.0) - r * r * r
        w = F.when(r < 0.001, F.lit(1.0)).when(r > 0.999, F.lit(0.0)).otherwise(core * core * core)
        return F.struct(u.alias("u"), p["y"].alias("y"), (w * p["rw"]).alias("w"))

    df = df.withColumn("_wts", F.transform(points, weigh))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "wu", "wuu", "wy", "wuy")])

    def add(s: Column, p: Column) -> Column:
        w, u, y = p["w"], p["u"], p["y"]
        return F.struct(
            (s["w"] + w).alias("w"), (s["wu"] + w * u).alias("wu"), (s["wuu"] + w * u * u).alias("wuu"),
            (s["wy"] + w * y).alias("wy"), (s["wuy"] + w * u * y).alias("wuy"))

    df = df.withColumn("_s", F.aggregate("_wts", zero, add))
    s = F.col("_s")
    det = s["w"] * s["wuu"] - s["wu"] * s["wu"]
    line = F.try_divide(s["wuu"] * s["wy"] - s["wu"] * s["wuy"], det)
    value = F.when(det > 1e-12 * s["w"] * s["w"], line).otherwise(F.try_divide(s["wy"], s["w"]))
    return df.withColumn(out, value).drop("_reach", "_wts", "_s")


def lowess(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
           value: str = "value", years: int = LOWESS_YEARS, passes: int = LOWESS_PASSES,
           smooth: str = "smooth", plain: str | None = None) -> DataFrame:
    """LOWESS of every unbroken run: rows with a value plus `smooth`.

    The window is the `years` nearest points and slides against the ends of the
    run; a run shorter than the window gets NULL. `passes` robustness passes
    reweigh by the bisquare of the residual over six median residuals; `plain`
    names a column for the smooth before them. The plain smooth is a fixed weighted
    sum per window place; only robustness passes fit lines point by point.
    """
    if years % 2 == 0:
        raise ValueError("the window must be odd")
    half = (years - 1) // 2
    runs = unbroken_runs(series, keys, x, value)
    part = [*keys, "run"]
    ordered = Window.partitionBy(*part).orderBy(x)
    whole = Window.partitionBy(*part)
    near = ordered.rowsBetween(-(years - 1), years - 1)
    df = runs.withColumn("_rw", F.lit(1.0))
    for turn in range(passes + 1):
        point = F.struct(F.col(x).alias("x"), F.col(value).cast("double").alias("y"), F.col("_rw").alias("rw"))
        df = (
            df.withColumn("_pts", F.collect_list(point).over(near))
            .withColumn("_pos", F.row_number().over(ordered) - 1)
            .withColumn("_size", F.count("*").over(whole).cast("int"))
        )
        low = F.least(F.greatest(F.col("_pos") - half, F.lit(0)), F.col("_size") - years)
        skip = low - F.greatest(F.col("_pos") - (years - 1), F.lit(0))
        df = df.withColumn("_pts", F.when(
            F.col("_size") >= years, F.slice("_pts", F.greatest(skip, F.lit(0)) + 1, F.lit(years))))
        if turn == 0 and years > 2:
            ys = F.transform("_pts", lambda p: p["y"])
            line = df.withColumn(smooth, F.when(F.col("_size") >= years, _kernel_value(ys, F.col("_pos") - low, years)))
        else:
            line = _local_line(df, "_pts", x, smooth)
        df = line.withColumn(smooth, F.when(
            F.col("_size") >= years, F.coalesce(F.col(smooth), F.col(value).cast("double"))))
        if turn == 0 and plain:
            df = df.withColumn(plain, F.col(smooth))
        if turn < passes:
            df = df.withColumn("_res", F.abs(F.col(value) - F.col(smooth)))
            df = df.withColumn("_med", F.median("_res").over(whole))
            scaled = F.when(
                F.col("_med") > 0, F.least(F.col("_res") / (F.col("_med") * 6.0), F.lit(1.0))
            ).otherwise(F.when(F.col("_res") > 0, 1.0).otherwise(0.0))
            bow = F.lit(1.0) - F.col("_u") * F.col("_u")
            df = df.withColumn("_u", scaled).withColumn("_rw", F.coalesce(bow * bow, F.lit(1.0)))
            df = df.drop("_res", "_med", "_u")
        df = df.drop("_pts", "_pos", "_size")
    return df.drop("_rw", "run")


def end_revision(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
                 value: str = "value", years: int = LOWESS_YEARS, first_cut: int = 33,
                 lags: int = 8, passes: int = LOWESS_PASSES) -> DataFrame:
    """RMSE by distance from the cut of truncated smooths against the full one.

    Every cut position from `first_cut` to half a window before the end ends a copy
    of the series. Without robustness passes the smooth at a lag is a weighted sum of
    the last values before the cut, so one frame over the series holds all copies'
    ends; with passes every copy is smoothed whole, and a series has a calendar's
    years at most, which bounds its copies. Lags count years, so a record with
    holes fails the job.
    """
    half = (years - 1) // 2
    if passes == 0 and years > 2:
        return _end_revision_by_kernel(series, keys, x, value, years, first_cut, lags)
    w = Window.partitionBy(*keys).orderBy(x)
    base = series.filter(F.col(value).isNotNull()).select(*keys, x, F.col(value).alias("_y"))
    base = base.withColumn("_step", F.col(x) - F.lag(x).over(w))
    base = enforce(base, F.coalesce(F.col("_step") == 1, F.lit(True)), f"{x} is not unbroken within a series").drop("_step")
    base = base.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*keys)).cast("int"))
    last = F.col("_n") - half - 1
    first = F.greatest(F.col("_i"), F.lit(first_cut))
    copies = base.filter(first <= last).withColumn("cut", F.explode(F.sequence(first, last)))
    kept = lowess(copies.select(*keys, "cut", x, "_i", F.col("_y").alias("_v")),
                  [*keys, "cut"], x, "_v", years, passes, "_est")
    tail = kept.withColumn("lag", F.col("cut") - F.col("_i")).filter(F.col("lag") < lags)
    full = lowess(base.select(*keys, x, F.col("_y").alias("_v")), keys, x, "_v", years, passes, "_full")
    joined = tail.select(*keys, x, "lag", "_est").join(full.select(*keys, x, "_full"), [*keys, x])
    err = F.col("_est") - F.col("_full")
    return joined.groupBy(*keys, "lag").agg(F.sqrt(F.avg(err * err)).alias("rmse"),
                                            F.count("*").alias("n_cuts"))


def _end_revision_by_kernel(series: DataFrame, keys: Sequence[str], x: str, value: str, years: int,
                            first_cut: int, lags: int) -> DataFrame:
    half = (years - 1) // 2
    w = Window.partitionBy(*keys).orderBy(x)
    base = series.filter(F.col(value).isNotNull()).select(*keys, x, F.col(value).cast("double").alias("_y"))
    base = base.withColumn("_step", F.col(x) - F.lag(x).over(w))
    base = enforce(base, F.coalesce(F.col("_step") == 1, F.lit(True)), f"{x} is not unbroken within a series").drop("_step")
    full = lowess(base, keys, x, "_y", years, 0, "_full")
    reach = years + lags
    frame = w.rowsBetween(-(reach - 1), 0)
    rows = full.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*keys)).cast("int")).withColumn(
        "_last", F.collect_list(F.struct(F.col("_y").alias("y"), F.coalesce(F.col("_full"), F.lit(float("nan"))).alias("f"))).over(frame))
    cuts = rows.filter((F.col("_i") >= first_cut) & (F.col("_i") <= F.col("_n") - half - 1))
    ends = cuts.withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(lags - 1), F.col("_i")))))
    at = F.col("_i") - F.col("lag")
    low = F.least(F.greatest(at - half, F.lit(0)), F.col("_i") + 1 - years)
    skip = low - (F.col("_i") + 1 - F.size("_last"))
    ys = F.transform(F.slice("_last", F.greatest(skip, F.lit(0)) + 1, F.lit(years)), lambda p: p["y"])
    est = F.when(F.col("_i") + 1 >= years, _kernel_value(ys, at - low, years))
    err = est - F.nanvl(F.element_at("_last", -1 - F.col("lag"))["f"], F.lit(None).cast("double"))
    return ends.groupBy(*keys, "lag").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count("*").alias("n_cuts"))


# ---- guards -------------------------------------------------------------------

def blank_outliers(series: DataFrame, keys: Sequence[str] = ("series",), value: str = "value",
                   k: float = MAD_K, mark: str | None = None) -> DataFrame:
    """NULL where |v - median| > k * 1.4826 * MAD of the series; nothing when MAD is 0."""
    w = Window.partitionBy(*keys)
    df = series.withColumn("_med", F.median(value).over(w))
    df = df.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    df = df.withColumn("_mad", F.median("_dev").over(w))
    bad = F.coalesce((F.col("_mad") > 0) & (F.col("_dev") > F.lit(k * MAD_SCALE) * F.col("_mad")),
                     F.lit(False))
    if mark:
        df = df.withColumn(mark, bad)
    return df.withColumn(value, F.when(~bad, F.col(value))).drop("_med", "_dev", "_mad")


def trim_tail(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
              value: str = "value", z: float = TAIL_Z, min_points: int = 15) -> DataFrame:
    """Test the last two values against the earlier history; NULL when z MADs away."""
    w = Window.partitionBy(*keys)
    has = F.col(value).isNotNull()
    newest = Window.partitionBy(*keys, "_has").orderBy(F.desc(x))
    df = series.withColumn("_has", has)
    df = df.withColumn("_r", F.row_number().over(newest))
    df = df.withColumn("_n", F.count(value).over(w))
    history = F.col("_has") & (F.col("_r") > 2)
    df = df.withColumn("_med", F.median(F.when(history, F.col(value))).over(w))
    df = df.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    df = df.withColumn("_mad", F.median(F.when(history, F.col("_dev"))).over(w))
    bad = F.coalesce(
        F.col("_has") & (F.col("_r") <= 2) & (F.col("_n") >= min_points) & (F.col("_mad") > 0)
        & (F.col("_dev") > F.lit(z * MAD_SCALE) * F.col("_mad")), F.lit(False))
    return df.withColumn(value, F.when(~bad, F.col(value))).drop(
        "_has", "_r", "_n", "_med", "_dev", "_mad")


def gate_coverage(series: DataFrame, value: str = "value", fraction: str = "fraction",
                  minimum: float = 0.5) -> DataFrame:
    return series.withColumn(value, F.when(F.col(fraction) >= minimum, F.col(value)))


# ---- summaries ----------------------------------------------------------------

def period_mean(value: str, first: int, last: int, x: str = "year", min_years: int = 1,
                strict: bool = False) -> Column:
    """Aggregate: mean over [first, last]; NULL below `min_years`, or unless complete."""
    v = F.when(F.col(x).between(first, last), F.col(value))
    need = last - first + 1 if strict else min_years
    return F.when(F.count(v) >= need, F.avg(v))


def single_year(value: str, year: int, x: str = "year") -> Column:
    return F.max(F.when(F.col(x) == year, F.col(value)))


def era_ratio(series: DataFrame, early: tuple[int, int], late: tuple[int, int],
              keys: Sequence[str] = ("series",), value: str = "value") -> DataFrame:
    out = series.groupBy(*keys).agg(period_mean(value, *early).alias("early"),
                                    period_mean(value, *late).alias("late"))
    return out.withColumn("ratio", F.try_divide(F.col("early"), F.col("late")))


def recent_mean(series: DataFrame, window: tuple[int, int], keys: Sequence[str] = ("series",),
                x: str = "year", value: str = "value", min_years: int = 5,
                fallback: int = 10) -> DataFrame:
    """Mean over `window` when it has `min_years` values, else over the last `fallback` values."""
    live = series.filter(F.col(value).isNotNull())
    newest = Window.partitionBy(*keys).orderBy(F.desc(x))
    live = live.withColumn("_r", F.row_number().over(newest))
    inside = F.when(F.col(x).between(*window), F.col(value))
    last = F.col("_r") <= fallback
    enough = F.count(inside) >= min_years
    return live.groupBy(*keys).agg(
        F.when(enough, F.avg(inside)).otherwise(F.avg(F.when(last, F.col(value)))).alias("recent"),
        F.when(enough, F.lit(window[0])).otherwise(F.min(F.when(last, F.col(x)))).alias("first_year"),
        F.when(enough, F.lit(window[1])).otherwise(F.max(x)).alias("last_year"))


def decade_means(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
                 values: Sequence[str] = ("value",)) -> DataFrame:
    """Mean of each value column by decade, for decades with any value."""
    decade = (F.floor(F.col(x) / 10) * 10).cast("int").alias("decade")
    live = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return series.filter(live).groupBy(*keys, decade).agg(*[F.avg(v).alias(v) for v in values])


def anomaly_rows(series: DataFrame, years: Sequence[int], old: tuple[int, int], modern: tuple[int, int],
                 keys: Sequence[str] = ("series",), value: str = "value", x: str = "year",
                 min_years: int = PERIOD_MIN_YEARS) -> DataFrame:
    """One summary row per series: single years, an old era, and the modern era up to
    the series' own last value."""
    w = Window.partitionBy(*keys)
    last = F.max(F.when(F.col(value).isNotNull(), F.col(x))).over(w)
    df = series.withColumn("_last", last).filter(F.col("_last").isNotNull())
    end = F.least(F.col("_last"), F.lit(modern[1]))
    v = F.when(F.col(x).between(modern[0], modern[1]) & (F.col(x) <= end), F.col(value))
    need = F.least(F.lit(min_years), F.min(end) - modern[0] + 1)
    return df.groupBy(*keys).agg(
        *[single_year(value, y, x).alias(f"y{y}") for y in years],
        period_mean(value, *old, x=x, min_years=min_years).alias("old_mean"),
        F.when((F.count(v) > 0) & (F.count(v) >= need), F.avg(v)).alias("modern_mean"),
        F.min(end).alias("modern_end"), F.min("_last").alias("last_year"),
        F.concat_ws("-", F.lit(modern[0]).cast("string"), F.min(end).cast("string")).alias("modern_window"))


def column_summary(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year",
                   value: str = "value", old: tuple[int, int] = (1930, 1939), last_n: int = 10) -> DataFrame:
    """Count, first and last year, old-era mean (if the series reaches back) and last-n mean."""
    live = series.filter(F.col(value).isNotNull())
    newest = Window.partitionBy(*keys).orderBy(F.desc(x))
    live = live.withColumn("_r", F.row_number().over(newest))
    return live.groupBy(*keys).agg(
        F.count("*").alias("n_years"), F.min(x).alias("first_year"), F.max(x).alias("last_year"),
        F.when(F.min(x) <= old[0], F.avg(F.when(F.col(x).between(*old), F.col(value)))).alias("old_mean"),
        F.avg(F.when(F.col("_r") <= last_n, F.col(value))).alias("last_mean"))


# ---- trends ---------------------------------------------------------------------

def trends(series: DataFrame, keys: Sequence[str] = ("series",), x: str = "year", value: str = "value",
           starts: Sequence[int] | None = None, last: int | None = None, min_points: int = 10,
           scale: float = 100.0) -> DataFrame:
    """Least-squares trend with plain and lag-1 corrected significance.

    One row per series and start year: n, slope * scale, se, p_ols, r1, n_eff,
    p_ar1. The residual correlation is clipped to [0, 0.99] before it shrinks the
    sample. Below `min_points` values everything but n is NULL.
    """
    df = series.filter(F.col(value).isNotNull())
    if last is not None:
        df = df.filter(F.col(x) <= last)
    if starts is not None:
        df = df.withColumn("start", F.explode(F.array(*[F.lit(s) for s in starts])))
        df = df.filter(F.col(x) >= F.col("start"))
        keys = [*keys, "start"]
    part = Window.partitionBy(*keys)
    ordered = part.orderBy(x)
    xs = F.col(x).cast("double")
    df = df.withColumn("_xm", F.avg(xs).over(part)).withColumn("_ym", F.avg(value).over(part))
    dx, dy = xs - F.col("_xm"), F.col(value) - F.col("_ym")
    df = df.withColumn("_sxx", F.sum(dx * dx).over(part)).withColumn("_sxy", F.sum(dx * dy).over(part))
    df = df.withColumn("_res", dy - F.try_divide(F.col("_sxy"), F.col("_sxx")) * dx)
    df = df.withColumn("_next", F.lead("_res").over(ordered))
    here = F.when(F.col("_next").isNotNull(), F.col("_res"))
    # the built-in corr fails in ANSI mode when one side is constant
    spread = F.stddev_pop(here) * F.stddev_pop("_next")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_sxx").alias("_sxx"), F.first("_sxy").alias("_sxy"),
        F.sum(F.col("_res") * F.col("_res")).alias("_rss"),
        F.try_divide(F.covar_pop(here, F.col("_next")), spread).alias("r1"))
    n = F.col("n")
    ok = n >= min_points
    slope = F.try_divide(F.col("_sxy"), F.col("_sxx"))
    se = F.sqrt(F.try_divide(F.col("_rss"), (n - 2) * F.col("_sxx")))
    out = out.withColumn("slope", F.when(ok, slope)).withColumn("se", F.when(ok, se))
    out = out.withColumn("r1", F.when(ok, F.col("r1")))
    r = F.least(F.greatest(F.coalesce(F.col("r1"), F.lit(0.0)), F.lit(0.0)), F.lit(0.99))
    out = out.withColumn("n_eff", F.when(ok, n * (1 - r) / (1 + r)))
    inflate = F.sqrt(F.when(F.col("n_eff") > 2.5, (n - 2) / (F.col("n_eff") - 2)))
    t_ols = F.abs(F.try_divide(F.col("slope"), F.col("se")))
    out = out.withColumn("p_ols", t_two_sided(t_ols, (n - 2).cast("double")))
    adjusted = t_two_sided(F.try_divide(t_ols, inflate), F.when(F.col("n_eff") > 2.5, F.col("n_eff") - 2))
    out = out.withColumn("p_ar1", F.when(ok & (F.col("n_eff") <= 2.5), 1.0).otherwise(adjusted))
    return out.select(*keys, "n", (F.col("slope") * scale).alias("trend"),
                      (F.col("se") * scale).alias("se"), "p_ols", "r1", "n_eff", "p_ar1")


def full_window_trend(series: DataFrame, first: int, last: int, keys: Sequence[str] = ("series",),
                      x: str = "year", value: str = "value", scale: float = 100.0) -> DataFrame:
    """Trend over [first, last] for series with a value in every year of it, else NULL."""
    inside = F.col(x).between(first, last) & F.col(value).isNotNull()
    n = F.count(F.when(inside, 1))
    slope = F.regr_slope(F.when(inside, F.col(value)), F.when(inside, F.col(x).cast("double")))
    return series.groupBy(*keys).agg(
        F.when(n == last - first + 1, slope * scale).alias("trend"))


def mean_pair(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("year",), value: str = "value") -> DataFrame:
    """0.5 * (A + B) over two series; NULL where either is missing."""
    both = a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    return both.select(*keys, (F.lit(0.5) * (F.col("_a") + F.col("_b"))).alias(value))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("year",), value: str = "value") -> DataFrame:
    both = a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys), "inner")
    return both.select(*keys, (F.col("_a") - F.col("_b")).alias(value))
