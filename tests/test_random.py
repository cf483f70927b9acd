"""Random inputs against plain NumPy calculations written out longhand."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from dayspell.functions.student import regularised_beta
from dayspell.operators import gridding, localday, series, spatial, spells, thresholds


def _line_fit(x, y, years, rw):
    n, out = len(x), np.full(len(x), np.nan)
    for i in range(n):
        lo = min(max(i - (years - 1) // 2, 0), n - years)
        xs, ys, r = x[lo:lo + years], y[lo:lo + years], rw[lo:lo + years]
        d = np.abs(xs - x[i])
        w = (1 - (d / d.max()) ** 3) ** 3 * r
        a = np.vstack([np.ones(years), xs - x[i]]).T * np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(a, ys * np.sqrt(w), rcond=None)[0][0]
    return out


@pytest.mark.parametrize("passes", [0, 3])
def test_lowess_with_holes(spark, passes):
    rng = np.random.default_rng(1)
    y = rng.gamma(2.0, 1.0, 126)
    years = np.arange(1900, 2026)
    keep = np.ones(126, bool)
    keep[40] = False
    keep[51] = False  # a run of ten between the holes
    want = np.full(126, np.nan)
    for run in np.split(np.flatnonzero(keep), np.flatnonzero(np.diff(np.flatnonzero(keep)) > 1) + 1):
        if len(run) < 17:
            continue
        rw = np.ones(len(run))
        for turn in range(passes + 1):
            fit = _line_fit(years[run].astype(float), y[run], 17, rw)
            res = np.abs(y[run] - fit)
            rw = (1 - np.minimum(res / (6 * np.median(res)), 1) ** 2) ** 2
        want[run] = fit
    df = spark.createDataFrame([("s", int(a), float(b) if k else None) for a, b, k in zip(years, y, keep)],
                               "series string, year int, value double")
    got = {r["year"]: r["smooth"] for r in rows(series.lowess(df, passes=passes))}
    assert set(got) == set(years[keep].tolist())
    for a, w in zip(years.tolist(), want):
        if a in got:
            assert (got[a] is None) == bool(np.isnan(w))
            if got[a] is not None:
                assert got[a] == pytest.approx(w, abs=1e-8)


def test_lowess_keeps_a_line(spark):
    df = spark.createDataFrame([("s", y, 0.5 * y) for y in range(1900, 1950)], "series string, year int, value double")
    assert all(abs(r["smooth"] - r["value"]) < 1e-8 for r in rows(series.lowess(df)))


def test_end_revision_matches_whole_copies(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=80)
    x = np.arange(80).astype(float)
    ones = np.ones(80)
    full = _line_fit(x, y, 17, ones)
    err = {lag: [] for lag in range(8)}
    for cut in range(33, 80 - 8):
        est = _line_fit(x[:cut + 1], y[:cut + 1], 17, ones[:cut + 1])
        for lag in err:
            err[lag].append(est[cut - lag] - full[cut - lag])
    df = spark.createDataFrame([("s", 1900 + i, float(v)) for i, v in enumerate(y)], "series string, year int, value double")
    got = {r["lag"]: r for r in rows(series.end_revision(df))}
    for lag, e in err.items():
        assert got[lag]["rmse"] == pytest.approx(math.sqrt(np.mean(np.square(e))), abs=1e-9)
        assert got[lag]["n_cuts"] == len(e)


def _panel(spark, seed, years, units, gap=0.1, step=10):
    rng = np.random.default_rng(seed)
    data = []
    for u in range(units):
        for y in years:
            for d in range(1, 154):
                if rng.random() > gap:
                    data.append((u, y, d, round(float(rng.normal(30, 5)) * step) / step))
    return spark.createDataFrame(data, "unit int, year int, doy int, value double"), data


@pytest.mark.parametrize("gates", [True, False])
def test_heatwave_counts(spark, gates):
    years = range(2000, 2012)
    df, data = _panel(spark, 3, years, 3, gap=0.28)
    rule = dict(percentile=70, half_window=3, min_pool=50, min_run=3)
    out = {(r["unit"], r["year"]): r["hw_days"] for r in rows(spells.heatwave_counts(df, need_thresholds=gates, **rule))}
    for u in range(3):
        cube = np.full((len(years), 153), np.nan)
        for uu, y, d, v in data:
            if uu == u:
                cube[y - 2000, d - 1] = v
        thr = np.full(153, np.nan)
        for d in range(153):
            pool = np.sort(cube[:, max(d - 3, 0):d + 4][np.isfinite(cube[:, max(d - 3, 0):d + 4])])
            if len(pool) >= 50:
                thr[d] = pool[min(int(len(pool) * 70 * 0.01), len(pool) - 1)]
        for k, y in enumerate(years):
            if np.isfinite(cube[k]).mean() < 0.7 or (gates and np.isfinite(thr).mean() < 0.7):
                assert out[(u, y)] is None
                continue
            hot = np.isfinite(cube[k]) & np.isfinite(thr) & (np.nan_to_num(cube[k]) >= thr)
            total = run = 0
            for h in [*hot, False]:
                if h:
                    run += 1
                else:
                    total += run if run >= 3 else 0
                    run = 0
            assert out[(u, y)] == total


def test_thresholds_cover_days_without_own_data(spark):
    # day 50 never has data of its own; its neighbours still give it a threshold
    data = [("u", y, d, float(y % 10 + d % 3)) for y in range(2000, 2040) for d in range(1, 154) if d != 50]
    df = spark.createDataFrame(data, "unit string, year int, doy int, value double")
    out = rows(thresholds.heat_thresholds(df), "doy")
    assert [r["doy"] for r in out] == list(range(1, 154))
    assert out[49]["n_pool"] == 240 and out[49]["threshold"] is not None


def test_exceedance_thresholds(spark):
    rng = np.random.default_rng(4)
    data = [(1, y, d, float(rng.normal())) for y in range(2000, 2010) for d in range(152, 245) if rng.random() > 0.2]
    df = spark.createDataFrame(data, "cell int, year int, doy int, value double")
    got = {r["doy"]: r["threshold"] for r in rows(thresholds.exceedance_thresholds(df))}
    arr = np.array([(d, v) for _, _, d, v in data])
    for d in range(152, 245):
        window = {(d - 15 + k) % 366 + 1 for k in range(31)}
        pool = arr[np.isin(arr[:, 0], list(window)), 1]
        assert got[d] == pytest.approx(np.percentile(pool, 95), abs=1e-9)


def test_exceedance_thresholds_wrap_round_the_year(spark):
    rng = np.random.default_rng(5)
    data = [(1, y, d, float(rng.normal())) for y in (2000, 2001) for d in range(1, 367 if y == 2000 else 366)]
    df = spark.createDataFrame(data, "cell int, year int, doy int, value double")
    got = {r["doy"]: r["threshold"] for r in rows(thresholds.exceedance_thresholds(df, months=range(1, 13)))}
    arr = np.array([(d, v) for _, _, d, v in data])
    assert sorted(got) == list(range(1, 367))
    for d in (1, 5, 15, 200, 350, 360, 366):
        window = {(d - 15 + k) % 366 + 1 for k in range(31)}
        assert got[d] == pytest.approx(np.percentile(arr[np.isin(arr[:, 0], list(window)), 1], 95), abs=1e-9)


@pytest.mark.parametrize("step", [3, 6])
def test_local_days(spark, step):
    rng = np.random.default_rng(6)
    lons = [-179.5, -122.5, -7.5, 22.5, 100.0, 179.0, 200.0]
    hours = np.arange(1000 * 24 - 24, 1000 * 24 + 240, step)
    cube = rng.normal(size=(len(lons), len(hours)))
    data = [(c, lons[c], int(h), float(cube[c, i])) for c in range(len(lons)) for i, h in enumerate(hours)]
    df = spark.createDataFrame(data, "cell int, lon double, hours long, value double")
    got = {(r["cell"], (r["day"] - __import__("datetime").date(1970, 1, 1)).days): r for r in rows(localday.local_days(df, step))}
    for c, lon in enumerate(lons):
        k = int(np.rint((((lon + 180) % 360) - 180) / 15))
        for day in range(999, 1011):
            inside = (hours >= 24 * day - k) & (hours < 24 * day - k + 24)
            r = got.get((c, day))
            if inside.sum() == 24 // step:
                v = cube[c, inside]
                assert (r["tmax"], r["tmin"]) == (v.max(), v.min()) and r["tmean"] == pytest.approx(v.mean())
            else:
                assert r is None or r["tmax"] is None


def _cells(spark, points):
    return spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(points)], "cell long, lat double, lon double")


def _stations(spark, points):
    return spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(points)], "unit long, lat double, lon double")


def _chord(a, b):
    def xyz(p):
        la, lo = np.radians(p[:, 0]), np.radians(p[:, 1])
        return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])

    return np.sqrt(((xyz(a)[:, None, :] - xyz(b)[None, :, :]) ** 2).sum(-1))


def test_near_pairs_everywhere_on_the_globe(spark):
    rng = np.random.default_rng(7)
    cells = np.column_stack([rng.uniform(-90, 90, 150), rng.uniform(-180, 360, 150)])
    cells[:6] = [[89.5, 10], [-89.9, -70], [0, 179.9], [10, -179.95], [45, 180], [60, 359.5]]
    st = np.column_stack([rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)])
    st[:6] = [[89, -170], [-89, 110], [0.5, -179.9], [10.5, 179.9], [44.5, -179.5], [60.2, -0.2]]
    got = {(r["cell"], r["unit"]) for r in rows(spatial.near_pairs(_cells(spark, cells), _stations(spark, st), 700.0))}
    close = _chord(cells, st) < 2 * math.sin(0.5 * 700.0 / 6371.0088)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(close))} and len(got) > 100


def test_radial_pairs_and_interpolation(spark):
    rng = np.random.default_rng(8)
    cells = np.array([(la, lo) for la in range(25, 50, 3) for lo in range(-124, -66, 4)], float)
    st = np.column_stack([rng.uniform(24, 50, 300), rng.uniform(-125, -66, 300)])
    st[0] = cells[0]
    r = np.radians
    dlo = r(st[None, :, 1] - cells[:, None, 1])
    c, s = r(cells[:, None, 0]), r(st[None, :, 0])
    x1 = (np.cos(c) * np.sin(dlo)) ** 2
    x2 = (np.cos(s) * np.sin(c) - np.sin(s) * np.cos(c) * np.cos(dlo)) ** 2
    d = 6335.44 * np.arctan(np.sqrt(x1 + x2) / (np.sin(s) * np.sin(c) + np.cos(s) * np.cos(c) * np.cos(dlo)))
    ok = (d >= 0) & (d < 115.0)
    pairs = spatial.radial_pairs(_cells(spark, cells), _stations(spark, st), 115.0)
    got = {(p["cell"], p["unit"]): p["km"] for p in rows(pairs)}
    assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(ok))}
    counts = rng.integers(0, 30, (300, 4)).astype(float)
    counts[rng.random(counts.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(u, 2000 + y, None if np.isnan(v) else float(v)) for u in range(300) for y, v in enumerate(counts[u])],
                               "unit long, year int, hw_days double")
    out = {(x["cell"], x["year"]): x["hw_days"] for x in rows(gridding.count_idw(df, pairs, 115.0))}
    w = np.where(ok, (115.0 / np.maximum(d, 1e-3)) ** 2, 0.0)
    for y in range(4):
        rep = np.isfinite(counts[:, y])
        dd, nst = w @ rep, ok @ rep.astype(int)
        num = w @ np.where(rep, counts[:, y], 0)
        for i in range(len(cells)):
            accepted = nst[i] >= 2 or (nst[i] == 1 and math.sqrt(dd[i]) > 1.5)
            assert ((i, 2000 + y) in out) == accepted
            if accepted:
                assert out[(i, 2000 + y)] == pytest.approx(num[i] / dd[i])


def test_k_nearest_follows_who_reports(spark):
    rng = np.random.default_rng(9)
    cells = np.array([(la, lo) for la in range(30, 40, 2) for lo in range(-110, -100, 2)], float)
    st = np.column_stack([rng.uniform(29, 41, 60), rng.uniform(-111, -99, 60)])
    vals = rng.normal(size=(60, 3))
    vals[rng.random(vals.shape) < 0.4] = np.nan
    pairs = spatial.near_pairs(_cells(spark, cells), _stations(spark, st), 300.0)
    df = spark.createDataFrame([(u, 2000, m + 1, None if np.isnan(v) else float(v)) for u in range(60) for m, v in enumerate(vals[u])],
                               "unit long, year int, month int, value double")
    out = {(r["cell"], r["month"]): r["value"] for r in rows(gridding.nearest_idw(df, pairs, k=4))}
    chord = _chord(cells, st)
    km = 2 * 6371.0088 * np.arcsin(chord / 2)
    for m in range(3):
        for i in range(len(cells)):
            cand = [j for j in np.argsort(km[i]) if km[i, j] < 300 and np.isfinite(vals[j, m])][:4]
            assert ((i, m + 1) in out) == bool(cand)
            if cand:
                w = km[i, cand] ** -2.0
                assert out[(i, m + 1)] == pytest.approx((w * vals[cand, m]).sum() / w.sum())


def _inside(poly_rings, lon, lat):
    inside = False
    for ring in poly_rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


RINGS = [[(-120.0, 27.3), (-104.2, 31.7), (-100.0, 25.5), (-80.0, 26.0), (-69.0, 46.0), (-90.0, 49.0), (-95.0, 41.0), (-118.0, 48.5)],
         [(-100.0, 36.0), (-100.0, 40.0), (-95.0, 40.0), (-95.0, 36.0)]]


def _polygon(spark):
    return spark.createDataFrame([(0, r, i, x, y) for r, ring in enumerate(RINGS) for i, (x, y) in enumerate(ring)],
                                 "poly int, ring int, seq int, lon double, lat double")


def test_points_in_a_concave_polygon_with_a_hole(spark):
    rng = np.random.default_rng(10)
    pts = np.column_stack([rng.uniform(24, 50, 500), rng.uniform(-125, -66, 500)])
    out = {r["unit"]: r["inside"] for r in rows(spatial.points_inside(_stations(spark, pts), spatial.polygon_edges(_polygon(spark))))}
    assert len(out) == 500
    assert all(out[i] == _inside(RINGS, o, a) for i, (a, o) in enumerate(pts))


def test_cell_fractions_of_a_concave_polygon(spark):
    grid = spatial.Grid(25.0, 2.0, 13, -124.0, 2.0, 30)
    got = {r["cell"]: r["fraction"] for r in rows(spatial.cell_fractions(spatial.polygon_edges(_polygon(spark)), grid))}

    def area(ring):
        return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2

    assert sum(got.values()) * 4 == pytest.approx(area(RINGS[0]) + area(RINGS[1]))  # the hole runs backwards
    n = 24
    for cell in (0, 34, 160, 195, 200, 255, 300, 345):
        la, lo = 25.0 + 2 * (cell // 30), -124.0 + 2 * (cell % 30)
        hits = sum(_inside(RINGS, lo - 1 + 2 * (i + 0.5) / n, la - 1 + 2 * (j + 0.5) / n) for i in range(n) for j in range(n))
        assert got.get(cell, 0.0) == pytest.approx(hits / n / n, abs=0.03)
    assert min(got.values()) > 0 and max(got.values()) <= 1 + 1e-9


def test_land_fraction_across_the_seam(spark):
    coarse = spark.createDataFrame([(float(a), float(o)) for a in (-3, 0, 3) for o in range(0, 360, 30)], "lat double, lon double")
    rng = np.random.default_rng(11)
    fine = [(float(a), float(o), bool(rng.random() > 0.5)) for a in range(-6, 7) for o in range(0, 360, 10)]
    got = {(r["lat"], r["lon"]): r["land_fraction"] for r in rows(
        spatial.land_fraction(coarse, spark.createDataFrame(fine, "lat double, lon double, land boolean")))}
    assert len(got) == 36
    for (la, lo), f in got.items():
        num = den = 0.0
        for a, o, land in fine:
            wy = max(0.0, min(la + 1.5, a + 0.5) - max(la - 1.5, a - 0.5))
            wx = sum(max(0.0, min(lo + 15, o + t + 5) - max(lo - 15, o + t - 5)) for t in (-720, -360, 0, 360))
            num, den = num + wy * wx * land, den + wy * wx
        assert f == pytest.approx(num / den, abs=1e-9)


def test_nearest_axis_and_carried_mask(spark):
    fine = spark.createDataFrame([(a / 4, o / 4) for a in range(100, 120) for o in range(-40, -20)], "lat double, lon double")
    coarse = [(float(a), float(o), (a + o) % 2 == 0) for a in range(25, 31) for o in range(-10, -4)]
    out = rows(spatial.carry_mask_nearest(fine, spark.createDataFrame(coarse, "lat double, lon double, land boolean")))
    assert len(out) == 400
    masks = {(a, o): m for a, o, m in coarse}
    for r in out:
        la = min(range(25, 31), key=lambda c: (abs(c - r["lat"]), c))
        lo = min(range(-10, -4), key=lambda c: (abs(c - r["lon"]), c))
        assert r["land"] == masks[(la, lo)]


def test_trends_and_p_values(spark):
    rng = np.random.default_rng(12)
    noise = rng.normal(size=60)
    y = np.zeros(60)
    for i in range(1, 60):
        y[i] = 0.5 * y[i - 1] + noise[i]
    y += 0.02 * np.arange(60)
    df = spark.createDataFrame([("s", 1960 + i, float(v)) for i, v in enumerate(y)] + [("t", 1960 + i, 1.0) for i in range(9)],
                               "series string, year int, value double")
    s, t = rows(series.trends(df), "series")
    assert t["n"] == 9 and t["trend"] is None and t["p_ols"] is None and t["p_ar1"] is None
    x = np.arange(60.0)
    slope = np.polyfit(x, y, 1)[0]
    res = y - np.polyval(np.polyfit(x, y, 1), x)
    sxx = ((x - x.mean()) ** 2).sum()
    se = math.sqrt((res ** 2).sum() / 58 / sxx)
    r1 = np.corrcoef(res[:-1], res[1:])[0, 1]
    n_eff = 60 * (1 - r1) / (1 + r1)
    assert s["trend"] == pytest.approx(slope * 100) and s["r1"] == pytest.approx(r1) and s["n_eff"] == pytest.approx(n_eff)

    def tail(tv, dof):  # integrate the density
        u = np.linspace(0, 1, 400001)[1:]
        z = tv / u  # maps (0, 1] to [t, inf)
        c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
        return 2 * np.trapezoid(c * (1 + z * z / dof) ** (-(dof + 1) / 2) * tv / u ** 2, u)

    assert s["p_ols"] == pytest.approx(tail(abs(slope / se), 58), abs=1e-6)
    adj = abs(slope / (se * math.sqrt(58 / (n_eff - 2))))
    assert s["p_ar1"] == pytest.approx(tail(adj, n_eff - 2), abs=1e-6)


def test_incomplete_beta_known_points():
    # I_x(1, 1) = x, I_x(2, 1) = x^2, I_1/2(a, a) = 1/2
    a, b, x = np.array([1.0, 2.0, 7.5, 0.5]), np.array([1.0, 1.0, 7.5, 0.5]), np.array([0.3, 0.3, 0.5, 0.5])
    assert regularised_beta(a, b, x) == pytest.approx([0.3, 0.09, 0.5, 0.5], abs=1e-12)


def test_run_fold_and_run_windows_agree(spark):
    df, _ = _panel(spark, 13, range(2000, 2004), 2, gap=0.2)
    hot = F.col("value") > 29
    folded = {(r["unit"], r["year"]): r["n"] for r in rows(
        df.groupBy("unit", "year").agg(spells.days_in_runs(F.collect_list(F.when(hot, F.col("doy"))), 4).alias("n")))}
    windowed = {(r["unit"], r["year"]): r["count"] for r in rows(spells.spell_days(df, hot, min_run=4).groupBy("unit", "year").count())}
    assert {k: v for k, v in folded.items() if v} == windowed
