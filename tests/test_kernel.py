"""LOWESS by kernel table against the point-by-point line, and end revisions against smoothing every copy."""

import math

import numpy as np
import pytest
from conftest import plan_text, rows

from dayspell.operators import series


def lowess_of(y, years):
    """Tricube-weighted local lines, solved one by one."""
    n, half, out = len(y), (years - 1) // 2, []
    for i in range(n):
        if n < years:
            out.append(None)
            continue
        low = min(max(i - half, 0), n - years)
        k = np.arange(low, low + years)
        r = np.abs(k - i) / max(i - low, low + years - 1 - i)
        w = np.where(r < 0.001, 1.0, np.where(r > 0.999, 0.0, (1 - r**3) ** 3))
        u, v = k - i, np.array(y)[k]
        a = np.array([[w.sum(), (w * u).sum()], [(w * u).sum(), (w * u * u).sum()]])
        b = np.array([(w * v).sum(), (w * u * v).sum()])
        out.append(float(np.linalg.solve(a, b)[0]) if np.linalg.det(a) > 1e-12 * w.sum() ** 2 else float((w * v).sum() / w.sum()))
    return out


@pytest.mark.parametrize("years", [3, 5, 17])
def test_smooths_equal_local_lines(spark, years):
    rng = np.random.default_rng(years)
    data = {"long": rng.normal(0, 3, 60).tolist(), "short": rng.normal(0, 3, years - 1).tolist(), "exact": rng.normal(5, 1, years).tolist()}
    frame = spark.createDataFrame([(k, 1900 + i, v) for k, ys in data.items() for i, v in enumerate(ys)]
                                  + [("long", 2000 + i, 1.0 + i) for i in range(20)], "series string, year int, value double")
    got = {(r["series"], r["year"]): r["smooth"] for r in rows(series.lowess(frame, years=years))}
    for name, ys in {**data, "tail": [1.0 + i for i in range(20)]}.items():
        start, key = (2000, "long") if name == "tail" else (1900, name)
        for i, want in enumerate(lowess_of(ys, years)):
            have = got[key, start + i]
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-9))


def test_a_straight_line_is_kept(spark):
    for row in series.lowess_kernel(17):
        assert sum(row) == pytest.approx(1.0, abs=1e-12)
    frame = spark.createDataFrame([("s", 1900 + i, 2.0 * i - 7) for i in range(30)], "series string, year int, value double")
    assert all(r["smooth"] == pytest.approx(r["value"], abs=1e-9) for r in rows(series.lowess(frame)))


@pytest.mark.parametrize("years, first_cut, lags", [(17, 33, 8), (5, 3, 6), (7, 2, 3), (5, 10, 1)])
def test_end_revisions_equal_smoothing_every_copy(spark, years, first_cut, lags):
    rng = np.random.default_rng(2)
    y, half = rng.normal(0, 2, 70).cumsum().tolist(), (years - 1) // 2
    full = lowess_of(y, years)
    want = {}
    for cut in range(first_cut, len(y) - half):
        part = lowess_of(y[: cut + 1], years)
        for lag in range(min(lags, cut + 1)):
            want.setdefault(lag, []).append(None if part[cut - lag] is None else part[cut - lag] - full[cut - lag])
    frame = spark.createDataFrame([("s", 1900 + i, v) for i, v in enumerate(y)], "series string, year int, value double")
    out = series.end_revision(frame, years=years, first_cut=first_cut, lags=lags)
    got = {r["lag"]: (r["rmse"], r["n_cuts"]) for r in rows(out)}
    assert got.keys() == want.keys()
    for lag, errors in want.items():
        known = [e for e in errors if e is not None]
        assert got[lag][1] == len(errors) and got[lag][0] == pytest.approx(math.sqrt(sum(e * e for e in known) / len(known)), abs=1e-9)
    text = plan_text(out)
    assert "Join" not in text  # no copies of the series beside the series
