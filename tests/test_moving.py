"""Moving statistics against plain windows, at any length of series and window."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from strataline.functions import moving, scan
from strataline.functions.series import index_series
from strataline.operators import align, smooth, windows


def values(seed, n, gaps=0.15):
    pick = random.Random(seed)
    return np.array([np.nan if pick.random() < gaps else 1e6 + pick.choice([pick.gauss(0, 3), 5.0, 5.0]) for _ in range(n)])


def plain(x, before, after, fn):
    out = []
    for i in range(len(x)):
        w = x[max(0, i - before) : i + after + 1]
        w = w[~np.isnan(w)]
        out.append(fn(w))
    return np.array(out, float)


@pytest.mark.parametrize(("before", "after"), [(0, 0), (4, 0), (3, 2), (20, 20), (1000, 1000)])
@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_moving_against_plain_windows(before, after, n):
    x = values(n + before, n)
    mean, std = moving.moving_moments(x, before, after)
    nothing = np.nan
    assert mean == pytest.approx(plain(x, before, after, lambda w: w.mean() if len(w) else nothing), nan_ok=True, rel=1e-14)
    assert std == pytest.approx(plain(x, before, after, lambda w: w.std(ddof=1) if len(w) > 1 else 0.0), rel=1e-6, abs=1e-9)
    if n:
        assert moving.moving_min(x, before, after) == pytest.approx(plain(x, before, after, lambda w: w.min() if len(w) else nothing), nan_ok=True)
    assert moving.moving_median(x, before, after) == pytest.approx(plain(x, before, after, lambda w: np.median(w) if len(w) else nothing), nan_ok=True)
    depth = np.cumsum(values(3, n, 0.0) - 1e6 + 4)
    want = []
    for i in range(n):
        part = slice(max(0, i - before), i + after + 1)
        ok = ~np.isnan(x[part])
        a, b = depth[part][ok], x[part][ok]
        want.append(np.polyfit(a - a.mean(), b - b.mean(), 1)[0] if len(a) >= 2 and np.ptp(a) > 0 else 0.0)
    assert moving.moving_slope(x, depth, before, after) == pytest.approx(np.array(want), rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("fn", [moving.moving_moments, moving.moving_min, moving.moving_median])
def test_time_does_not_depend_on_the_window(fn):
    x = values(1, 120_000)

    def seconds(half):
        start = time.process_time()
        fn(x, half, half)
        return time.process_time() - start

    seconds(5)
    wide = 500 if fn is moving.moving_median else 2500
    assert min(seconds(wide) for _ in range(2)) < 2 * max(min(seconds(25) for _ in range(2)), 0.01)


@pytest.fixture(params=["whole", "chunks"])
def table(spark, request, monkeypatch):
    if request.param == "chunks":
        monkeypatch.setattr(scan, "SCAN_ROWS", 40)
        monkeypatch.setattr(moving, "SCAN_ROWS", 40)
    series = {k: values(k, n) for k, n in enumerate((1, 90, 300))}
    rows = [(k, float(i), None if v != v else float(v), "kept") for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "well_id int, md double, v double, other string").repartition(3)
    return series, index_series(df, ["well_id"], ["md"])


def columns(found, names):
    rows = sorted(found.collect(), key=lambda r: (r.well_id, r.row_idx))
    assert all(r.other == "kept" for r in rows)
    return {n: np.array([np.nan if r[n] is None else r[n] for r in rows]) for n in names}


def test_wide_windows_of_series(table):
    series, df = table
    got = columns(windows.rolling_stats(df, "v", [101, 150], center=True), [f"{s}_{w}" for s in ("mean", "std", "min", "max") for w in (101, 150)])
    for w, (before, after) in {101: (50, 50), 150: (75, 74)}.items():
        for name, fn in {"mean": np.mean, "min": np.min, "max": np.max}.items():
            want = np.concatenate([plain(x, before, after, lambda v, fn=fn: fn(v) if len(v) else np.nan) for x in series.values()])
            assert got[f"{name}_{w}"] == pytest.approx(want, nan_ok=True)
    slopes = columns(windows.rolling_slope(df, "v", "md", 120), ["slope"])["slope"]
    narrow = columns(windows.apply_frames(df, ["well_id"], windows.slope_frame("v", "md", 120)), ["slope"])["slope"]
    assert slopes == pytest.approx(narrow, rel=1e-5, abs=1e-6)


def test_medians_of_series(table):
    series, df = table
    want = np.concatenate([plain(x, 5, 5, lambda v: np.median(v) if len(v) else np.nan) for x in series.values()])
    assert columns(windows.rolling_median(df, "v", 11), ["median"])["median"] == pytest.approx(want, nan_ok=True)
    assert columns(smooth.median_cascade(df, "v", 11), ["smooth"])["smooth"] == pytest.approx(want, nan_ok=True)
    found = columns(align.smooth_lag(df, "v", 50, 75), ["lag_mean_50", "lag_median_75"])
    assert found["lag_median_75"] == pytest.approx(np.concatenate([plain(x, 37, 37, lambda v: np.median(v) if len(v) else np.nan) for x in series.values()]), nan_ok=True)
    assert found["lag_mean_50"] == pytest.approx(np.concatenate([plain(x, 25, 24, lambda v: v.mean() if len(v) else np.nan) for x in series.values()]), nan_ok=True)
