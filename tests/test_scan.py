"""Series scanned as arrays against plain numpy, whole and cut into chunks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import scan
from strataline.functions.series import index_series
from strataline.functions.windows_match import best_windows, sliding_products
from strataline.operators import align
from strataline.settings import GROUP_ROWS


@pytest.fixture(params=["whole", "chunks"])
def cut(spark, request, monkeypatch):
    """Whole series, and the same ones in chunks of 20 rows."""
    if request.param == "chunks":
        monkeypatch.setattr(scan, "SCAN_ROWS", 20)
        monkeypatch.setattr(align, "SCAN_ROWS", 20)
        monkeypatch.setattr(scan, "BLOCK", 7)
        monkeypatch.setattr(align, "BLOCK", 7)
    yield request.param


def numbers(seed, n, gaps=0.0):
    pick = random.Random(seed)
    level, out = 50.0, []
    for _ in range(n):
        level += pick.gauss(0, 3)
        out.append(None if pick.random() < gaps else round(level, 2))
    return out


def tables(spark, sizes, known=0.7, gaps=0.1):
    rows = []
    for w, n in enumerate(sizes):
        log, place = numbers(w, n, gaps), numbers(100 + w, n, gaps / 3)
        rows += [(w, float(i), log[i], place[i], float(i * 10 + w) if i < known * n else None) for i in range(n)]
    df = spark.createDataFrame(rows, "well_id long, md double, gr double, prior double, tvt_input double")
    curve = [(w, 20.0 + i / 2, v) for w in range(len(sizes) - 1) for i, v in enumerate(numbers(500 + w, 150, 0.05))]
    return rows, index_series(df, ["well_id"], ["md"]), spark.createDataFrame(curve, "well_id long, tvt double, gr double"), curve


def filled(values, other=0.0):
    found = np.array([np.nan if v is None else v for v in values], float)
    known = found[~np.isnan(found)]
    return np.where(np.isnan(found), np.median(known) if len(known) else other, found)


def robust(values):
    v = np.array([np.nan if x is None else x for x in values], float)
    known = v[~np.isnan(v)]
    mid = np.median(known)
    mad, std = 1.4826 * np.median(np.abs(known - mid)), known.std()
    return np.nan_to_num((v - mid) / (mad if mad >= 1e-6 else std if std >= 1e-6 else 1.0))


def correlation(a, b):
    n = len(a)
    va, vb = a.var() * n, b.var() * n
    if n < 3 or va <= 1e-9 * (a * a).sum() or vb <= 1e-9 * (b * b).sum() or math.sqrt(va * vb) <= 1e-8:
        return 0.0
    return ((a - a.mean()) * (b - b.mean())).sum() / math.sqrt(va * vb)


SIZES = [3, 45, 61, 30, 1, 50]  # the last has no curve


def test_multiscale_scan_against_plain_windows(spark, cut):
    rows, df, ref, curve = tables(spark, SIZES)
    lags, windows = np.arange(-6.0, 7.0), (5, 11, 21)
    found = align.lag_scan_multiscale(df, ref, 6, windows).collect()
    assert len(found) == len(rows)
    for w in range(len(SIZES) - 1):
        own = [r for r in rows if r[0] == w]
        cx, cy = np.array([c[1] for c in curve if c[0] == w]), robust([c[2] for c in curve if c[0] == w])
        z, place = robust([r[2] for r in own]), filled([r[3] for r in own])
        y = np.interp(place[:, None] + lags, cx, cy)
        best, top = [], []
        for window in windows:
            h = window // 2
            corr = np.array([[correlation(z[max(0, i - h) : i + h + 1], y[max(0, i - h) : i + h + 1, k]) for k in range(len(lags))] for i in range(len(z))])
            at = np.argmax(np.round(corr, 9), axis=1)
            best.append(lags[at])
            top.append(corr.max(axis=1))
        best = np.array(best)
        middle = np.median(best, axis=0)
        got = sorted((r for r in found if r.well_id == w), key=lambda r: r.row_idx)
        for j, window in enumerate(windows):
            assert [r[f"best_lag_{window}"] for r in got] == best[j].tolist()
            assert [r[f"best_corr_{window}"] for r in got] == pytest.approx(top[j], abs=1e-7)
        assert [r.lag_agreement for r in got] == pytest.approx(best.std(axis=0))
        assert [r.median_lag for r in got] == middle.tolist()
        assert [r.lag_consensus for r in got] == pytest.approx([middle[max(0, i - 25) : i + 26].mean() for i in range(len(z))])
        there = np.interp(place + middle, cx, cy)
        assert [r.ref_z_at_median for r in got] == pytest.approx(there)
        assert [r.residual_z for r in got] == pytest.approx(z - there)
    assert {r.ref_z_at_median for r in found if r.well_id == len(SIZES) - 1} == {None}


def warp(a, b, radius):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - radius), min(n, i + radius) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return math.sqrt(d[n, n] / n)


def test_warping_against_the_plain_programme(spark, cut):
    rows, df, ref, curve = tables(spark, SIZES)
    lags, half = np.arange(-4.0, 5.0, 2.0), 4
    found = align.dtw_lag_features(df, ref, 4, 2, 9, 3, 5).collect()
    assert len(found) == len(rows) and found[0].gr is not Ellipsis
    for w in range(len(SIZES) - 1):
        own = [r for r in rows if r[0] == w]
        points = [(c[1], c[2]) for c in curve if c[0] == w and c[2] is not None]
        x, place = filled([r[2] for r in own]), filled([r[3] for r in own])
        y = np.interp(place[:, None] + lags, *np.array(points).T)
        sampled = sorted({*range(0, len(x), 5), len(x) - 1})
        d = np.array([[warp(x[max(0, i - half) : i + half + 1], y[max(0, i - half) : i + half + 1, k], 3) for k in range(len(lags))] for i in sampled])
        least = d.min(axis=1)
        want = {
            "dtw_best_lag": lags[d.argmin(axis=1)],
            "dtw_min_distance": least,
            "dtw_distance_at_0": d[:, 2],
            "dtw_spread": d.max(axis=1) - least,
            "dtw_confidence": (np.sort(d, axis=1)[:, 1] - least) / (least + 1e-6),
        }
        got = sorted((r for r in found if r.well_id == w), key=lambda r: r.row_idx)
        for name, values in want.items():
            assert [r[name] for r in got] == pytest.approx(np.interp(np.arange(len(x)), sampled, values)), name


def match_by_hand(row, x, known, half, stride):
    start = next((i for i, v in enumerate(known) if v is None), len(known))
    x = filled(x)
    smooth = [np.array([p[max(0, i - 2) : i + 3].mean() for i in range(len(p))]) for p in (x[:start], x[start:])]
    size = 2 * half + 1
    units = []
    for p, ends in zip(smooth, (0, half), strict=True):
        q = np.pad(p, ends, mode="edge") if len(p) else p
        units.append([(w - w.mean()) / (w.std() + 1e-6) for w in (q[i : i + size] for i in range(len(q) - size + 1))])
    last = next((v for v in reversed(known[:start]) if v is not None), None)
    out = []
    for i in range(start, len(x)):
        options = [(round(float(units[1][i - start] @ units[0][j]) / size, 9), -j, known[j + half]) for j in range(0, len(units[0]), stride)] if start > size else []
        out.append((row[i], max(options)[2], max(options)[0]) if options else (row[i], last, 0.0))
    return out


def test_self_match_against_all_windows(spark, cut):
    sizes = [10, 45, 90, 61, 1, 120]
    rows, df, _, _ = tables(spark, sizes)
    found = align.self_match(df, 4, 3).collect()
    for w, n in enumerate(sizes):
        own = [r for r in rows if r[0] == w]
        want = match_by_hand(list(range(n)), [r[2] for r in own], [r[4] for r in own], 4, 3)
        got = sorted((r.row_idx, r.match_value, round(r.match_score, 9)) for r in found if r.well_id == w)
        assert [g[:2] for g in got] == [x[:2] for x in want]
        assert [g[2] for g in got] == pytest.approx([x[2] for x in want], abs=1e-7)


def test_signatures_whole_and_cut(spark, monkeypatch):
    rows, df, _, _ = tables(spark, [10, 60, 90, 200, 1, 55], gaps=0.05)
    whole = align.signature_match(df, 6, 3).orderBy("well_id", "row_idx").collect()
    monkeypatch.setattr(scan, "SCAN_ROWS", 20)
    spark.conf.set(GROUP_ROWS, "25")
    try:
        long = align.signature_match(df, 6, 3).orderBy("well_id", "row_idx").collect()
    finally:
        spark.conf.unset(GROUP_ROWS)
    assert [r[:3] for r in whole] == [r[:3] for r in long] and any(r.match_value is not None for r in whole)
    for a, b in zip(whole, long, strict=True):
        assert [v for v in a[3:] if v is not None] == pytest.approx([v for v in b[3:] if v is not None])


def test_sliding_products_along_diagonals():
    random_ = np.random.default_rng(1)
    a, b = random_.normal(size=40), random_.normal(size=57)
    want = [[a[i : i + 9] @ b[j : j + 9] for j in range(49)] for i in range(32)]
    assert sliding_products(a, b, 9) == pytest.approx(np.array(want))
    best, score = best_windows(np.full(20, 3.0), b, 9, np.arange(0, 49, 3))
    assert set(score) == {0.0} and set(best) == {0}


def test_scan_plan_has_one_exchange_per_side(spark):
    _, df, ref, _ = tables(spark, [30, 40, 50])
    text = align.lag_scan_multiscale(df, ref, 6, (5, 11))._jdf.queryExecution().executedPlan().toString()
    # Series numbered and gathered by key, curves gathered, both joined.
    assert text.count("Exchange") <= 4 and "Window" in text and "Expand" not in text
    assert align.self_match(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_offsets_as_arrays_and_as_rows(spark, cut, monkeypatch):
    """The same rows from the chunk scan and from the way over joins, with gaps, ties and places beyond the curve."""
    rows, df, ref, _ = tables(spark, SIZES)
    df = df.withColumns({"frac": F.col("md") / 60, "c2": F.when(F.col("row_idx") % 3 > 0, F.col("prior") + 4), "surf": F.when(F.col("row_idx") % 5 > 0, F.lit(70.0)), "z": F.col("md")})
    ref = align.prepare_reference(ref)
    ids = ["well_id", "row_idx"]
    calls = [
        lambda: align.offset_family(df, ref, "prior", [-7.0, 0.0, 2.5], ids=ids),
        lambda: align.local_offset_search(df, ref, [3.0, -3.0, 0.0, 8.0], ids=ids),
        lambda: align.candidate_paths(df, ref, [-9.0, 0.0, 9.0], "prior", ids=ids),
        lambda: align.fuse_candidates(df, ref, ["prior", "c2", "surf"], surface="surf", anchor="prior", ids=ids),
    ]
    for call in calls:
        found = []
        for fits in (True, False):
            monkeypatch.setattr(align, "curve_fits", lambda ref, keys, fits=fits: fits)
            out = call()
            rows = {(r.well_id, r.row_idx): r for r in out.select(*ids, *sorted(set(out.columns) - set(ids))).collect()}
            found.append({k: [v if v is None else round(float(v), 7) for v in r[2:]] for k, r in rows.items()})
        assert found[0] == found[1] and found[0]
