"""Unknown values, gapped numbering, tails, long curves and empty answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import gram as product_sums
from strataline.functions import scan
from strataline.functions.quantiles import add_overall
from strataline.functions.series import Frame, apply_frames, index_series
from strataline.operators import align, audit, blend, models, search, smooth, spatial, windows


def rows_of(spark, values, keys=1, schema="well_id long, md double, v double"):
    return index_series(spark.createDataFrame([(k, float(i), v) for k in range(keys) for i, v in enumerate(values)], schema), ["well_id"], ["md"])


def values(df, column):
    return [r[column] for r in df.orderBy("well_id", "row_idx").collect()]


def test_product_sums_skip_rows_with_unknown_terms(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (5.0, None), (None, 9.0)], "p double, y double")
    found = product_sums.gram(df, ["p"], "y")
    assert found.rows == 2 and found.rmse([1.0]) == pytest.approx(math.sqrt(2))
    grid = blend.weight_grid(df.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)}), "p", "a", "b", "y", [0.0], [0.0]).first()
    assert grid.rmse == pytest.approx(math.sqrt(2))
    faded = df.withColumns({"md_since": F.lit(0.0), "d": F.col("p")})
    assert blend.fit_alpha(faded, "y", "d", "md_since", [None]).first().rmse == pytest.approx(math.sqrt((3 - 1.4) ** 2 / 2 + (2 - 2.8) ** 2 / 2))


def test_many_folds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(product_sums, "MOST_FOLDS", 3)
    df = spark.createDataFrame([(1.0, 1.0, i) for i in range(4)], "p double, y double, f int")
    with pytest.raises(ValueError, match="more than 3"):
        product_sums.gram_by(df, ["p"], "y", "f")


def test_searches_go_on_until_nothing_gains(spark):
    pick = np.random.default_rng(0)
    y = pick.normal(size=400)
    df = spark.createDataFrame([(*map(float, [t + e for e in pick.normal(size=3) * 0.3]), float(t)) for t in y], "a double, b double, c double, y double")
    found = product_sums.gram(df, ["a", "b", "c"], "y")
    weights, best = search.greedy_average(found)
    counts = np.array(weights)
    assert found.rmse(weights) == pytest.approx(best) and counts.sum() == pytest.approx(1)
    assert search.single_errors(found).tolist() == pytest.approx([found.rmse(found.single(i)) for i in range(3)])
    with pytest.raises(ArithmeticError):
        search.projected_descent(found.xx, found.xy, search.non_negative, np.zeros(3), limit=1)


def test_one_row_tables_must_have_one_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert add_overall(df, spark.createDataFrame([(7,)], "b int")).count() == 2
    assert [r.b for r in add_overall(df, spark.createDataFrame([], "b int")).collect()] == [None, None]
    with pytest.raises(Exception, match="one row was expected"):
        add_overall(df, spark.createDataFrame([(7,), (8,)], "b int")).collect()


def test_frames_count_rows_not_numbers(spark, any_length):
    df = rows_of(spark, [float(i) for i in range(17)], keys=2).where((F.col("row_idx") % 5 != 2) & (F.col("row_idx") != 8))
    lag = Frame(2, 1, lambda rows: {"back": F.lag("v", 2).over(rows.order), "mean": F.avg("v").over(rows(-2, 1))})
    out = apply_frames(df, ["well_id"], lag).orderBy("well_id", "row_idx").collect()
    for well in range(2):
        own = [r for r in out if r.well_id == well]
        v = [r.v for r in own]
        assert [r.back for r in own] == [None, None, *v[:-2]]
        assert [r["mean"] for r in own] == pytest.approx([np.mean(v[max(0, i - 2) : i + 2]) for i in range(len(v))])


def test_neighbor_dip_does_not_depend_on_length(spark, any_length):
    rows = [(w, float(i), w * 10.0 + i, float(w), None if i in (3, 7) else i * i * 0.1 + w) for w in range(4) for i in range(12)]
    df = index_series(spark.createDataFrame(rows, "well_id long, md double, x double, y double, tvt double"), ["well_id"], ["md"])
    dips = {}
    for w in range(4):
        known = [(r[1], r[4]) for r in rows if r[0] == w and r[4] is not None]
        dips[w] = np.mean([(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(known, known[1:])])
    for r in spatial.neighbor_dip(df, k=3).collect():
        assert r.neighbor_dip == pytest.approx(np.mean([dips[w] for w in range(4) if w != r.well_id]))


def test_tails_are_smoothed_like_series(spark, any_length):
    line = [0.5 * i * i for i in range(40)]
    tail = rows_of(spark, line, keys=2).where("row_idx >= 19")
    for out in (smooth.savgol(tail, "v", 7, 2), smooth.median_cascade(tail, "v", 3, 7, 2), smooth.postprocess(tail, "v").withColumnRenamed("processed", "smooth")):
        found = values(out, "smooth")
        assert len(found) == 42 and None not in found
    assert values(smooth.savgol(tail, "v", 7, 2), "smooth") == pytest.approx(line[19:] * 2)
    again = rows_of(spark, line[19:], keys=2)
    assert values(smooth.kernel_smooth(tail, "v", "uniform", 6), "smooth") == pytest.approx(values(smooth.kernel_smooth(again, "v", "uniform", 6), "smooth"))


def test_unknown_values_stay_where_they_are(spark, any_length):
    level = [10.0] * 30
    level[14] = None
    df = rows_of(spark, level)
    for out, reach in (
        (smooth.kernel_smooth(df, "v", "gaussian", 1.0), 4),
        (smooth.kernel_smooth(df, "v", "uniform", 5), 2),
        (smooth.savgol(df, "v", 5, 2), 2),
        (smooth.median_cascade(df, "v", 5, pad="zero"), 2),
    ):
        found = values(out, "smooth")
        assert all(v is None for v in found[14 - reach : 15 + reach])
        rest = found[2 : 14 - reach] + found[15 + reach : 28]
        assert rest == pytest.approx([10.0] * len(rest))
    edge = values(smooth.savgol(rows_of(spark, [None, *level[:13]]), "v", 5, 2), "smooth")
    assert edge[0] is None and edge[-1] == pytest.approx(10.0)


def scan_by_hand(x, prior, cx, cy, lags, half):
    out = np.zeros((len(x), len(lags)))
    for k, lag in enumerate(lags):
        y = np.interp(prior + lag, cx, cy)
        for i in range(len(x)):
            a, b = x[max(0, i - half) : i + half + 1], y[max(0, i - half) : i + half + 1]
            va, vb = a.var() * len(a), b.var() * len(b)
            if len(a) >= 3 and va > 1e-9 * (a * a).sum() and vb > 1e-9 * (b * b).sum():
                out[i, k] = ((a - a.mean()) * (b - b.mean())).sum() / (math.sqrt(va * vb) + 1e-6)
    return out


@pytest.mark.parametrize("long_curves", [False, True])
def test_lag_scan_with_gaps(spark, long_curves, monkeypatch):
    """Six gaps in sixty rows: filled by the median, on both ways of scanning."""
    if long_curves:
        monkeypatch.setattr(align, "curve_fits", lambda ref, keys: False)
    monkeypatch.setattr(scan, "SCAN_ROWS", 25)
    pick = random.Random(3)
    cx = np.arange(0.0, 120.0)
    cy = np.array([math.sin(i / 5) * 20 + pick.random() for i in cx])
    prior = np.arange(30.0, 90.0)
    log = np.interp(prior + 2, cx, cy)
    gaps = {5, 6, 20, 33, 47, 58}
    rows = [(1, i, None if i == 40 else float(prior[i]), None if i in gaps else float(log[i])) for i in range(60)]
    df = index_series(spark.createDataFrame(rows, "well_id long, md long, prior double, gr double"), ["well_id"], ["md"])
    ref = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(cx, cy)], "well_id long, tvt double, gr double")
    ref = align.prepare_reference(ref)
    known = [r[3] for r in rows if r[3] is not None]
    x = np.array([np.median(known) if r[3] is None else r[3] for r in rows])
    p = np.array([np.median([r[2] for r in rows if r[2] is not None]) if r[2] is None else r[2] for r in rows])
    lags = np.arange(-4.0, 5.0)
    corr = scan_by_hand(x, p, cx, cy, lags, 5)
    best = np.argmax(np.round(corr, 9), axis=1)
    found = align.lag_scan(df, ref, 4, 11).orderBy("row_idx").collect()
    assert [r.best_lag for r in found] == lags[best].tolist()
    assert [r.best_corr for r in found] == pytest.approx(corr.max(axis=1), abs=1e-7)
    assert [r.peakiness for r in found] == pytest.approx((corr.max(axis=1) - np.median(corr, axis=1)) / (corr.std(axis=1) + 1e-6), rel=1e-5)
    multi = align.lag_scan_multiscale(df, ref, 4, windows=(5, 11)).orderBy("row_idx").collect()
    assert len(multi) == 60 and all(-4 <= r.median_lag <= 4 for r in multi)
    warped = align.dtw_lag_features(df, ref, 4, 2, 9, 3, 5).collect()
    assert len(warped) == 60 and all(r.dtw_min_distance is not None for r in warped)


@pytest.mark.parametrize("long_curves", [False, True])
def test_posterior_keeps_every_row(spark, long_curves, monkeypatch):
    if long_curves:
        monkeypatch.setattr(align, "curve_fits", lambda ref, keys: False)
    df = index_series(
        spark.createDataFrame([(1, 0.0, 500.0, 3.0), (1, 1.0, None, 3.0), (1, 2.0, 5.0, None), (2, 0.0, 1.0, 1.0), (1, 3.0, 2.0, 2.0)], "well_id long, md double, prior double, gr double"),
        ["well_id"], ["md"],
    )
    ref = spark.createDataFrame([(1, float(i), float(i % 7)) for i in range(10)], "well_id long, tvt double, gr double")
    found = {(r.well_id, r.row_idx): r for r in align.posterior_match(df, ref).collect()}
    assert len(found) == 5
    t, g = np.arange(10.0), np.arange(10) % 7
    power = -((g - 3.0) ** 2) / 128 - (t - 500.0) ** 2 / 1250
    w = np.exp(power - power.max())
    assert found[(1, 0)].posterior_position == pytest.approx((w * t).sum() / w.sum())
    assert [found[k].posterior_position for k in ((1, 1), (1, 2), (2, 0))] == [None] * 3


@pytest.mark.parametrize("long_curves", [False, True])
def test_distinct_labels_both_ways(spark, long_curves, monkeypatch):
    if long_curves:
        monkeypatch.setattr(windows, "curve_fits", lambda ref, keys: False)
    df = rows_of(spark, [0.0, 4.0, None, 9.5, 50.0])
    ref = spark.createDataFrame([(0, float(i), "abcab"[i % 5]) for i in range(11)], "well_id long, tvt double, geology string")
    found = windows.distinct_in_range(df, ref, 1.5, "v")
    want = [len({"abcab"[i % 5] for i in range(11) if abs(i - v) <= 1.5}) if v is not None else 0 for v in [0.0, 4.0, None, 9.5, 50.0]]
    assert values(found, "distinct_labels") == want


def test_fingerprints_differ_where_tables_do(spark):
    def mark(value):
        return audit.content_hash(spark.createDataFrame([(1, value), (2, 1.0)], "id long, v double"), "v").first().fingerprint

    marks = [mark(v) for v in (None, float("nan"), float("inf"), float("-inf"), 1e300, 5e299, 0.0, 0.5)]
    assert len(set(marks)) == len(marks)


def test_history_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 3.0), (3, None, None)], "id long, a double, b double")
    history = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("b", 0.25), ("zz", 9.0)], "model string, weight double")
    found = {r.id: r.blend for r in blend.blend_from_history(df, history, ["a", "b"], ["id"]).collect()}
    assert found == {1: 3.0, 2: 1.5, 3: None}
    none = blend.blend_from_history(df, history.where("model = 'zz'"), ["a", "b"], ["id"]).collect()
    assert len(none) == 3 and all(r.blend is None for r in none)


def test_row_neighbours_of_a_dense_series(spark):
    own = [(1, i, i * 0.01, 0.0, 1.0) for i in range(100)]
    far = [(2, 1000 + i, 50.0 + i, 0.0, 9.0) for i in range(3)]
    df = spark.createDataFrame(own + far, "well_id long, point long, x double, y double, s double")
    found = spatial.knn_rows(df, df, ["s"], 40, 20, ids=["point"], tie="point").collect()
    assert len(found) == 103 and all(r.neighbours == 20 for r in found)
    assert all(r.knn_s == pytest.approx(1.0) for r in found if r.point < 1000)


def test_elevation_keeps_rows_without_places(spark):
    rows = [(w, float(i), None if i == 9 else float(i + w), 0.0, 1.0, 5.0, None if i > 5 else 5.0, w % 2) for w in range(4) for i in range(12)]
    df = index_series(
        spark.createDataFrame(rows, "well_id long, md double, x double, y double, z double, tvt double, tvt_input double, fold int"), ["well_id"], ["md"]
    )
    found = spatial.spatial_elevation(df, "fold", 5, 3).collect()
    assert len(found) == 4 * 6
    assert {r.row_idx for r in found if r.spatial_raw is None} == {9}


def test_pairs_of_candidates_with_gaps(spark):
    rows = [(i, "a", float(i)) for i in range(5)] + [(i, "b", i + 1.0) for i in range(3)] + [(9, "c", 1.0)]
    found = {(r.left, r.right): r for r in audit.pairwise_distance(spark.createDataFrame(rows, "id long, name string, value double"), ["a", "b", "c"]).collect()}
    assert (found["a", "b"].rows, found["a", "b"].rmse, found["a", "b"].abs_sum) == (3, 1.0, 3.0)
    assert found["a", "c"].rows == 0 and found["a", "c"].rmse is None


def test_weights_and_stored_models(spark, tmp_path):
    rows = [(float(i % 10), 1.0 if i < 50 else 5.0, 1.0 if i < 50 else 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, y double, w double")
    model = models.fit_gbt(df, ["a"], "y", rounds=2, depth=2, weight="w")
    assert {round(r.prediction, 6) for r in models.score(model, df).collect()} == {1.0}
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert models.score(again, df).collect() == models.score(model, df).collect()
