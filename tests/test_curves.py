"""Curves that many series share: sent once to a task, looked up in parts, and scanned some lags at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import asof, scan
from strataline.functions.series import index_series
from strataline.operators import align

CURVE = [(float(i), float((i * 7) % 11)) for i in range(40)]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def series(spark, curves=(1,), n=60, rows=9):
    """Series of some rows each, dealt over the curves; places run past both ends of the curve."""
    table = [(k, curves[k % len(curves)], float(i), float((k * 5 + i * 3) % 50 - 4), float((k + i) % 13)) for k in range(n) for i in range(rows)]
    return index_series(spark.createDataFrame(table, "k long, c long, md double, place double, v double"), ["k"], ["md"])


def curves(spark, names=(1,)):
    return index_series(spark.createDataFrame([(c, x, y + c) for c in names for x, y in CURVE], "c long, x double, y double"), ["c"], ["x"])


def test_series_of_a_task_share_one_curve(spark, monkeypatch):
    """Of the series of one block none brings a copy of the curve."""
    monkeypatch.setattr(scan, "DEALS", 0)

    def reduce(block):
        return {"copies": np.full(len(block), len({id(p.curve_x) for p in block.parts}), float), "parts": np.full(len(block), len(block.parts), float)}

    found = scan.scan_chunks(
        series(spark), curves(spark), ["k"], ["c"], ("v", "place", "x", "y"), 0, reduce, "copies double, parts double", prepare=lambda part: None
    ).collect()
    assert len(found) == 540 and {r.copies for r in found} == {1.0} and max(r.parts for r in found) == 59


@pytest.mark.parametrize("batch", ["small", "large"])
def test_look_up_over_batches_and_without_curve(spark, request, batch):
    if batch == "small":
        request.getfixturevalue("small_batches")
    df = series(spark, (1, 2, 3, None))
    found = align.local_offset_search(df, curves(spark, (1, 2, 4)), [0.0], "place", "v", ref_x="x", ref_y="y", ids=["k", "row_idx"], keys=["c"])
    got = {(r.k, r.row_idx): r.best_ref for r in found.collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    xs, ys = np.array(CURVE).T
    for r in rows:
        inside = r.c in (1, 2) and 0 <= r.place <= 39
        want = pytest.approx(float(np.interp(r.place, xs, ys)) + r.c) if inside else None
        assert got[r.k, r.row_idx] == want


def test_best_shift_sums_in_the_scan(spark, monkeypatch):
    """No row per row and shift: misfits are summed where the series meets its curve."""

    def refuse(*_, **__):
        raise AssertionError("rows were multiplied by shifts")

    monkeypatch.setattr(align, "curve_at_offsets", refuse)
    df = series(spark, (1, 2, None), rows=30).withColumn("known", F.when(F.col("row_idx") < 24, F.col("place")))
    df = df.withColumn("v", F.when(F.col("row_idx") % 9 != 0, F.col("v")))
    shifts = [-2.0, 0.0, 1.5]
    found = align.best_shift(df, curves(spark, (1, 2)), shifts, (5, None), 3, "v", "known", "x", "y", keys=["k"], ref_keys=["c"])
    got = {r.k: r for r in found.collect()}
    xs, ys = np.array(CURVE).T
    rows = [r for r in df.collect() if r.known is not None and r.v is not None]
    for k in range(60):
        own = [r for r in rows if r.k == k]
        if own[0].c is None:
            assert (got[k].shift_all, got[k].misfit_all, got[k].confidence_5) == (0.0, 1e6, 0.0)
            continue
        for name, some in (("5", [r for r in own if 24 - r.row_idx <= 5]), ("all", own)):
            miss = [np.mean([(r.v - np.interp(r.known + s, xs, ys) - r.c) ** 2 for r in some]) for s in shifts]
            best = int(np.argmin(np.round(miss, 12)))
            assert got[k][f"misfit_{name}"] == pytest.approx(miss[best]) and got[k][f"shift_{name}"] == shifts[best]
            assert got[k][f"confidence_{name}"] == pytest.approx(1 - miss[best] / (np.mean(miss) + 1e-9))


def test_probes_of_one_key_are_dealt(spark, monkeypatch):
    """A thousand probes of one curve are sorted in several tasks, and each finds its place."""
    monkeypatch.setattr(asof, "SPREAD_ROWS", 100)
    probes = spark.range(1000).select(F.lit(1).cast("long").alias("c"), "id", (F.col("id") % 43 - 2.5).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = asof.interp_join(probes, curves(spark), ["c"], "p", "x", "y").select("id", "p", "ref_at", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 1000 and len({r.task for r in found}) > 1
    xs, ys = np.array(CURVE).T
    assert [r.ref_at for r in found] == pytest.approx([float(np.interp(r.p, xs, ys)) + 1 for r in found])


def test_correlations_do_not_depend_on_the_slices(monkeypatch):
    random = np.random.default_rng(1)
    xs, ys = np.array(CURVE).T
    parts = [(scan.Part(random.normal(5, 2, n), random.uniform(0, 39, n), xs, ys, 20.0, True, {}), np.arange(n), 0, n) for n in (30, 1, 45)]
    block = scan.Block(parts)
    values = block.curve_at(block.shifted(np.arange(-30, 31.0)))
    monkeypatch.setattr(scan, "LAGS", 7)
    sliced = scan.rolling_correlations(block, values, [5, 12], 1e-6)
    monkeypatch.setattr(scan, "LAGS", 1000)
    for a, b in zip(sliced, scan.rolling_correlations(block, values, [5, 12], 1e-6), strict=True):
        assert np.array_equal(a, b)
    want = [np.corrcoef(block.x[31:44], values[31:44, j])[0, 1] for j in range(61)]
    assert sliced[1][31] == pytest.approx(np.array(want), abs=1e-5) and np.all(sliced[0][30] == 0)


def test_a_series_without_curve_leaves_the_next_one_alone():
    random = np.random.default_rng(2)
    xs, ys = np.array(CURVE).T
    known = (scan.Part(random.normal(5, 2, 30), random.uniform(0, 39, 30), xs, ys, 20.0, True, {}), np.arange(30), 0, 30)
    none = (scan.Part(random.normal(5, 2, 20), np.full(20, np.nan), np.empty(0), np.empty(0), np.nan, True, {}), np.arange(20), 0, 20)
    shifts = np.arange(-10, 11.0)
    alone, after = scan.Block([known]), scan.Block([none, known])
    (want,) = scan.rolling_correlations(alone, alone.curve_at(alone.shifted(shifts)), [5], 1e-6)
    (got,) = scan.rolling_correlations(after, after.curve_at(after.shifted(shifts)), [5], 1e-6)
    assert np.all(got[:20] == 0) and np.abs(want).max() > 0.1
    assert got[20:] == pytest.approx(want, abs=1e-12)


def test_best_shift_of_a_curve_without_name(spark):
    """A series whose curve is unknown has the curve that has no name either, as the join of sorted rows had it."""
    df = series(spark, (None,), n=2, rows=20).withColumn("known", F.col("place"))
    found = align.best_shift(df, curves(spark).withColumn("c", F.lit(None).cast("long")), [0.0, 1.0], (None,), 3, "v", "known", "x", "y", keys=["k"], ref_keys=["c"])
    assert all(r.misfit_all < 1e6 for r in found.collect())
