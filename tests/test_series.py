"""Row frames, carried values, statistics and percentiles on hand-made series, short and cut into chunks."""

import pytest
from pyspark.sql import functions as F

from strataline.functions.asof import interp_join, nearest_join
from strataline.functions.nearest import candidates, nearest_points
from strataline.functions.quantiles import average_rank, key_percentiles, with_key_percentiles
from strataline.functions.series import (
    Frame,
    apply_frames,
    carried,
    index_series,
    longest,
    spread_join,
    with_key_stats,
)
from strataline.operators import align, gaps, layers, smooth, windows, zones

KEYS = ["k"]
A = [1.0, None, 3.0, None, None, 6.0, 7.0, None]


@pytest.fixture
def gappy(spark, any_length):
    rows = [("a", float(i), v) for i, v in enumerate(A)] + [("b", 0.0, None), ("b", 1.0, None), ("c", 0.0, 5.0)]
    return index_series(spark.createDataFrame(rows, "k string, md double, v double"), KEYS, ["md"])


def values(df, col, key="a", row="row_idx"):
    return [r[col] for r in df.where(F.col("k") == key).orderBy(row).select(col).collect()]


def test_positions_and_bound(gappy):
    assert values(gappy, "row_idx") == list(range(8))
    assert longest(gappy) == 8


def test_carried(gappy):
    found = carried(gappy, KEYS, last={"l": F.col("v")}, following={"f": F.col("v")}, sums={"s": F.col("v")})
    assert values(found, "l") == [1, 1, 3, 3, 3, 6, 7, 7]
    assert values(found, "f") == [1, 3, 3, 6, 6, 6, 7, None]
    assert values(found, "s") == [1, 1, 4, 4, 4, 10, 17, 17]
    assert values(found, "l", "b") == [None, None]


def test_two_stage_frames(gappy):
    one = Frame(1, 0, lambda r: {"p": F.lag("md", 1).over(r.order)})
    two = Frame(2, 2, lambda r: {"c": F.count("p").over(r(-2, 2)), "m": F.max("p").over(r(-2, 2))})
    found = apply_frames(gappy, KEYS, one, two)
    assert values(found, "p") == [None, 0, 1, 2, 3, 4, 5, 6]
    assert values(found, "c") == [2, 3, 4, 5, 5, 5, 4, 3]
    assert values(found, "m") == [1, 2, 3, 4, 5, 6, 6, 6]


def test_key_stats_and_percentiles(gappy):
    found = with_key_stats(gappy, KEYS, {"n": F.count("v"), "m": F.max("v")})
    assert values(found, "n") == [4] * 8 and values(found, "m", "c") == [5.0]
    found = with_key_percentiles(gappy, KEYS, {"med": ("v", 0.5), "q": ("v", 0.1)})
    assert values(found, "med") == [4.5] * 8
    assert values(found, "q") == pytest.approx([1.6] * 8)
    assert values(found, "med", "b") == [None, None]
    whole = key_percentiles(gappy, [], {"med": ("v", 0.5)}).first()[0]
    assert whole == 5.0


def test_average_rank_with_ties(spark, any_length):
    rows = [("a", i, v) for i, v in enumerate([5.0, 2.0, 2.0, None, 9.0, 2.0])]
    df = index_series(spark.createDataFrame(rows, "k string, i int, v double"), KEYS, ["i"])
    assert values(average_rank(df, KEYS, "v", "r"), "r") == pytest.approx([0.8, 0.4, 0.4, None, 1.0, 0.4])


def test_gap_filling(gappy):
    assert values(gaps.interpolate_gaps(gappy, "v", keys=KEYS), "filled") == [1, 2, 3, 4, 5, 6, 7, 7]
    assert values(gaps.interpolate_gaps(gappy, "v", fallback=-1.0, keys=KEYS), "filled", "b") == [-1, -1]
    assert values(gaps.ffill_bfill(gappy, "v", keys=KEYS), "filled") == [1, 1, 3, 3, 3, 6, 7, 7]
    weight = values(gaps.observation_weight(gappy, "v", keys=KEYS), "weight")
    assert weight[0] == 1 and weight[3] == pytest.approx(0.3 * 2.718281828459045 ** (-1 / 25))
    assert values(gaps.observation_weight(gappy, "v", keys=KEYS), "weight", "b") == [0, 0]
    assert values(gaps.robust_zscore(gappy, "v", keys=KEYS), "robust_z", "b") == [0, 0]
    z = [v for v in values(gaps.zscore(gappy, "v", keys=KEYS), "zscore") if v is not None]
    assert sum(z) == pytest.approx(0)


def test_zones_and_runs(gappy):
    info = {r["k"]: r for r in zones.zone_info(gappy, "v", keys=KEYS).collect()}
    assert (info["a"]["known_rows"], info["a"]["null_blocks"], info["a"]["first_eval"]) == (4, 3, 1)
    assert info["b"]["null_blocks"] == 1 and info["c"]["null_blocks"] == 0
    runs = {r["k"]: r["longest_all"] for r in zones.longest_null_run(gappy, "v", "v", keys=KEYS).collect()}
    assert runs == {"a": 2, "b": 2, "c": 0}


def test_rolling_windows(gappy):
    found = windows.rolling_stats(gappy, "md", [4], center=True, keys=KEYS)
    assert values(found, "mean_4") == [0.5, 1.0, 1.5, 2.5, 3.5, 4.5, 5.5, 6.0]
    assert values(found, "std_4", "c") == [0.0]
    slope = windows.rolling_slope(gappy, "md", "md", 3, keys=KEYS)
    assert values(slope, "slope") == pytest.approx([0] + [1] * 7)


def test_curve_lookup(spark, any_length):
    ref = spark.createDataFrame([("a", x, y) for x, y in [(0.0, 0.0), (1.0, 10.0), (3.0, 30.0), (4.0, 0.0), (6.0, 2.0)]], "k string, x double, y double")
    at = [-1.0, 0.0, 0.5, 1.0, 3.5, 6.0, 7.0, None]
    df = index_series(spark.createDataFrame([("a", i, v) for i, v in enumerate(at)], "k string, i int, p double"), KEYS, ["i"])
    clamp = interp_join(df, ref, KEYS, "p", "x", "y", "c")
    assert values(clamp, "c") == [0, 0, 5, 10, 15, 2, 2, None]
    inside = interp_join(df, ref, KEYS, "p", "x", "y", "c", "null")
    assert values(inside, "c") == [None, 0, 5, 10, 15, 2, None, None]
    near = nearest_join(df, ref, KEYS, "p", "x", {"n": "x"}, "lower")
    assert values(near, "n") == [0, 0, 0, 1, 3, 6, 6, None]
    near = nearest_join(df, ref, KEYS, "p", "x", {"n": "x"}, "upper")
    assert values(near, "n") == [0, 0, 1, 1, 4, 6, 6, None]


def test_label_runs(spark, any_length):
    ref = index_series(spark.createDataFrame([("a", float(i), g) for i, g in enumerate("AABBA")], "k string, tvt double, geology string"), KEYS, ["tvt"])
    runs = layers.label_runs(ref, keys=KEYS).orderBy("run_id").collect()
    assert [(r["label"], r["top"], r["bottom"], r["thickness"], r["rows"]) for r in runs] == [
        ("A", 0, 1, 2, 2), ("B", 2, 3, 2, 2), ("A", 4, 4, 1, 1),
    ]
    bounds = layers.label_boundaries(ref, keys=KEYS).orderBy("boundary").collect()
    assert [(b["boundary"], b["midpoint"]) for b in bounds] == [(2, 1.5), (4, 3.5)]


def test_slope_limit_follows_a_jump(spark, any_length):
    rows = [("a", float(i + 1), v) for i, v in enumerate([0.0, 10.0, 10.0, 10.0, 0.0, 0.0, 0.0, 20.0, -20.0, 3.0])]
    df = index_series(spark.createDataFrame(rows, "k string, md double, v double"), KEYS, ["md"])
    df = df.withColumns({"v0": F.lit(0.0), "m0": F.lit(0.0)})
    found = smooth.slope_limit(df, "v", 1.0, "v0", "m0", keys=KEYS)
    assert values(found, "limited") == [0, 1, 2, 3, 2, 1, 0, 1, 0, 1]


def test_savgol_keeps_a_cubic(spark, any_length):
    rows = [("a", float(i), float((i - 9) ** 3 - 4 * i + 2)) for i in range(21)]
    df = index_series(spark.createDataFrame(rows, "k string, md double, v double"), KEYS, ["md"])
    for window in (7, 11, 41):
        found = smooth.savgol(df, "v", window, 3, keys=KEYS)
        assert values(found, "smooth") == pytest.approx([r[2] for r in rows], abs=1e-6)


def test_spread_join_keeps_every_pair(spark, any_length):
    left = spark.range(20).select((F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k bigint, t string")
    assert spread_join(left, right, ["k"], ["id"]).count() == 30


def test_duplicate_reference_rows_are_averaged(spark, any_length):
    ref = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", 2.0, None), ("a", 3.0, 5.0)], "k string, tvt double, gr double")
    assert values(align.prepare_reference(ref, keys=KEYS), "gr") == [3, 4, 5]


def test_slope_limit_in_two_passes(spark, any_length, monkeypatch):
    """Steep steps, flat stretches and gaps: the sequential result, with one pass for the chunks' transfers and one to limit."""
    import random

    passes = []
    for name in ("_limit", "_transfers"):
        inner = getattr(smooth, name)
        monkeypatch.setattr(smooth, name, lambda *a, name=name, inner=inner: passes.append(name) or inner(*a))
    pick = random.Random(8)
    rows, want = [], {}
    for k in range(6):
        depth, value, last = 0.0, 5.0, 0.0
        for i in range(40):
            depth += pick.choice([0.5, 1.0, 4.0])
            v = None if pick.random() < 0.1 else pick.choice([0.0, 100.0, -100.0, float(i), pick.uniform(-9, 9)])
            rows.append((k, depth, v, 5.0, 0.0))
            if v is None:
                want[k, i] = None
                continue
            reach = 1.5 * max(abs(depth - last), 1e-6)
            value, last = min(max(v, value - reach), value + reach), depth
            want[k, i] = value
    df = index_series(spark.createDataFrame(rows, "k long, md double, v double, v0 double, m0 double"), ["k"], ["md"])
    found = {(r.k, r.row_idx): r.limited for r in smooth.slope_limit(df, "v", 1.5, "v0", "m0", keys=["k"]).collect()}
    assert {k for k, v in found.items() if v is None or v != v} == {k for k, v in want.items() if v is None}
    known = [k for k, v in want.items() if v is not None]
    assert [found[k] for k in known] == pytest.approx([want[k] for k in known])
    assert passes == (["_limit"] if any_length == "short" else ["_transfers", "_limit"])


@pytest.mark.parametrize("differ", [None, ("owner", "other")])
def test_nearest_points_against_all_pairs(spark, any_length, differ):
    import numpy as np

    random = np.random.default_rng(3)
    spots = np.concatenate([random.normal(0, 1, (60, 2)), random.normal(0, 0.001, (60, 2)), np.zeros((40, 2)), [[50.0, 50.0]]])
    owner = [int(i % 4) for i in range(len(spots))]
    points = spark.createDataFrame([(i, o, float(x), float(y)) for i, (o, (x, y)) in enumerate(zip(owner, spots))], "id int, other int, x double, y double")
    asked = spark.createDataFrame([(i, o, float(x), float(y)) for i, (o, (x, y)) in enumerate(zip(owner, spots)) if i % 8 == 0], "q int, owner int, x double, y double")
    found = nearest_points(asked, points, ["x", "y"], 5, ids=["q"], differ=differ, payload=["id"], tie="id").collect()
    for q in range(0, len(spots), 8):
        allowed = [i for i in range(len(spots)) if differ is None or owner[i] != owner[q]]
        distance = np.hypot(*(spots - spots[q]).T)
        want = sorted(allowed, key=lambda i: (distance[i], i))[:5]
        got = [r["id"] for r in sorted((r for r in found if r["q"] == q), key=lambda r: r["rank"])]
        assert [round(distance[i], 9) for i in got] == [round(distance[i], 9) for i in want]


def test_candidates_of_dense_series_grow_with_the_points(spark):
    """Ten straight, well separated series: four times the points are twice the pairs per probe, not four times."""

    def pairs(n):
        rows = spark.range(10 * n).select(
            (F.col("id") % 10).alias("w"), "id", (F.floor(F.col("id") / 10) / n).alias("x"), ((F.col("id") % 10) * 0.5).cast("double").alias("y")
        )
        other = rows.select(F.col("w").alias("o"), F.col("id").alias("p"), "x", "y")
        return candidates(rows, other, ["x", "y"], 5, ids=["id"], tie="p", differ=("w", "o"))[0].count()

    assert pairs(400) < 9 * pairs(100)


def test_candidates_in_five_dimensions(spark):
    def pairs(n):
        rows = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 10_000).alias(f"d{i}") for i in range(5)])
        return candidates(rows, rows.select(F.col("id").alias("p"), *[f"d{i}" for i in range(5)]), [f"d{i}" for i in range(5)], 3, ids=["id"], tie="p")[0].count() / n

    assert pairs(2000) < 2.5 * pairs(500)
