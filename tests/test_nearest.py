"""Nearest points by leaves: against all pairs, with many leaves, dense series, probes away from points or of unknown series."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.functions import nearest


@pytest.mark.parametrize(("dims", "differ"), [(1, ("owner", "other")), (2, None), (2, ("owner", "other")), (3, ("owner", "other"))])
def test_many_leaves_against_all_pairs(spark, monkeypatch, dims, differ):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 24)
    monkeypatch.setattr(nearest, "DISTANCES", 64)
    random = np.random.default_rng(5)
    spots = np.concatenate([random.normal(0, 1, (90, 3)), random.normal(3, 0.02, (50, 3)), np.zeros((20, 3)), np.round(random.normal(0, 1, (40, 3)))])
    line = np.column_stack([np.linspace(-4, 4, 120), np.full(120, 2.0), np.zeros(120)])
    spots = np.concatenate([spots, line])
    owner = [int(i % 4) for i in range(200)] + [7] * 120
    points = [(i, o, *map(float, p)) for i, (o, p) in enumerate(zip(owner, spots, strict=True))]
    away = np.concatenate([random.uniform(-6, 6, (30, 3)), spots[::5]])
    askers = [None if i % 7 == 0 else (7 if i % 7 == 1 else int(i % 4)) for i in range(30)] + owner[::5]
    asked = [(i, o, *map(float, p)) for i, (o, p) in enumerate(zip(askers, away, strict=True))]
    names = ["x", "y", "z"]
    axes = ", ".join(f"{c} double" for c in names)
    found = nearest.nearest_points(
        spark.createDataFrame(asked, f"q int, owner int, {axes}"), spark.createDataFrame(points, f"id int, other int, {axes}"),
        names[:dims], 5, ids=["q"], differ=differ, payload=["id"], tie="id",
    ).collect()
    got: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.q, r.rank)):
        got.setdefault(r.q, []).append((r.rank, r.id, round(r.distance, 9)))
    for q, o, *at in asked:
        distance = np.sqrt(((spots - np.array(at))[:, :dims] ** 2).sum(axis=1))
        allowed = [i for i in range(len(spots)) if differ is None or owner[i] != o]
        want = sorted(allowed, key=lambda i: (distance[i], i))[:5]
        assert got[q] == [(j + 1, i, round(float(distance[i]), 9)) for j, i in enumerate(want)], q


def test_fewer_points_than_asked_for(spark):
    points = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 2, 5.0, 0.0)], "id int, other long, x double, y double")
    asked = spark.createDataFrame([(0, 1, 1.0, 0.0), (1, 3, None, 0.0), (2, 9, 4.0, 0.0)], "q int, owner int, x double, y double")
    found = nearest.nearest_points(asked, points, ["x", "y"], 3, ids=["q"], differ=("owner", "other"), payload=["id"], tie="id")
    assert sorted((r.q, r["rank"], r.id) for r in found.collect()) == [(0, 1, 1), (2, 1, 1), (2, 2, 0)]
    assert nearest.nearest_points(asked, points.where("id > 9"), ["x", "y"], 3, ids=["q"], payload=["id"], tie="id").count() == 0


def test_leaves_receive_few_points_per_row(spark, monkeypatch):
    """What is sent to the probes is a few points per row, not a row for each pair of a probe and a point near it."""

    def counted(group, coords, k, ids, payload):
        def run(batches):
            for batch in batches:
                n = float((batch.column("_kind").to_numpy() == 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1], pa.int32()), pa.array([n]), pa.array([0])], names=["q", "rank", "distance", "p"])

        return run

    monkeypatch.setattr(nearest, "_best", counted)
    rows = spark.range(20_000).select(
        F.col("id").alias("q"), (F.col("id") % 5).alias("fold"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 100).alias(c) for i, c in enumerate("xy")]
    )
    points = rows.select(F.col("q").alias("p"), F.col("fold").alias("other"), "x", "y")
    found = nearest.nearest_points(rows, points, ["x", "y"], 30, ids=["q"], differ=("fold", "other"), payload=["p"], tie="p")
    assert 20_000 <= found.agg(F.sum("distance")).first()[0] <= 6 * 20_000


def test_probes_that_share_ids_are_one_probe(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id int, x double, y double")
    asked = spark.createDataFrame([(0, 0.0, 0.0), (0, 9.0, 0.0), (1, 4.0, 0.0)], "q int, x double, y double")
    found = nearest.nearest_points(asked, points, ["x", "y"], 3, ids=["q"], payload=["id"], tie="id").collect()
    assert sorted((r.q, r["rank"], r.id) for r in found) == [(0, 1, 0), (0, 2, 9), (0, 3, 1), (1, 1, 4), (1, 2, 3), (1, 3, 5)]
