"""Several models over the same features read them from one written step."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import LinearRegression

from strataline.operators import evaluate
from strataline.plans.catalog import CATALOG


def test_the_pipeline_builds_its_features_once(spark, monkeypatch):
    plans, plain = [], evaluate.run_cv

    def seen(df, *args, **named):
        plans.append((df._jdf.queryExecution().optimizedPlan().toString(), named.get("vector")))
        return plain(df, *args, **named)

    monkeypatch.setattr(evaluate, "run_cv", seen)
    assert CATALOG["z03_pipeline"].plan(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 2
    assert all(vector and "Window" not in plan and "Join" not in plan for plan, vector in plans)


def test_written_rows_give_the_same_predictions(spark):
    rows = [(i, i % 3, float(i % 7), float(i * i % 11), 2.0 * (i % 7) - i * i % 11 + i % 2) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, 1.0, 1.0, 1.0)], "id long, fold int, a double, b double, y double")

    def found(rows, **named):
        out, mean, scores = evaluate.run_cv(rows, lambda: LinearRegression(solver="normal"), ["a", "b"], "y", "fold", 3, df, **named)
        return [{r.id: (r.fold, r.oof) for r in out.collect()}, {r.id: r.prediction for r in mean.collect()}, {r.fold: r.rmse for r in scores.collect()}]

    once, given = found(df), found(evaluate.with_vectors(df, {"both": ["a", "b"]}), vector="both")
    assert once[0].keys() == given[0].keys() == set(range(60))
    assert all(once[0][i] == (given[0][i][0], pytest.approx(given[0][i][1])) for i in once[0])
    assert once[1] == pytest.approx(given[1]) and once[2] == pytest.approx(given[2])
