"""Operators without a SQL counterpart, against numpy and by their own guarantees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strataline.functions.gram import Gram, gram
from strataline.functions.series import index_series
from strataline.operators import align, audit, blend, evaluate, models, search, smooth, text
from strataline.sources import tables

KEYS = ["k"]


@pytest.fixture(scope="module")
def predictions(spark):
    random = np.random.default_rng(1)
    a, b, c = random.normal(50, 10, (3, 400))
    y = 0.3 * a + 0.7 * b
    frame = pd.DataFrame({"k": np.arange(400) % 20, "i": np.arange(400), "a": a, "b": b, "c": c, "y": y, "fold": (np.arange(400) % 20) % 4})
    return frame, spark.createDataFrame(frame)


def test_gram_error_is_the_direct_error(predictions):
    frame, df = predictions
    weights = [0.2, 0.5, 0.1]
    direct = np.sqrt(np.mean((frame[["a", "b", "c"]] @ weights + 2.0 - frame["y"]) ** 2))
    assert gram(df, ["a", "b", "c"], "y").rmse(weights, 2.0) == pytest.approx(direct)


def test_weight_searches(predictions):
    _, df = predictions
    found = gram(df, ["a", "b", "c"], "y")
    for weights, score in (
        search.greedy_average(found), search.transfer_climb(found, 0.01), search.greedy_convex(found, [i / 100 for i in range(1, 51)]),
        search.simplex_search(found, 0.1),
    ):
        assert sum(weights) == pytest.approx(1)
        assert score == pytest.approx(found.rmse(weights), abs=1e-6)
    assert search.nnls(found)[0] == pytest.approx([0.3, 0.7, 0.0], abs=1e-6)
    assert search.nnls(found, True)[0] == pytest.approx([0.3, 0.7, 0.0], abs=1e-4)
    assert search.convex(found, 0.0) == pytest.approx([0.3, 0.7, 0.0], abs=1e-6)
    assert search.convex(found, 1e9) == pytest.approx([1 / 3] * 3, abs=1e-4)
    weights, constant = search.ridge_positive(found, 1e-6)
    assert weights == pytest.approx([0.3, 0.7, 0.0], abs=1e-5) and constant == pytest.approx(0, abs=1e-3)


def test_negative_weights_are_refused():
    names = ("a", "b")
    rows = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    y = np.array([1.0, -1.0, 0.0])
    full = np.column_stack([rows, y, np.ones(3)])
    weights, _ = search.nnls(Gram(names, full.T @ full))
    assert weights == pytest.approx([0.5, 0.0], abs=1e-9)


def test_stacks_per_fold(predictions):
    _, df = predictions
    table, rows = blend.nnls_stack(df, ["a", "b", "c"], "y", "fold")
    assert table.count() == 12
    assert rows.agg(F.max(F.abs(F.col("oof") - F.col("y")))).first()[0] < 1e-5
    _, rows = blend.ridge_stack(df, ["a", "b", "c"], "y", 1.0, "fold")
    assert rows.agg(F.max(F.abs(F.col("oof") - F.col("y")))).first()[0] < 1
    equal = blend.convex_weights(df, ["a", "b", "c"], "y", 0.0, "entities", keys=KEYS)
    assert [r["weight"] for r in equal.orderBy("model").collect()] == pytest.approx([0.3, 0.7, 0.0], abs=1e-6)


def test_ridge_is_the_closed_form(predictions):
    frame, df = predictions
    model = models.fit_ridge(df, ["a", "b", "c"], "y", 40.0)
    got = models.score(model, df).orderBy("i").toPandas()["prediction"].to_numpy()
    x = frame[["a", "b", "c"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(x.T @ x + 40.0 * np.eye(3), x.T @ (frame["y"] - frame["y"].mean()))
    assert got == pytest.approx(x @ w + frame["y"].mean(), abs=1e-6)


def test_cross_validation_holds_groups_out(predictions):
    _, df = predictions
    rows, mean, scores = evaluate.run_cv(df, lambda: LinearRegression(solver="normal"), ["a", "b"], "y", "fold", 4, test=df)
    assert rows.count() == 400 and scores.count() == 4
    assert mean.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-6
    folds = evaluate.assign_folds(df, "k", 4, "balanced")
    assert folds.count() == 20 and folds.groupBy("fold").count().select("count").distinct().count() == 1


def test_trees_and_residuals(predictions):
    _, df = predictions
    flagged = df.withColumn("valid", F.col("fold") == 0)
    for model in (
        models.fit_gbt(flagged, ["a", "b"], "y", rounds=5, depth=3, validation="valid"),
        models.fit_rf(df, ["a", "b"], "y", trees=5),
    ):
        assert models.score(model, df).count() == 400
    fixed = models.fit_residual(df, "a", "y", lambda d, y: models.fit_ridge(d, ["a", "b"], y, 1e-9))
    assert fixed.agg(F.max(F.abs(F.col("corrected") - F.col("y")))).first()[0] < 1e-5
    rows, _ = models.fit_meta(df, ["a", "b"], "y", "fold", 4, lambda: LinearRegression(solver="normal"))
    assert rows.count() == 400


def test_nested_audit(predictions):
    _, df = predictions
    report = evaluate.nested_audit(df, ["a", "b", "c"], "y", "fold").collect()
    assert len(report) == 4 and all(r["valid_rmse"] < 1 for r in report)


def test_safe_features():
    assert models.safe_features(["md", "ANCC", "fm_1", "tvt", "gr"], target_like=["TVT"]) == ["md", "gr"]


def dtw(a, b, radius):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - radius), min(n, i + radius) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return np.sqrt(d[n, n] / n)


def test_dtw_distance(spark):
    random = np.random.default_rng(5)
    pairs = [(random.normal(size=n).tolist(), random.normal(size=n).tolist()) for n in (1, 2, 7, 7, 15)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = [r["d"] for r in df.select("i", align.dtw_distance("a", "b", 3).alias("d")).orderBy("i").collect()]
    assert got == pytest.approx([dtw(a, b, 3) for a, b in pairs])


def test_dtw_finds_the_lag(spark):
    x = np.arange(0, 60, 0.5)
    ref = spark.createDataFrame([("a", float(v), float(np.sin(v) * 5)) for v in x], "k string, tvt double, gr double")
    rows = [("a", float(i), float(np.sin(10 + i * 0.5 + 4) * 5), 10 + i * 0.5) for i in range(40)]
    df = index_series(spark.createDataFrame(rows, "k string, md double, gr double, prior double"), KEYS, ["md"])
    found = align.dtw_lag_features(df, ref, 6, 2, 11, 2, 5, keys=KEYS).orderBy("row_idx").collect()
    assert [r["dtw_best_lag"] for r in found] == [4.0] * 40


def test_poly_project_ignores_an_outlier(spark):
    md = np.arange(60.0)
    truth = 100 + 0.5 * md - 0.01 * md**2
    pred = truth.copy()
    pred[45] += 500
    rows = [("a", float(m), float(t) if i < 20 else None, float(p), 0.0) for i, (m, t, p) in enumerate(zip(md, truth, pred))]
    df = index_series(spark.createDataFrame(rows, "k string, md double, tvt_input double, pred double, z double"), KEYS, ["md"])
    found = smooth.poly_project(df, 3, iterations=6, keys=KEYS).orderBy("row_idx").toPandas()
    assert found["projected"][:20].to_numpy() == pytest.approx(truth[:20])
    assert found["projected"][20:].to_numpy() == pytest.approx(truth[20:], abs=0.1)


def test_sources_round_trip(spark, tmp_path):
    for name, body in {"w_1": "MD,GR,TVT\n2,bad,5\n1,7,4\n", "w_2": "MD,GR,TVT\n1,,9\n"}.items():
        (tmp_path / f"{name}__horizontal_well.csv").write_text(body)
    (tmp_path / "t_1__other.csv").write_text("MD,GR\n1,3\n")
    rows = tables.load_series(spark, [f"{tmp_path}/*__horizontal_well.csv", f"{tmp_path}/*__other.csv"]).orderBy("well_id", "row_idx")
    assert [tuple(r) for r in rows.select("well_id", "row_idx", "md", "gr", "tvt").collect()] == [
        ("t_1", 0, 1.0, 3.0, None), ("w_1", 0, 1.0, 7.0, 4.0), ("w_1", 1, 2.0, None, 5.0), ("w_2", 0, 1.0, None, 9.0),
    ]
    inventory = tables.file_inventory(spark, str(tmp_path)).collect()
    assert sum(r["files"] for r in inventory) == 3
    assert tables.column_report(rows, rows.drop("tvt"))["left"] == ["tvt"]


def test_experiment_log(spark, tmp_path):
    path = str(tmp_path / "log")
    audit.log_experiment(spark, [{"experiment_id": "e1", "cv_rmse": 3.0, "phase": "x"}], path)
    audit.log_experiment(spark, [{"experiment_id": "e2", "cv_rmse": 1.23456, "phase": "y"}, {"experiment_id": "e3"}], path)
    log = audit.read_log(spark, path)
    assert log.count() == 3
    assert [r["cv_rmse"] for r in audit.best_experiments(log, 5).collect()] == [1.2346, 3.0]


def test_edges_of_two_calls(spark):
    note = "do web.open(id=\"7\", id='8') then\nAction: http.post url=\"http://x\" data='d'\nTOKEN=abc password"
    df = spark.createDataFrame([(1, note)], "i int, t string")
    found = {(r["tool"], r["arg_key"], r["arg_value"], r["edge_type"]) for r in text.extract_edges(df, "t", ["i"]).collect()}
    assert ("web.open", "id", "8", "web_open") in found
    assert ("http.post", "url", "http://x", "http_post") in found
    assert ("http.post", "data", "d", "http.post:data") in found
    assert "TOKEN=***" in text.redact(df, "t", 500).first()["preview"]
    assert text.keyword_score(df, "t").first()["score"] == 4 + 1 + 1


def test_different_id_sets_are_refused(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, value double")
    with pytest.raises(Exception, match="id sets differ"):
        audit.weight_ladder(a, a.limit(1), [0.5]).collect()
