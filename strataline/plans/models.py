"""Queries for model fits. No SQL counterpart except for the column arithmetic."""

from pyspark.sql import functions as F

from strataline.operators import models
from strataline.operators.blend import entity_features
from strataline.plans.evaluate import MIXED, mixed
from strataline.plans.fixtures import ID, KEYS, PREDICTIONS, predictions, series, show
from strataline.plans.registry import query
from strataline.settings import work_folder

FEATURES = ["md", "x", "y", "z", "m2", "m3"]


@query("m01_fit_gbt")
def fit_gbt(spark, sf):
    rows = mixed(spark, sf).withColumn("is_valid", F.col("fold") == 0)
    model = models.fit_gbt(rows, FEATURES, "value", validation="is_valid")
    return show(models.score(model, rows), ID, ["prediction"], 4)


@query("m02_fit_rf")
def fit_rf(spark, sf):
    wells = entity_features(series(spark, sf), ["value", "gr", "z", "md"], ["gr"], KEYS)
    model = models.fit_rf(wells, ["gr__mean", "gr__std", "z__mean", "md__mean"], "value__mean")
    return show(models.score(model, wells), KEYS, ["prediction"], 4)


@query("m03_fit_ridge")
def fit_ridge(spark, sf):
    rows = mixed(spark, sf)
    return show(models.score(models.fit_ridge(rows, FEATURES, "value", 10.0), rows), ID, ["prediction"], 4)


@query(
    "m03_ridge_one_column",
    f"""WITH {PREDICTIONS}, t AS (SELECT avg(md) AS mx, stddev_pop(md) AS sx, avg(value) AS my, count(*) AS cnt FROM p),
        w AS (SELECT sum((md - mx) / sx * value) / (max(cnt) + 10) AS slope FROM p, t)
        SELECT user_id, row_idx, round(my + slope * (md - mx) / sx, 4) + 0.0 AS prediction FROM p, t, w""",
)
def ridge_one_column(spark, sf):
    """A ridge line on one standardised column has a closed form."""
    rows = predictions(spark, sf)
    return show(models.score(models.fit_ridge(rows, ["md"], "value", 10.0), rows), ID, ["prediction"], 4)


@query("m01_weighted_importance")
def weighted_importance(spark, sf):
    """Known rows count ten times; the stored model is read back before its importances are listed."""
    rows = mixed(spark, sf).withColumn("w", F.when(F.col("tvt_input").isNull(), 1.0).otherwise(10.0))
    path = work_folder(spark, "model")
    models.save_model(models.fit_gbt(rows, FEATURES, "value", weight="w"), path)
    return show(models.feature_importance(models.load_model(path), FEATURES, spark), ["feature"], ["importance"])


@query("m04_fit_residual")
def fit_residual(spark, sf):
    rows = mixed(spark, sf)
    found = models.fit_residual(rows, "m1", "value", lambda d, y: models.fit_ridge(d, FEATURES, y, 10.0), 0.5)
    return show(found, ID, ["corrected"], 4)


@query(
    "m04_residual_one_column",
    f"""WITH {MIXED}, t AS (SELECT avg(md) AS mx0, stddev_pop(md) AS sx, avg(value - m1) AS my, count(*) AS cnt FROM mx),
        w AS (SELECT sum((md - mx0) / sx * (value - m1)) / (max(cnt) + 10) AS slope FROM mx, t)
        SELECT user_id, row_idx, round(m1 + 0.5 * (my + slope * (md - mx0) / sx), 4) + 0.0 AS corrected FROM mx, t, w""",
)
def residual_one_column(spark, sf):
    rows = mixed(spark, sf)
    found = models.fit_residual(rows, "m1", "value", lambda d, y: models.fit_ridge(d, ["md"], y, 10.0), 0.5)
    return show(found, ID, ["corrected"], 4)


@query("m05_fit_meta")
def fit_meta(spark, sf):
    rows, _ = models.fit_meta(mixed(spark, sf), ["m1", "m2", "m3"], "value", "fold", 5)
    return show(rows, [*ID, "fold"], ["oof"], 4)


@query(
    "m06_delta_target",
    f"WITH {PREDICTIONS} SELECT user_id, row_idx, round(value - pred_c, 6) + 0.0 AS delta, round(value, 6) + 0.0 AS back FROM p",
)
def delta_target(spark, sf):
    rows = models.delta_target(predictions(spark, sf), "value", "pred_c")
    return show(models.from_delta(rows, "delta", "pred_c", "back"), ID, ["delta", "back"])


@query(
    "m07_safe_features",
    f"WITH {PREDICTIONS} SELECT user_id, row_idx, md, round(z, 6) + 0.0 AS z FROM p",
)
def safe_features(spark, sf):
    """The table without train-only and target-like columns."""
    rows = predictions(spark, sf).select(*ID, "md", "z", "value", F.col("z").alias("ANCC"), F.col("x").alias("fm_x"))
    kept = models.safe_features(rows.columns, target_like=["value"])
    return rows.select(*kept).withColumn("z", F.round("z", 6) + 0.0)
