"""Distributed model fits on feature columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators.evaluate import run_cv

# Columns that exist only in training tables, and their prefix.
TRAIN_ONLY = ("ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA")
TRAIN_ONLY_PREFIX = "fm_"


def safe_features(
    columns: Sequence[str], blocked: Sequence[str] = TRAIN_ONLY, prefixes: Sequence[str] = (TRAIN_ONLY_PREFIX,), target_like: Sequence[str] = ()
) -> list[str]:
    """Columns a model may use: no train-only column, no blocked prefix, nothing derived from the target."""
    names = {b.lower() for b in [*blocked, *target_like]}
    return [c for c in columns if c.lower() not in names and not c.startswith(tuple(prefixes))]


def delta_target(df: DataFrame, y: str, anchor: str, out: str = "delta") -> DataFrame:
    return df.withColumn(out, F.col(y) - F.col(anchor))


def from_delta(df: DataFrame, delta: str, anchor: str, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, F.col(delta) + F.col(anchor))


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def fit_gbt(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    *,
    rounds: int = 20,
    depth: int = 5,
    rate: float = 0.1,
    validation: str | None = None,
    weight: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees, rows weighted by a column if named; with a validation flag column they stop when its error stops falling."""
    trees = GBTRegressor(
        featuresCol="_features", labelCol=y, predictionCol="prediction", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed
    )
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[_assembled(features), trees]).fit(df)


def fit_rf(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    *,
    trees: int = 50,
    depth: int = 4,
    leaf: int = 5,
    weight: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Random forest, for entity-level features; rows weighted by a column if named."""
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol=y, predictionCol="prediction", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed
    )
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[_assembled(features), forest]).fit(df)


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted model in a folder every machine can reach."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a fitted tree model, the shares adding up to 1."""
    shares = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(s)) for f, s in zip(features, shares, strict=True)], "feature string, importance double")


def fit_ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float) -> PipelineModel:
    """Standardised features, squared error plus ``alpha`` times the squared weights.

    Features are scaled by their population deviation. Spark scales by the sample deviation, divides the
    squared error by the number of rows and works on the label over its deviation, hence the factors.
    """
    rows, spread = df.agg(F.count(y), F.stddev_pop(y)).first()
    scale = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    line = LinearRegression(
        featuresCol="_scaled", labelCol=y, predictionCol="prediction", regParam=alpha * max(rows - 1, 1) / max(rows, 1) ** 2 * (spread or 1.0),
        elasticNetParam=0.0, solver="normal", standardization=False,
    )
    return Pipeline(stages=[_assembled(features), scale, line]).fit(df)


def score(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    return model.transform(df).drop("_features", "_scaled").withColumnRenamed("prediction", out)


def fit_residual(
    df: DataFrame, base: str, y: str, fit: Callable[[DataFrame, str], PipelineModel], weight: float = 1.0, out: str = "corrected"
) -> DataFrame:
    """Model the error of a base prediction and add a share of it back."""
    rows = df.withColumn("_residual", F.col(y) - F.col(base))
    scored = score(fit(rows, "_residual"), rows, "_error")
    return scored.withColumn(out, F.col(base) + weight * F.col("_error")).drop("_residual", "_error")


def fit_meta(
    df: DataFrame, cols: Sequence[str], y: str, fold: str, folds: int, make: Callable[[], Estimator] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Second-level model on out-of-fold columns, itself scored out of fold."""
    chosen = make or (lambda: GBTRegressor(maxIter=10, maxDepth=3, stepSize=0.1, seed=42))
    rows, _, scores = run_cv(df, chosen, cols, y, fold, folds)
    return rows, scores
