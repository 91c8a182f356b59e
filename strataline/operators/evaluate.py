"""Scores, folds, cross-validation and diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.gram import Gram, gram_by
from strataline.functions.quantiles import overall
from strataline.functions.series import ROW, index_series
from strataline.operators.search import greedy_average, simplex_search
from strataline.settings import checkpoint
from strataline.operators.zones import last_known

WELL = ("well_id",)


def _scores(error: Column) -> list[Column]:
    return [
        F.count(error).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
    ]


def metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Rows, RMSE, MSE, MAE and bias over rows where both are known."""
    return df.agg(*_scores(F.col(pred) - F.col(y)))


def metrics_by(df: DataFrame, y: str, pred: str, keys: Sequence[str] = WELL) -> DataFrame:
    return df.groupBy(*keys).agg(*_scores(F.col(pred) - F.col(y)))


def entity_equal_rmse(df: DataFrame, y: str, pred: str, keys: Sequence[str] = WELL) -> DataFrame:
    """Root of the mean per-entity MSE: every entity counts the same."""
    per_key = metrics_by(df, y, pred, keys)
    return per_key.agg(F.count("mse").alias("entities"), F.sqrt(F.avg("mse")).alias("entity_equal_rmse"))


def baseline_report(
    df: DataFrame, target: str = "tvt", probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Error of holding the last known value over the tail: pooled, and spread over the entities."""
    anchored = last_known(df, {"_anchor": probe}, probe, keys, row).where(F.col(probe).isNull())
    per_key = metrics_by(anchored, target, "_anchor", keys)
    pooled = per_key.agg(
        F.sum("rows").alias("rows"),
        F.sqrt(F.sum(F.col("mse") * F.col("rows")) / F.sum("rows")).alias("pooled_rmse"),
        F.avg("rmse").alias("mean_rmse"),
    )
    return pooled.crossJoin(overall(per_key, {"median_rmse": ("rmse", 0.5), "p90_rmse": ("rmse", 0.9)}))  # one row each


def assign_folds(
    df: DataFrame, key: str, k: int, method: str = "balanced", seed: int = 0, out: str = "fold"
) -> DataFrame:
    """One fold per key. ``modulo``: key order; ``balanced``: largest first, to and fro; ``shuffled``: by a hash."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    order = {
        "modulo": [F.col(key)],
        "balanced": [F.desc("n"), F.col(key)],
        "shuffled": [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)],
    }[method]
    placed = index_series(sizes, [], order, "_place")
    turn = F.col("_place") % (2 * k)
    fold = F.least(turn, F.lit(2 * k - 1) - turn) if method == "balanced" else F.col("_place") % k
    return placed.select(key, fold.cast("int").alias(out))


def group_holdout(df: DataFrame, key: str, fraction: float, seed: int = 0, out: str = "is_holdout") -> DataFrame:
    """Flag a share of the keys, chosen by a hash: at least one, and at least two stay."""
    groups = df.select(key).distinct()
    count = groups.count()
    take = min(max(1, round(count * fraction)), max(count - 2, 0))
    order = [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    return index_series(groups, [], order, "_place").select(key, (F.col("_place") < take).alias(out))


def with_vectors(df: DataFrame, vectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add a vector column of each list of features; unknown values stay as NaN."""
    for out, features in vectors.items():
        df = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)
    return df


def run_cv(
    df: DataFrame,
    make: Callable[[], Estimator],
    features: Sequence[str],
    y: str,
    fold: str,
    folds: int,
    test: DataFrame | None = None,
    vector: str | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Out-of-fold predictions, mean test prediction, and scores per fold; ``cv_summary`` sums them up.

    One distributed fit per fold; what loops is the number of folds. ``vector`` names the features where a written step has
    them as one column already (``with_vectors``), so that several models read the same step.
    """
    column = vector or "_features"
    assembled = lambda rows: with_vectors(rows, {column: features})
    rows = df if vector else checkpoint(assembled(df))  # read by every fit and every score
    held, mean = [], None if test is None else assembled(test)
    for i in range(folds):
        model = make().setParams(featuresCol=column, labelCol=y, predictionCol="oof").fit(rows.where(F.col(fold) != i))
        held.append(model.transform(rows.where(F.col(fold) == i)))
        if mean is not None:
            mean = model.setPredictionCol(f"_p{i}").transform(mean)
    out = reduce(lambda a, b: a.unionByName(b), held).drop(column)
    if mean is not None:
        total = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(folds)])
        mean = mean.withColumn("prediction", total / float(folds)).drop(column, *[f"_p{i}" for i in range(folds)])
    return out, mean, metrics_by(out, y, "oof", [fold])


def cv_summary(rows: DataFrame, y: str, fold: str, pred: str = "oof") -> DataFrame:
    """One row: folds, rows, overall RMSE of the out-of-fold predictions, mean and population std of the folds' RMSE."""
    square = F.pow(F.col(pred) - F.col(y), 2)
    folds = rows.groupBy(fold).agg(F.count(square).alias("rows"), F.sum(square).alias("sse"), F.sqrt(F.avg(square)).alias("rmse"))
    return folds.agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("rows").alias("rows"),
        F.sqrt(F.sum("sse") / F.sum("rows")).alias("overall_rmse"),
        F.avg("rmse").alias("mean_rmse"),
        F.stddev_pop("rmse").alias("std_rmse"),
    )


def _bin(x: str, edges: Sequence[float]) -> Column:
    """Number of the bin (lower, upper] that holds x, the lowest edge included; NULL outside."""
    value = F.col(x)
    inside = F.when((value < edges[0]) | (value > edges[-1]), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        inside = inside.when(value <= upper, i)
    return inside


def binned_diagnostics(
    df: DataFrame, x: str, edges: Sequence[float], y: str, base: str, pred: str
) -> DataFrame:
    """Rows, RMSE of base and prediction, and gain per bin of x."""
    e0, e1 = F.col(y) - F.col(base), F.col(y) - F.col(pred)
    return (
        df.withColumn("bin", _bin(x, edges))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(e1 * e1).alias("sse"),
            F.sqrt(F.avg(e0 * e0)).alias("base_rmse"),
            F.sqrt(F.avg(e1 * e1)).alias("pred_rmse"),
        )
        .withColumn("gain", F.col("base_rmse") - F.col("pred_rmse"))
    )


def entity_gain(df: DataFrame, y: str, base: str, pred: str, keys: Sequence[str] = WELL) -> DataFrame:
    """RMSE of base and prediction per entity, gain, and spread of the target around the base."""
    e0, e1, delta = F.col(y) - F.col(base), F.col(y) - F.col(pred), F.col(y) - F.col(base)
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sqrt(F.avg(e0 * e0)).alias("base_rmse"),
            F.sqrt(F.avg(e1 * e1)).alias("pred_rmse"),
            F.stddev_samp(delta).alias("delta_std"),
            (F.max(delta) - F.min(delta)).alias("delta_range"),
        )
        .withColumn("gain", F.col("base_rmse") - F.col("pred_rmse"))
    )


def stage_report(df: DataFrame, y: str, stages: Sequence[str]) -> DataFrame:
    """RMSE after each stage and its gain over the first one, from one pass."""
    sums = df.agg(
        *[F.sum(F.pow(F.col(y) - F.col(s), 2)).alias(f"e{i}") for i, s in enumerate(stages)],
        *[F.count(F.col(y) - F.col(s)).alias(f"n{i}") for i, s in enumerate(stages)],
    )
    rmse = [F.sqrt(F.col(f"e{i}") / F.col(f"n{i}")) for i in range(len(stages))]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(f"n{i}").alias("rows"),
                rmse[i].alias("rmse"), (rmse[0] - rmse[i]).alias("gain"),
            )
            for i, s in enumerate(stages)
        ]
    )
    return sums.select(F.explode(rows).alias("_s")).select("_s.*")


def cv_gap(df: DataFrame, cv: str, board: str) -> DataFrame:
    """Mean, least and largest difference between two scores, rounded to three places per row."""
    gap = F.round(F.col(board) - F.col(cv), 3)
    return df.agg(
        F.count(gap).alias("rows"), F.avg(gap).alias("mean_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap")
    )


def choose_stack(gram: Gram) -> tuple[list[float], float, str]:
    """Best of: single model, simplex grid over the three best, greedy duplicate average."""
    singles = [gram.rmse(gram.single(i)) for i in range(len(gram.names))]
    best = min(range(len(singles)), key=singles.__getitem__)
    choices = [(singles[best], [float(v) for v in gram.single(best)], f"single:{gram.names[best]}")]
    if len(singles) >= 3:
        weights, score = simplex_search(gram, 0.05)
        choices.append((score, weights, "simplex"))
    weights, score = greedy_average(gram)
    choices.append((score, weights, "greedy"))
    score, weights, label = min(choices, key=lambda c: c[0])
    return weights, score, label


def nested_audit(df: DataFrame, cols: Sequence[str], y: str, fold: str) -> DataFrame:
    """Choose the stack without each fold, score it on that fold. One aggregate per table, then small matrices."""
    grams = gram_by(df, cols, y, fold)
    whole = reduce(lambda a, b: a + b, grams.values())
    rows = []
    for name, part in sorted(grams.items()):
        weights, train, label = choose_stack(whole - part)
        rows.append((int(name), label, float(part.rows), float(train), float(part.rmse(weights)), [float(w) for w in weights]))
    schema = "fold int, chosen string, rows double, train_rmse double, valid_rmse double, weights array<double>"
    return df.sparkSession.createDataFrame(rows, schema)
