"""Queries for scores, folds and diagnostics."""

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strataline.operators import evaluate, zones
from strataline.plans.fixtures import ID, KEYS, PREDICTIONS, SERIES, predictions, rounded, series, show, table
from strataline.plans.registry import query
from strataline.plans.zones import ANCHOR

SCORES = ["rmse", "mse", "mae", "bias"]
SCORE_SQL = """count(pred_a - value) AS rows, round(sqrt(avg(pow(pred_a - value, 2))), 6) + 0.0 AS rmse, round(avg(pow(pred_a - value, 2)), 5) + 0.0 AS mse,
  round(avg(abs(pred_a - value)), 6) + 0.0 AS mae, round(avg(pred_a - value), 6) + 0.0 AS bias"""


def scored(df, ids):
    return df.select(*ids, "rows", *[(F.round(c, 5 if c == "mse" else 6) + 0.0).alias(c) for c in SCORES])


@query("k01_metrics", f"WITH {PREDICTIONS} SELECT {SCORE_SQL} FROM p WHERE is_eval")
def metrics(spark, sf):
    tail = predictions(spark, sf).where(F.col("tvt_input").isNull())
    return scored(evaluate.metrics(tail, "value", "pred_a"), [])


@query("k02_metrics_by", f"WITH {PREDICTIONS} SELECT user_id, {SCORE_SQL} FROM p GROUP BY 1")
def metrics_by(spark, sf):
    return scored(evaluate.metrics_by(predictions(spark, sf), "value", "pred_a", KEYS), KEYS)


@query(
    "k03_entity_equal_rmse",
    f"""WITH {PREDICTIONS}, k AS (SELECT user_id, avg(pow(pred_a - value, 2)) AS m FROM p GROUP BY 1)
        SELECT count(*) AS entities, round(sqrt(avg(m)), 6) + 0.0 AS entity_equal_rmse FROM k""",
)
def entity_equal_rmse(spark, sf):
    return show(evaluate.entity_equal_rmse(predictions(spark, sf), "value", "pred_a", KEYS), ["entities"], ["entity_equal_rmse"])


REPORT = ["pooled_rmse", "mean_rmse", "median_rmse", "p90_rmse"]


@query(
    "k04_baseline_report",
    f"""WITH {SERIES}, {ANCHOR}, g AS (SELECT user_id, count(*) AS n, sum(pow(value - av, 2)) AS e FROM s JOIN k USING (user_id) WHERE is_eval GROUP BY 1),
        o AS (SELECT CAST(sum(n) AS BIGINT) AS rows, sqrt(sum(e) / sum(n)) AS pooled_rmse, avg(sqrt(e / n)) AS mean_rmse, quantile_cont(sqrt(e / n), 0.5) AS median_rmse, quantile_cont(sqrt(e / n), 0.9) AS p90_rmse FROM g)
        SELECT rows, {rounded(*REPORT)} FROM o""",
)
def baseline_report(spark, sf):
    return show(evaluate.baseline_report(series(spark, sf), "value", keys=KEYS), ["rows"], REPORT)


@query(
    "k05_assign_folds",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
        r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS a, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS b,
          row_number() OVER (ORDER BY md5(concat(user_id, '|7')), user_id) - 1 AS d FROM c)
        SELECT user_id, CAST(a % 5 AS INT) AS modulo, CAST(least(b % 10, 9 - b % 10) AS INT) AS balanced, CAST(d % 5 AS INT) AS shuffled FROM r""",
)
def assign_folds(spark, sf):
    events = table(spark, sf, "events").select("user_id")
    folds = [evaluate.assign_folds(events, "user_id", 5, m, 7, m) for m in ("modulo", "balanced", "shuffled")]
    return folds[0].join(folds[1], "user_id").join(folds[2], "user_id")


def folded(spark, sf):
    return predictions(spark, sf).withColumn("fold", (F.col("user_id") % 5).cast("int"))


@query("k06_run_cv")
def run_cv(spark, sf):
    """No SQL: model fits per fold."""
    rows, _, _ = evaluate.run_cv(folded(spark, sf), lambda: LinearRegression(solver="normal"), ["md", "z", "x", "y"], "value", "fold", 5)
    return show(rows, [*ID, "fold"], ["oof"], 4)


# The fits of a line on one column per fold, in closed form.
CV_LINE = f"""WITH {PREDICTIONS}, pf AS (SELECT *, CAST(user_id % 5 AS INT) AS fold FROM p),
        fits AS (SELECT f.fold, regr_slope(pf.value, pf.pred_c) AS b, regr_intercept(pf.value, pf.pred_c) AS a FROM pf JOIN (SELECT DISTINCT fold FROM pf) f ON pf.fold <> f.fold GROUP BY 1)"""


@query(
    "k06_cv_summary",
    f"""{CV_LINE}, e AS (SELECT fold, pow(a + b * pred_c - value, 2) AS q FROM pf JOIN fits USING (fold)),
        g AS (SELECT fold, count(*) AS n, sum(q) AS sse, sqrt(avg(q)) AS rmse FROM e GROUP BY 1)
        SELECT count(*) AS folds, CAST(sum(n) AS BIGINT) AS rows, round(sqrt(sum(sse) / sum(n)), 5) + 0.0 AS overall_rmse, round(avg(rmse), 5) + 0.0 AS mean_rmse, round(stddev_pop(rmse), 5) + 0.0 AS std_rmse FROM g""",
)
def cv_summary(spark, sf):
    rows, _, _ = evaluate.run_cv(folded(spark, sf), lambda: LinearRegression(solver="normal"), ["pred_c"], "value", "fold", 5)
    return show(evaluate.cv_summary(rows, "value", "fold"), ["folds", "rows"], ["overall_rmse", "mean_rmse", "std_rmse"], 5)


@query(
    "k06_cv_test_mean",
    f"""{CV_LINE}, m AS (SELECT avg(a) AS a, avg(b) AS b FROM fits) SELECT user_id, row_idx, round(a + b * pred_c, 5) + 0.0 AS prediction FROM p, m WHERE is_eval""",
)
def cv_test_mean(spark, sf):
    rows = folded(spark, sf)
    _, test, _ = evaluate.run_cv(rows, lambda: LinearRegression(solver="normal"), ["pred_c"], "value", "fold", 5, rows.where("tvt_input is null"))
    return show(test, ID, ["prediction"], 5)


@query(
    "k07_group_holdout",
    """WITH r AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, '|3')), user_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
        SELECT user_id, k <= least(greatest(1, round_even(n * 0.2::DOUBLE, 0)), n - 2) AS is_holdout FROM r""",
)
def group_holdout(spark, sf):
    return evaluate.group_holdout(table(spark, sf, "events"), "user_id", 0.2, 3)


EDGES = [0.0, 100.0, 250.0, 500.0, 800.0]
BINS = ["sse", "base_rmse", "pred_rmse", "gain"]


@query(
    "k08_binned_diagnostics",
    f"""WITH {PREDICTIONS}, b AS (SELECT *, CASE WHEN md < 0 OR md > 800 THEN NULL WHEN md <= 100 THEN 0 WHEN md <= 250 THEN 1 WHEN md <= 500 THEN 2 ELSE 3 END AS bin FROM p),
        o AS (SELECT bin, count(*) AS rows, sum(pow(value - pred_a, 2)) AS sse, sqrt(avg(pow(value - pred_c, 2))) AS base_rmse, sqrt(avg(pow(value - pred_a, 2))) AS pred_rmse FROM b WHERE bin IS NOT NULL GROUP BY 1)
        SELECT bin, rows, round(sse, 3) + 0.0 AS sse, round(base_rmse, 6) + 0.0 AS base_rmse, round(pred_rmse, 6) + 0.0 AS pred_rmse, round(base_rmse - pred_rmse, 6) + 0.0 AS gain FROM o""",
)
def binned_diagnostics(spark, sf):
    found = evaluate.binned_diagnostics(predictions(spark, sf), "md", EDGES, "value", "pred_c", "pred_a")
    return found.select("bin", "rows", *[(F.round(c, 3 if c == "sse" else 6) + 0.0).alias(c) for c in BINS])


GAIN = ["base_rmse", "pred_rmse", "delta_std", "delta_range", "gain"]


@query(
    "k09_entity_gain",
    f"""WITH {PREDICTIONS}, o AS (SELECT user_id, count(*) AS rows, sqrt(avg(pow(value - pred_c, 2))) AS base_rmse, sqrt(avg(pow(value - pred_a, 2))) AS pred_rmse,
          stddev_samp(value - pred_c) AS delta_std, max(value - pred_c) - min(value - pred_c) AS delta_range, base_rmse - pred_rmse AS gain FROM p WHERE is_eval GROUP BY 1)
        SELECT user_id, rows, {rounded(*GAIN, digits=5)} FROM o""",
)
def entity_gain(spark, sf):
    tail = predictions(spark, sf).where(F.col("tvt_input").isNull())
    return show(evaluate.entity_gain(tail, "value", "pred_c", "pred_a", KEYS), [*KEYS, "rows"], GAIN, 5)


@query(
    "k10_stage_report",
    f"""WITH {PREDICTIONS}, e AS (SELECT sqrt(avg(pow(value - pred_c, 2))) AS c, sqrt(avg(pow(value - pred_a, 2))) AS a, sqrt(avg(pow(value - pred_b, 2))) AS b, count(*) AS rows FROM p)
        SELECT position, stage, rows, round(CASE position WHEN 0 THEN c WHEN 1 THEN a ELSE b END, 6) + 0.0 AS rmse,
          round(c - CASE position WHEN 0 THEN c WHEN 1 THEN a ELSE b END, 6) + 0.0 AS gain FROM e, (VALUES (0, 'pred_c'), (1, 'pred_a'), (2, 'pred_b')) t(position, stage)""",
)
def stage_report(spark, sf):
    found = evaluate.stage_report(predictions(spark, sf), "value", ["pred_c", "pred_a", "pred_b"])
    return show(found, ["position", "stage", "rows"], ["rmse", "gain"])


@query(
    "k11_cv_gap",
    f"""WITH {PREDICTIONS}, g AS (SELECT user_id, sqrt(avg(pow(pred_a - value, 2)) FILTER (NOT is_eval)) AS cv, sqrt(avg(pow(pred_a - value, 2)) FILTER (is_eval)) AS lb FROM p GROUP BY 1),
        h AS (SELECT round(lb - cv, 3) AS d FROM g) SELECT count(*) AS rows, round(avg(d), 5) + 0.0 AS mean_gap, min(d) + 0.0 AS min_gap, max(d) + 0.0 AS max_gap FROM h""",
)
def cv_gap(spark, sf):
    rows = predictions(spark, sf)
    known, tail = rows.where(F.col("tvt_input").isNotNull()), rows.where(F.col("tvt_input").isNull())
    left = evaluate.metrics_by(known, "value", "pred_a", KEYS).select(*KEYS, F.col("rmse").alias("cv"))
    right = evaluate.metrics_by(tail, "value", "pred_a", KEYS).select(*KEYS, F.col("rmse").alias("lb"))
    return show(evaluate.cv_gap(left.join(right, KEYS), "cv", "lb"), ["rows"], ["mean_gap", "min_gap", "max_gap"], 5)


def mixed(spark, sf):
    """Three models none of which is exact, so that blends have something to gain."""
    wave = F.sin(F.col("row_idx").cast("double"))
    return folded(spark, sf).withColumns(
        {
            "m1": F.col("value") * 0.8 + wave * 10,
            "m2": F.col("value") * 1.1 - F.cos(F.col("row_idx").cast("double")) * 15 + 3,
            "m3": F.lit(40.0) + F.col("value") * 0.5 + F.sin(F.col("row_idx") / 3.0) * 8,
        }
    )


MIXED = PREDICTIONS + """,
mx AS (SELECT *, CAST(user_id % 5 AS INT) AS fold, value * 0.8::DOUBLE + sin(row_idx) * 10 AS m1, value * 1.1::DOUBLE - cos(row_idx) * 15 + 3 AS m2, 40.0::DOUBLE + value * 0.5::DOUBLE + sin(row_idx / 3.0::DOUBLE) * 8 AS m3 FROM p)"""


@query("k12_nested_audit")
def nested_audit(spark, sf):
    """No SQL: weight search per outer fold."""
    found = evaluate.nested_audit(mixed(spark, sf), ["m1", "m2", "m3"], "value", "fold")
    return show(found, ["fold", "chosen", "rows"], ["train_rmse", "valid_rmse"], 5)


# With two models the audit chooses between each of them and the greedy average, which starts with the better one.
def pair_rmse(a, b, t=""):
    return f"sqrt(greatest({a} * {a} * {t}aa + 2 * {a} * {b} * {t}ab + {b} * {b} * {t}bb - 2 * {a} * {t}ay - 2 * {b} * {t}byy + {t}yy, 0) / {t}n)"


PAIR_SUMS = {"aa": "m1 * m1", "ab": "m1 * m2", "bb": "m2 * m2", "ay": "m1 * value", "byy": "m2 * value", "yy": "value * value", "n": "1.0::DOUBLE"}


@query(
    "k12_audit_of_two",
    f"""WITH RECURSIVE {MIXED}, w AS (SELECT fold, {", ".join(f"sum({e}) AS v{c}" for c, e in PAIR_SUMS.items())} FROM mx GROUP BY 1),
        g AS (SELECT w.*, {", ".join(f"sum(v{c}) OVER () - v{c} AS {c}" for c in PAIR_SUMS)} FROM w),
        st AS (SELECT fold, {pair_rmse(1, 0)} <= {pair_rmse(0, 1)} AS first, CASE WHEN {pair_rmse(1, 0)} <= {pair_rmse(0, 1)} THEN 1.0::DOUBLE ELSE 0.0 END AS ca,
            CASE WHEN {pair_rmse(1, 0)} <= {pair_rmse(0, 1)} THEN 0.0::DOUBLE ELSE 1.0 END AS cb, least({pair_rmse(1, 0)}, {pair_rmse(0, 1)}) AS e FROM g
          UNION ALL
          SELECT fold, first, CASE WHEN ea < e - 1e-5 THEN ca + 1 ELSE ca END, CASE WHEN ea < e - 1e-5 THEN cb ELSE cb + 1 END, CASE WHEN ea < e - 1e-5 THEN ea ELSE eb END
          FROM (SELECT st.fold, first, ca, cb, e, {pair_rmse("((ca + 1) / (ca + cb + 1))", "(cb / (ca + cb + 1))")} AS ea, {pair_rmse("(ca / (ca + cb + 1))", "((cb + 1) / (ca + cb + 1))")} AS eb FROM st JOIN g USING (fold))
          WHERE least(ea, eb) < e - 1e-5),
        z AS (SELECT fold, first, arg_max(ca / (ca + cb), ca + cb) AS a, arg_max(cb / (ca + cb), ca + cb) AS b, arg_max(e, ca + cb) AS e, max(ca + cb) AS steps FROM st GROUP BY 1, 2)
        SELECT z.fold, CASE WHEN steps > 1 THEN 'greedy' WHEN first THEN 'single:m1' ELSE 'single:m2' END AS chosen, vn AS rows, round(e, 5) + 0.0 AS train_rmse,
          round({pair_rmse("a", "b", "v")}, 5) + 0.0 AS valid_rmse FROM z JOIN g USING (fold)""",
)
def audit_of_two(spark, sf):
    found = evaluate.nested_audit(mixed(spark, sf), ["m1", "m2"], "value", "fold")
    return show(found, ["fold", "chosen", "rows"], ["train_rmse", "valid_rmse"], 5)
