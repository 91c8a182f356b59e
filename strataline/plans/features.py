"""Queries for feature sets and the way from raw series to a submission."""

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strataline.functions.gram import gram
from strataline.operators import align, blend, evaluate, features, search, smooth
from strataline.plans.fixtures import ID, KEYS, REF_KEYS, SERIES, reference, rounded, series, show
from strataline.plans.align import MULTI, REF, SCAN, curves
from strataline.plans.registry import CATALOG, query
from strataline.settings import checkpoint
from strataline.sources.tables import make_row_id

WIDE = [
    "depth_from_start", "depth_fraction", "gr_filled", "tvt_input_filled", "x_step_1", "y_step_1", "z_step_1", "log_std_10",
    "log_slope_30", "log_diff_1", "log_diff_5", "log_lag_1", "log_lag_2", "log_lag_5", "log_lag_10", "log_lead_1", "log_lead_2", "log_lead_5", "log_lead_10", "path_step",
]
# Means of few-digit values lie halfway between decimals now and then; as floats they don't.
MEANS = ["log_mean_10", "log_mean_30", "log_mean_100"]
ORDER = "PARTITION BY user_id ORDER BY row_idx"


def centred(expression, rows):
    return f"{expression} OVER ({ORDER} ROWS BETWEEN {rows // 2} PRECEDING AND {(rows - 1) // 2} FOLLOWING)"


WIDE_SQL = f"""{SERIES},
u AS (SELECT user_id, min(md) AS m0, max(md) AS m1, quantile_cont(gr, 0.5) AS gm, quantile_cont(tvt_input, 0.5) AS tm FROM s GROUP BY 1),
a AS (SELECT quantile_cont(gr, 0.5) AS ga, quantile_cont(tvt_input, 0.5) AS ta FROM s),
f AS (SELECT s.*, md - m0 AS depth_from_start, coalesce((md - m0) / nullif(m1 - m0, 0), 0) AS depth_fraction, coalesce(gr, gm, ga, 0) AS gr_filled,
      coalesce(tvt_input, tm, ta, 0) AS tvt_input_filled FROM s JOIN u USING (user_id), a),
wf AS (SELECT *, {", ".join(f"coalesce({c} - lag({c}) OVER ({ORDER}), 0) AS {c}_step_1" for c in "xyz")},
      {", ".join(f"{centred('avg(gr_filled)', n)} AS log_mean_{n}" for n in (10, 30, 100))}, coalesce({centred('stddev_samp(gr_filled)', 10)}, 0) AS log_std_10,
      regr_slope(gr_filled, md) OVER ({ORDER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sl,
      {", ".join(f"coalesce(gr_filled - lag(gr_filled, {k}) OVER ({ORDER}), 0) AS log_diff_{k}" for k in (1, 5))},
      {", ".join(f"coalesce({g}(gr_filled, {k}) OVER ({ORDER}), gr_filled) AS log_{g}_{k}" for g in ("lag", "lead") for k in (1, 2, 5, 10))} FROM f),
wide AS (SELECT *, CASE WHEN sl IS NULL OR isnan(sl) THEN 0 ELSE sl END AS log_slope_30, sqrt(x_step_1 * x_step_1 + y_step_1 * y_step_1 + z_step_1 * z_step_1) AS path_step FROM wf)"""


@query("z02_feature_set", f"WITH {WIDE_SQL} SELECT user_id, row_idx, {rounded(*WIDE)}, {", ".join(f"CAST({m} AS FLOAT) AS {m}" for m in MEANS)} FROM wide")
def feature_set(spark, sf):
    rows, _ = features.build_features(series(spark, sf), sets=["basic", "lags"], keys=KEYS)
    return show(rows.withColumns({m: F.col(m).cast("float") for m in MEANS}), [*ID, *MEANS], WIDE)


OWN = {"self": ["value", "score"], "signature": ["value", "delta", "score", "trust", "gap"]}
ALIGNED = [*SCAN, *MULTI, *(f"{s}_{c}" for s, names in OWN.items() for c in names)]


def aligned_sql() -> str:
    parts = {"a": "f06_lag_scan", "b": "f07_lag_scan_multiscale", "c": "f16_self_match", "d": "f18_signature_match"}
    tables = " LEFT JOIN ".join(f"({CATALOG[q].sql}) {n}{'' if n == 'a' else ' USING (user_id, row_idx)'}" for n, q in parts.items())
    own = [f"coalesce({t}.match_{c}, 0) AS {s}_{c}" for t, (s, names) in zip("cd", OWN.items(), strict=True) for c in names]
    return f"SELECT user_id, row_idx, {', '.join([*(f'coalesce({c}, 0) AS {c}' for c in [*SCAN, *MULTI]), *own])} FROM {tables}"


@query("z04_aligned_features", aligned_sql())
def aligned_features(spark, sf):
    """Lag scans at one and at several windows, self match and signatures beside the basic set, in one frame at full size."""
    rows, _ = features.build_features(
        series(spark, sf), curves(spark, sf), ["basic", "scan", "scales", "self", "signature"], options={"signature": {"log": "value"}}, **REF
    )
    return show(rows, ID, ALIGNED)


@query("z03_pipeline")
def pipeline(spark, sf):
    """No SQL: fits per fold. From raw series over feature sets, two out-of-fold models and their blend to a smoothed submission."""
    curve = align.prepare_reference(reference(spark, sf), label="geology", keys=REF_KEYS)
    rows = series(spark, sf).withColumn("fold", (F.col("user_id") % 5).cast("int"))
    wide, names = features.build_features(rows, curve, ["basic", "lags", "scan", "layers"], keys=KEYS, ref_keys=REF_KEYS)
    narrow = [n for n in names if not n.startswith(("best_", "corr_", "ref_", "peak", "layer", "label", "log_minus", "log_label", "distinct", "n_layers"))]
    vectors = evaluate.with_vectors(wide, {"_narrow": narrow, "_wide": names})
    wide = checkpoint(vectors.select(*rows.columns, "_narrow", "_wide"))  # both models read it
    line = lambda: LinearRegression(solver="normal", regParam=0.1)
    first, _, _ = evaluate.run_cv(wide, line, narrow, "value", "fold", 5, vector="_narrow")
    second, _, _ = evaluate.run_cv(wide, line, names, "value", "fold", 5, vector="_wide")
    both = first.withColumnRenamed("oof", "narrow").join(second.select(*ID, F.col("oof").alias("wide")), ID)
    weights, _ = search.greedy_average(gram(both, ["narrow", "wide"], "value"))
    mixed = blend.blend(both, dict(zip(["narrow", "wide"], weights, strict=True)))
    tail = smooth.postprocess(mixed.where("tvt_input is null"), "blend", keys=KEYS)
    return make_row_id(tail, "user_id").select("id", (F.round("processed", 4) + 0.0).alias("tvt"))
