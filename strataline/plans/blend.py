"""Queries for blending and tuning."""

from pyspark.sql import functions as F

from strataline.functions.gram import gram_sums
from strataline.operators import blend
from strataline.plans.evaluate import MIXED, mixed
from strataline.plans.fixtures import ID, KEYS, PREDICTIONS, SERIES, predictions, rounded, series, show
from strataline.plans.registry import query
from strataline.plans.smooth import savgol_sql
from strataline.plans.windows import BY, over

MODELS = ["m1", "m2", "m3"]


@query("l01_blend", f"WITH {MIXED} SELECT user_id, row_idx, round(m1 * 0.5 + m2 * 0.3 + m3 * 0.2, 6) + 0.0 AS blend, round((m1 + m2 + m3) / 3, 6) + 0.0 AS mean FROM mx")
def blend_weights(spark, sf):
    rows = blend.blend(mixed(spark, sf), {"m1": 0.5, "m2": 0.3, "m3": 0.2})
    return show(blend.blend_mean(rows, MODELS, "mean"), ID, ["blend", "mean"])


@query(
    "l02_rank_blend",
    f"""WITH {MIXED}, l AS (SELECT user_id, row_idx, 0 AS i, m1 AS v, 0.5::DOUBLE AS w FROM mx UNION ALL SELECT user_id, row_idx, 1, m2, 0.3 FROM mx UNION ALL SELECT user_id, row_idx, 2, m3, 0.2 FROM mx),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, row_idx ORDER BY v, i) AS a, row_number() OVER (PARTITION BY user_id, row_idx ORDER BY v DESC, i) AS d FROM l)
        SELECT user_id, row_idx, round(0.7 * sum(v * (w + [0.05, 0.0, -0.05]::DOUBLE[][a])) + 0.3 * sum(v * (w + [0.05, 0.0, -0.05]::DOUBLE[][d])), 6) + 0.0 AS rank_blend FROM r GROUP BY 1, 2""".replace("::DOUBLE[][a]", "[a]::DOUBLE").replace("::DOUBLE[][d]", "[d]::DOUBLE"),
)
def rank_blend(spark, sf):
    found = blend.rank_blend(mixed(spark, sf), {"m1": 0.5, "m2": 0.3, "m3": 0.2}, [0.05, 0.0, -0.05], (0.7, 0.3))
    return show(found, ID, ["rank_blend"])


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
TERMS = ["m1", "m2", "m3", "value", "1.0::DOUBLE"]


@query(
    "l03_gram",
    f"""WITH {MIXED} SELECT fold, {", ".join(f"round(sum({TERMS[i]} * {TERMS[j]}), 2) + 0.0 AS s_{i}_{j}" for i, j in PAIRS)} FROM mx GROUP BY 1""",
)
def gram_statistics(spark, sf):
    return show(gram_sums(mixed(spark, sf), MODELS, "value", ["fold"]), ["fold"], [f"s_{i}_{j}" for i, j in PAIRS], 2)


def weights(df):
    return show(df, ["model"], ["weight", "rmse"], 5)


@query("l04_hill_climb_average")
def hill_climb_average(spark, sf):
    """No SQL: greedy search on product sums."""
    return weights(blend.hill_climb_average(mixed(spark, sf), MODELS, "value"))


@query("l05_hill_climb_transfer")
def hill_climb_transfer(spark, sf):
    """No SQL: greedy search on product sums."""
    return weights(blend.hill_climb_transfer(mixed(spark, sf), MODELS, "value", 0.01))


@query("l06_greedy_blend")
def greedy_blend(spark, sf):
    """No SQL: greedy search on product sums."""
    return weights(blend.greedy_blend(mixed(spark, sf), MODELS, "value", 0.05, True))


@query(
    "l07_simplex_grid",
    f"""WITH {MIXED}, e AS (SELECT sqrt(avg(pow(m1 - value, 2))) AS e1, sqrt(avg(pow(m2 - value, 2))) AS e2, sqrt(avg(pow(m3 - value, 2))) AS e3 FROM mx),
        b AS (SELECT user_id, row_idx, value, list_sort([{{'e': e1, 'v': m1}}, {{'e': e2, 'v': m2}}, {{'e': e3, 'v': m3}}]) AS l FROM mx, e),
        g AS (SELECT i, j FROM range(11) t(i), range(11) u(j) WHERE i + j <= 10)
        SELECT round(i / 10.0::DOUBLE, 6) AS w1, round(j / 10.0::DOUBLE, 6) AS w2, round((10 - i - j) / 10.0::DOUBLE, 6) AS w3,
          round(sqrt(avg(pow(i / 10.0::DOUBLE * l[1].v + j / 10.0::DOUBLE * l[2].v + (10 - i - j) / 10.0::DOUBLE * l[3].v - value, 2))), 5) + 0.0 AS rmse FROM b, g GROUP BY i, j""",
)
def simplex_grid(spark, sf):
    found = blend.simplex_grid(mixed(spark, sf), MODELS, "value", 0.1)
    return found.select(*[F.round(w, 6).alias(w) for w in ("w1", "w2", "w3")], (F.round("rmse", 5) + 0.0).alias("rmse"))


@query("l08_nnls_stack")
def nnls_stack(spark, sf):
    """No SQL: constrained least squares per fold."""
    return show(blend.nnls_stack(mixed(spark, sf), MODELS, "value", "fold", True)[1], [*ID, "fold"], ["oof"], 4)


@query("l09_convex_weights")
def convex_weights(spark, sf):
    """No SQL: constrained least squares."""
    rows = blend.convex_weights(mixed(spark, sf), MODELS, "value", 1.0, "entities", keys=KEYS)
    return show(rows, ["model"], ["weight", "rmse"], 4)


@query("l10_ridge_stack")
def ridge_stack(spark, sf):
    """No SQL: constrained ridge per fold."""
    return show(blend.ridge_stack(mixed(spark, sf), MODELS, "value", 1.0, "fold")[1], [*ID, "fold"], ["oof"], 4)


# With one or two models every search and every constrained fit has a closed form or a small grid.
TWO = ["m1", "m2"]
SUMS = "sum(m1 * m1) AS aa, sum(m1 * m2) AS ab, sum(m2 * m2) AS bb, sum(m1 * value) AS ay, sum(m2 * value) AS byy, sum(value * value) AS yy, count(*)::DOUBLE AS n"


def two_rmse(a, b):
    return f"sqrt(greatest({a} * {a} * aa + 2 * {a} * {b} * ab + {b} * {b} * bb - 2 * {a} * ay - 2 * {b} * byy + yy, 0) / n)"


def two_rows(found):
    """Both models' weights from one row (a, b, e)."""
    return f"SELECT 'm1' AS model, round(a, 5) + 0.0 AS weight, round(e, 5) + 0.0 AS rmse FROM {found} UNION ALL SELECT 'm2', round(b, 5) + 0.0, round(e, 5) + 0.0 FROM {found}"


@query(
    "l04_average_of_two",
    f"""WITH RECURSIVE {MIXED}, g AS (SELECT {SUMS} FROM mx),
        st AS (SELECT CASE WHEN {two_rmse(1, 0)} <= {two_rmse(0, 1)} THEN 1.0::DOUBLE ELSE 0.0 END AS ca, CASE WHEN {two_rmse(1, 0)} <= {two_rmse(0, 1)} THEN 0.0::DOUBLE ELSE 1.0 END AS cb,
            least({two_rmse(1, 0)}, {two_rmse(0, 1)}) AS e FROM g
          UNION ALL
          SELECT CASE WHEN ea < e - 1e-5 THEN ca + 1 ELSE ca END, CASE WHEN ea < e - 1e-5 THEN cb ELSE cb + 1 END, CASE WHEN ea < e - 1e-5 THEN ea ELSE eb END
          FROM (SELECT ca, cb, e, {two_rmse("((ca + 1) / (ca + cb + 1))", "(cb / (ca + cb + 1))")} AS ea, {two_rmse("(ca / (ca + cb + 1))", "((cb + 1) / (ca + cb + 1))")} AS eb FROM st, g)
          WHERE least(ea, eb) < e - 1e-5),
        z AS (SELECT ca / (ca + cb) AS a, cb / (ca + cb) AS b, e FROM st ORDER BY ca + cb DESC LIMIT 1)
        {two_rows("z")}""",
)
def average_of_two(spark, sf):
    return weights(blend.hill_climb_average(mixed(spark, sf), TWO, "value"))


@query(
    "l05_transfer_of_two",
    f"""WITH {MIXED}, g AS (SELECT {SUMS} FROM mx), q AS (SELECT k / 100.0::DOUBLE AS a, 1 - k / 100.0::DOUBLE AS b FROM range(101) t(k)),
        z AS (SELECT a, b, {two_rmse("a", "b")} AS e FROM q, g ORDER BY e LIMIT 1) {two_rows("z")}""",
)
def transfer_of_two(spark, sf):
    return weights(blend.hill_climb_transfer(mixed(spark, sf), TWO, "value", 0.01))


@query(
    "l06_greedy_of_two",
    f"""WITH {MIXED}, g AS (SELECT {SUMS} FROM mx), f AS (SELECT {two_rmse(1, 0)} <= {two_rmse(0, 1)} AS first, least({two_rmse(1, 0)}, {two_rmse(0, 1)}) AS alone FROM g),
        q AS (SELECT CASE WHEN first THEN 1 - w ELSE w END AS a, CASE WHEN first THEN w ELSE 1 - w END AS b, w, alone FROM (SELECT k / 20.0::DOUBLE AS w FROM range(-10, 11) t(k)), f),
        e AS (SELECT a, b, w, alone, {two_rmse("a", "b")} AS e FROM q, g),
        z AS (SELECT a, b, e FROM e WHERE e < alone - 1e-7 OR w = 0 ORDER BY e, w LIMIT 1) {two_rows("z")}""",
)
def greedy_of_two(spark, sf):
    return weights(blend.greedy_blend(mixed(spark, sf), TWO, "value", 0.05, True))


OTHERS = "o AS (SELECT u.fold, m2 AS x, value AS y FROM mx JOIN (SELECT DISTINCT fold FROM mx) u ON mx.fold <> u.fold)"


@query(
    "l08_nnls_one_model",
    f"""WITH {MIXED}, {OTHERS}, c AS (SELECT fold, regr_slope(y, x) AS w, regr_intercept(y, x) AS b, greatest(sum(x * y) / sum(x * x), 0) AS w0, greatest(avg(y), 0) AS b0,
          sum(x * x) AS xx, sum(x * y) AS xy, sum(y) AS sy, count(*) AS n FROM o GROUP BY 1),
        k AS (SELECT fold, CASE WHEN w >= 0 AND b >= 0 THEN w WHEN w0 * w0 * xx - 2 * w0 * xy <= b0 * b0 * n - 2 * b0 * sy THEN w0 ELSE 0 END AS w,
          CASE WHEN w >= 0 AND b >= 0 THEN b WHEN w0 * w0 * xx - 2 * w0 * xy <= b0 * b0 * n - 2 * b0 * sy THEN 0 ELSE b0 END AS b FROM c)
        SELECT user_id, row_idx, fold, round(k.w * m2 + k.b, 4) + 0.0 AS oof FROM mx JOIN k USING (fold)""",
)
def nnls_one_model(spark, sf):
    return show(blend.nnls_stack(mixed(spark, sf), ["m2"], "value", "fold", True)[1], [*ID, "fold"], ["oof"], 4)


@query(
    "l09_convex_two_models",
    f"""WITH {MIXED}, u AS (SELECT user_id, avg((m1 - m2) * (m1 - m2)) AS dd, avg((m1 - m2) * (value - m2)) AS dy, avg((value - m2) * (value - m2)) AS yy FROM mx GROUP BY 1),
        v AS (SELECT avg(dd) AS dd, avg(dy) AS dy, avg(yy) AS yy FROM u), w AS (SELECT *, least(greatest((dy + 1.0) / (dd + 2.0), 0), 1) AS a FROM v),
        z AS (SELECT a, 1 - a AS b, sqrt(a * a * dd - 2 * a * dy + yy) AS e FROM w)
        SELECT 'm1' AS model, round(a, 4) + 0.0 AS weight, round(e, 4) + 0.0 AS rmse FROM z UNION ALL SELECT 'm2', round(b, 4) + 0.0, round(e, 4) + 0.0 FROM z""",
)
def convex_two_models(spark, sf):
    return show(blend.convex_weights(mixed(spark, sf), TWO, "value", 1.0, "entities", keys=KEYS), ["model"], ["weight", "rmse"], 4)


@query(
    "l10_ridge_one_model",
    f"""WITH {MIXED}, {OTHERS}, c AS (SELECT fold, greatest(covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1.0), 0) AS w, avg(x) AS ax, avg(y) AS ay FROM o GROUP BY 1)
        SELECT user_id, row_idx, fold, round(w * m2 + ay - w * ax, 4) + 0.0 AS oof FROM mx JOIN c USING (fold)""",
)
def ridge_one_model(spark, sf):
    return show(blend.ridge_stack(mixed(spark, sf), ["m2"], "value", 1.0, "fold")[1], [*ID, "fold"], ["oof"], 4)


@query(
    "l11_weight_grid",
    f"""WITH {MIXED}, g AS (SELECT u, v FROM (VALUES (0.0::DOUBLE), (0.25), (0.5)) a(u), (VALUES (-0.1::DOUBLE), (0.0), (0.1)) b(v))
        SELECT u AS weight_a, v AS weight_b, round(sqrt(avg(pow(value - m1 - u * (m2 - m1) - v * (m3 - m1), 2))), 5) + 0.0 AS rmse FROM mx, g GROUP BY 1, 2""",
)
def weight_grid(spark, sf):
    rows = mixed(spark, sf).withColumns({"a": F.col("m2") - F.col("m1"), "b": F.col("m3") - F.col("m1")})
    found = blend.weight_grid(rows, "m1", "a", "b", "value", [0.0, 0.25, 0.5], [-0.1, 0.0, 0.1])
    return show(found, ["weight_a", "weight_b"], ["rmse"], 5)


TAUS = [None, 50.0, 200.0]
FADE = "CASE WHEN tau IS NULL THEN 1 ELSE 1 - exp(-greatest(md, 0) / tau) END"


@query(
    "l12_policy_grid",
    f"""WITH {MIXED}, g AS (SELECT alpha, tau, weight FROM (VALUES (0.8::DOUBLE), (1.0)) a(alpha), (VALUES (NULL::DOUBLE), (50.0), (200.0)) t(tau), (VALUES (0.0::DOUBLE), (0.1)) w(weight))
        SELECT alpha, tau, weight, round(sqrt(avg(pow(value - pred_c - alpha * ({FADE}) * ((1 - weight) * (m1 - pred_c) + weight * (m2 - pred_c)), 2))), 5) + 0.0 AS rmse FROM mx, g WHERE is_eval GROUP BY 1, 2, 3""",
)
def policy_grid(spark, sf):
    rows = deltas(mixed(spark, sf)).where(F.col("tvt_input").isNull())
    found = blend.policy_grid(rows, "dy", "d1", "d2", "md", [0.8, 1.0], TAUS, [0.0, 0.1])
    return show(found, ["alpha", "tau", "weight"], ["rmse"], 5)


def deltas(df):
    return df.withColumns(
        {"dy": F.col("value") - F.col("pred_c"), "d1": F.col("m1") - F.col("pred_c"), "d2": F.col("m2") - F.col("pred_c")}
    )


@query(
    "l13_fit_alpha",
    f"""WITH {MIXED}, g AS (SELECT tau FROM (VALUES (NULL::DOUBLE), (50.0), (200.0)) t(tau)), d AS (SELECT tau, value - pred_c AS t, (m1 - pred_c) * ({FADE}) AS f FROM mx, g WHERE is_eval),
        a AS (SELECT tau, least(greatest(sum(t * f) / sum(f * f), 0), 1.5) AS alpha FROM d GROUP BY 1)
        SELECT d.tau, round(max(alpha), 6) + 0.0 AS alpha, round(sqrt(avg(pow(t - alpha * f, 2))), 5) + 0.0 AS rmse FROM d JOIN a ON a.tau IS NOT DISTINCT FROM d.tau GROUP BY 1""",
)
def fit_alpha(spark, sf):
    rows = deltas(mixed(spark, sf)).where(F.col("tvt_input").isNull())
    found = blend.fit_alpha(rows, "dy", "d1", "md", TAUS)
    return found.select("tau", (F.round("alpha", 6) + 0.0).alias("alpha"), (F.round("rmse", 5) + 0.0).alias("rmse"))


CANDIDATES = [
    {"name": "none", "kind": "none"},
    {"name": "savgol_25", "kind": "savgol", "window": 11, "order": 2, "shrink": 0.25},
    {"name": "savgol_100", "kind": "savgol", "window": 11, "order": 2, "shrink": 1.0},
    {"name": "median_50", "kind": "median", "window": 5, "shrink": 0.5},
    {"name": "cascade_50", "kind": "median_savgol", "median": 5, "window": 9, "order": 2, "shrink": 0.5},
]


@query(
    "l14_sweep",
    f"""WITH {MIXED}, {savgol_sql("m3", 11, 2, "mx", "sa", "v1")}, q AS (SELECT *, quantile_cont(m3, 0.5) {over(2, 2)} AS v2 FROM sa), {savgol_sql("v2", 9, 2, "q", "sb", "v3")},
        e AS (SELECT sqrt(avg(pow(value - m3, 2))) AS r0, sqrt(avg(pow(value - m3 - 0.25 * (v1 - m3), 2))) AS r1, sqrt(avg(pow(value - v1, 2))) AS r2,
          sqrt(avg(pow(value - m3 - 0.5 * (v2 - m3), 2))) AS r3, sqrt(avg(pow(value - m3 - 0.5 * (v3 - m3), 2))) AS r4 FROM sb),
        l AS (SELECT position, name, [r0, r1, r2, r3, r4][position + 1] AS rmse, least(r0, r1, r2, r3, r4) AS best, r0 FROM e, (VALUES {", ".join(f"({i}, '{c['name']}')" for i, c in enumerate(CANDIDATES))}) t(position, name))
        SELECT position, name, round(rmse, 5) + 0.0 AS rmse, CASE WHEN best >= r0 - 0.002 THEN name = 'none' ELSE rmse = best END AS chosen FROM l""",
)
def sweep(spark, sf):
    return show(blend.sweep(mixed(spark, sf), "m3", "value", CANDIDATES, keys=KEYS), ["position", "name", "chosen"], ["rmse"], 5)


# The variant of each regime, and the one for any other.
VARIANTS = {
    0: "pf_scale_5_hold_0.2",
    1: "pf_scale_3_hold_0.15",
    2: "pf_scale_12_beam_0.2_hold_0.15",
    3: "pf_scale_5_hold_0.15",
    4: "pf_scale_5_beam_0.05_hold_0.05",
    5: "pf_scale_12_beam_0.2_hold_0.05",
}
DEFAULT_VARIANT = "pf_scale_8_hold_0.2"
REGIME_SQL = f"""
rg AS (SELECT user_id, count(*) FILTER (is_eval) AS eval_len, max(z) FILTER (is_eval) - min(z) FILTER (is_eval) AS z_span FROM s GROUP BY 1),
rv AS (SELECT *, CAST((eval_len > 20)::INT + 2 * ((z_span >= 21.5)::INT + (z_span >= 23)::INT) AS INT) AS regime FROM rg),
rx AS (SELECT *, CASE regime {" ".join(f"WHEN {k} THEN '{v}'" for k, v in VARIANTS.items() if k != 5)} ELSE '{DEFAULT_VARIANT}' END AS variant FROM rv)"""


def regimes(spark, sf):
    kept = {k: v for k, v in VARIANTS.items() if k != 5}
    return blend.regime_code(series(spark, sf), 20, [21.5, 23.0], kept, DEFAULT_VARIANT, keys=KEYS)


@query("l15_regime_code", f"WITH {SERIES}, {REGIME_SQL} SELECT user_id, eval_len, round(z_span, 6) + 0.0 AS z_span, regime, variant FROM rx")
def regime_code(spark, sf):
    return show(regimes(spark, sf), [*KEYS, "eval_len", "regime", "variant"], ["z_span"])


@query(
    "l16_apply_variant",
    f"""WITH {PREDICTIONS}, {REGIME_SQL}, q AS (SELECT p.*, coalesce(TRY_CAST(nullif(regexp_extract(variant, 'beam_([0-9.]+)', 1), '') AS DOUBLE), 0) AS bw,
          coalesce(TRY_CAST(nullif(regexp_extract(variant, 'hold_([0-9.]+)', 1), '') AS DOUBLE), 0) AS hw,
          CASE regexp_extract(variant, 'scale_([0-9.]+)', 1) WHEN '5' THEN pred_a WHEN '12' THEN pred_b ELSE (pred_a + pred_b) / 2 END AS base FROM p JOIN rx USING (user_id))
        SELECT user_id, row_idx, round((1 - hw) * ((1 - bw) * base + bw * pred_b) + hw * pred_c, 8) + 0.0 AS variant_pred FROM q WHERE is_eval""",
)
def apply_variant(spark, sf):
    tail = predictions(spark, sf).where(F.col("tvt_input").isNull()).withColumn("mean", (F.col("pred_a") + F.col("pred_b")) / 2)
    rows = tail.join(regimes(spark, sf).select(*KEYS, "variant"), KEYS)
    found = blend.apply_variant(rows, "variant", {"5": "pred_a", "12": "pred_b"}, "mean", "pred_b", "pred_c")
    return show(found, ID, ["variant_pred"], 8)


@query(
    "l17_blend_from_history",
    f"WITH {MIXED} SELECT user_id, row_idx, round(0.7 * m1 + 0.3 * m3, 6) + 0.0 AS blend FROM mx",
)
def blend_from_history(spark, sf):
    history = spark.createDataFrame([("m1", 0.7), ("m3", 0.3), ("unknown", 9.0)], "model string, weight double")
    return show(blend.blend_from_history(mixed(spark, sf), history, MODELS, ID), ID, ["blend"])


@query(
    "l18_entity_features",
    f"""WITH {SERIES} SELECT user_id, round(avg(value), 6) + 0.0 AS value__mean, round(avg(gr), 6) + 0.0 AS gr__mean, round(avg(z), 6) + 0.0 AS z__mean,
          round(stddev_samp(gr), 6) + 0.0 AS gr__std, count(*) AS row_count FROM s GROUP BY 1""",
)
def entity_features(spark, sf):
    found = blend.entity_features(series(spark, sf), ["value", "gr", "z"], ["gr"], KEYS)
    return show(found, [*KEYS, "row_count"], ["value__mean", "gr__mean", "z__mean", "gr__std"])


ENSEMBLE = ["member_std", "member_range", "left_mean", "right_mean", "family_difference", "base_centered", "row_frac", "log_rows"]


@query(
    "l19_ensemble_features",
    f"""WITH {MIXED}, o AS (SELECT user_id, row_idx, list_stddev_pop([m1, m2, m3]) AS member_std, greatest(m1, m2, m3) - least(m1, m2, m3) AS member_range, (m1 + m2) / 2 AS left_mean, m3 AS right_mean,
          (m1 + m2) / 2 - m3 AS family_difference, m1 - avg(m1) OVER (PARTITION BY user_id) AS base_centered, row_idx::DOUBLE / greatest(n - 1, 1) AS row_frac, ln(1 + n) AS log_rows FROM mx)
        SELECT user_id, row_idx, {rounded(*ENSEMBLE)} FROM o""",
)
def ensemble_features(spark, sf):
    found = blend.ensemble_features(mixed(spark, sf), MODELS, {"left": ["m1", "m2"], "right": ["m3"]}, "m1", keys=KEYS)
    return show(found, ID, ENSEMBLE)


@query(
    "l20_known_row_blend",
    f"""WITH {MIXED}, k AS (SELECT user_id, sqrt(avg(pow(tvt_input - m1, 2))) AS e1, sqrt(avg(pow(tvt_input - m2, 2))) AS e2, sqrt(avg(pow(tvt_input - m3, 2))) AS e3
          FROM mx WHERE NOT is_eval AND row_idx >= eval_start - 15 GROUP BY 1), b AS (SELECT *, least(e1, e2, e3) AS lo FROM k),
        w AS (SELECT user_id, exp(-(e1 - lo) / 2) AS w1, exp(-(e2 - lo) / 2) AS w2, exp(-(e3 - lo) / 2) AS w3, list_sort([(e1, 0), (e2, 1), (e3, 2)]) AS r FROM b),
        v AS (SELECT *, [m1, m2, m3] AS ms FROM mx JOIN w USING (user_id))
        SELECT user_id, row_idx, round((m1 * w1 + m2 * w2 + m3 * w3) / (w1 + w2 + w3), 6) + 0.0 AS softmax, ['m1', 'm2', 'm3'][r[1][2] + 1] AS choice,
          round((ms[r[1][2] + 1] + ms[r[2][2] + 1] / 2 + ms[r[3][2] + 1] / 3) / (11 / 6.0::DOUBLE), 6) + 0.0 AS rank,
          round(CASE WHEN r[2][1] - r[1][1] < 3 THEN (ms[r[1][2] + 1] + ms[r[2][2] + 1]) / 2 ELSE ms[r[1][2] + 1] END, 6) + 0.0 AS choose FROM v""",
)
def known_row_blend(spark, sf):
    rows = mixed(spark, sf)
    for mode, options in (("choose", {"margin": 3.0}), ("rank", {}), ("softmax", {"temperature": 2.0})):
        rows = blend.known_row_blend(rows.drop("choice"), MODELS, mode, 15, out=mode, keys=KEYS, **options)
    return show(rows, [*ID, "choice"], ["softmax", "rank", "choose"])


@query(
    "l20_choice_counts",
    f"""WITH {MIXED}, k AS (SELECT user_id, list_sort([(sqrt(avg(pow(tvt_input - m1, 2))), 0), (sqrt(avg(pow(tvt_input - m2, 2))), 1), (sqrt(avg(pow(tvt_input - m3, 2))), 2)]) AS r
          FROM mx WHERE NOT is_eval AND row_idx >= eval_start - 15 GROUP BY 1)
        SELECT ['m1', 'm2', 'm3'][r[1][2] + 1] AS choice, count(*) AS entities FROM k GROUP BY 1""",
)
def choice_counts(spark, sf):
    return blend.choice_counts(blend.known_row_blend(mixed(spark, sf), MODELS, "softmax", 15, keys=KEYS), KEYS)


@query(
    "l21_confidence_gate",
    f"""WITH {MIXED} SELECT user_id, row_idx, round(CASE WHEN gr IS NULL THEN 0 ELSE least(greatest((0.05 + 0.55 / (1 + pow(coalesce(abs(m1 - m2) / 10, 25) / 8, 2)) / (1 + pow(row_idx % 5 / 1.2, 2)))
          * least(greatest((35 - abs(gr - m1)) / 25, 0), 1), 0), 0.55) END, 6) + 0.0 AS gate FROM mx""",
)
def confidence_gate(spark, sf):
    rows = mixed(spark, sf).withColumns({"err": F.abs(F.col("m1") - F.col("m2")) / 10, "dist": (F.col("row_idx") % 5).cast("double")})
    return show(blend.confidence_gate(rows, "gr", "err", "dist", "m1"), ID, ["gate"])
