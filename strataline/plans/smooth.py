"""Queries for post-processing."""

from pyspark.sql import functions as F

from strataline.functions.savgol import centre_row, gaussian_kernel, projection
from strataline.operators import smooth
from strataline.plans.fixtures import ID, KEYS, PREDICTIONS, SERIES, predictions, rounded, series, show
from strataline.plans.registry import query
from strataline.plans.windows import BY, over
from strataline.plans.zones import ANCHOR


def numbers(values):
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def savgol_sql(col, window, order, source, name, out):
    half = window // 2
    matrix = projection(window, order)
    first = "[" + ", ".join(numbers(matrix[i]) for i in range(half)) + "]"
    last = "[" + ", ".join(numbers(matrix[half + 1 + i]) for i in range(half)) + "]"
    return f"""{name}l AS (SELECT *, list({col}) OVER ({BY} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS mid,
          list({col}) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM {source}),
        {name} AS (SELECT * EXCLUDE (mid, every), CASE WHEN row_idx < {half} THEN list_dot_product(every[1:{window}], ({first})[row_idx + 1])
          WHEN row_idx >= n - {half} THEN list_dot_product(every[-{window}:], ({last})[row_idx - n + {half} + 1])
          ELSE list_dot_product(mid, {numbers(centre_row(window, order))}) END AS {out} FROM {name}l)"""


@query("j01_savgol", f"WITH {SERIES}, {savgol_sql('value', 11, 3, 's', 'o', 'smooth')} SELECT user_id, row_idx, round(smooth, 6) + 0.0 AS smooth FROM o")
def savgol(spark, sf):
    return show(smooth.savgol(series(spark, sf), "value", 11, 3, keys=KEYS), ID, ["smooth"])


KERNEL = gaussian_kernel(2.0)
RADIUS = len(KERNEL) // 2


@query(
    "j02_kernel_smooth",
    f"""WITH {SERIES}, l AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM s),
        o AS (SELECT user_id, row_idx, list_dot_product(list_transform(range({2 * RADIUS + 1}), lambda k: every[least(greatest(row_idx + k - {RADIUS}, 0), n - 1) + 1]), {numbers(KERNEL)}) AS gaussian,
          list_avg(list_transform(range(8), lambda k: every[least(greatest(row_idx + k - 4, 0), n - 1) + 1])) AS uniform FROM l)
        SELECT user_id, row_idx, round(gaussian, 6) + 0.0 AS gaussian, round(uniform, 5) + 0.0 AS uniform FROM o""",
)
def kernel_smooth(spark, sf):
    rows = smooth.kernel_smooth(series(spark, sf), "value", "gaussian", 2.0, "gaussian", keys=KEYS)
    rows = smooth.kernel_smooth(rows, "value", "uniform", 8, "uniform", keys=KEYS)
    return rows.select(*ID, (F.round("gaussian", 6) + 0.0).alias("gaussian"), (F.round("uniform", 5) + 0.0).alias("uniform"))


@query(
    "j03_median_cascade",
    f"""WITH {SERIES}, m AS (SELECT *, quantile_cont(value, 0.5) {over(2, 2)} AS md5 FROM s), {savgol_sql("md5", 9, 2, "m", "c", "smooth")},
        z AS (SELECT *, list_sort(list_concat(list(value) {over(3, 3)}, list_transform(range(7 - count(*) {over(3, 3)}), lambda k: 0.0::DOUBLE)))[4] AS zero_median FROM c)
        SELECT user_id, row_idx, round(smooth, 6) + 0.0 AS smooth, zero_median FROM z""",
)
def median_cascade(spark, sf):
    rows = smooth.median_cascade(series(spark, sf), "value", 5, 9, 2, keys=KEYS)
    rows = smooth.median_cascade(rows, "value", 7, pad="zero", out="zero_median", keys=KEYS)
    return show(rows, [*ID, "zero_median"], ["smooth"])


@query(
    "j04_shrink_to_smooth",
    f"""WITH {SERIES}, {savgol_sql("value", 11, 3, "s", "c", "smooth")} SELECT user_id, row_idx, round(value + 0.25 * (smooth - value), 6) + 0.0 AS shrunk FROM c""",
)
def shrink_to_smooth(spark, sf):
    rows = smooth.savgol(series(spark, sf), "value", 11, 3, keys=KEYS)
    return show(smooth.shrink_to_smooth(rows, "value", "smooth", 0.25), ID, ["shrunk"])


@query(
    "j05_clip_percentile",
    f"""WITH {SERIES}, k AS (SELECT user_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM s GROUP BY 1)
        SELECT user_id, row_idx, round(least(greatest(value, lo), hi), 6) + 0.0 AS clipped FROM s JOIN k USING (user_id)""",
)
def clip_percentile(spark, sf):
    return show(smooth.clip_percentile(series(spark, sf), "value", keys=KEYS), ID, ["clipped"])


@query(
    "j06_postprocess",
    f"""WITH {SERIES}, {savgol_sql("value", 11, 3, "s", "c", "smooth")}, k AS (SELECT user_id, quantile_cont(smooth, 0.01) AS lo, quantile_cont(smooth, 0.99) AS hi FROM c GROUP BY 1)
        SELECT user_id, row_idx, round(least(greatest(smooth, lo), hi), 6) + 0.0 AS processed FROM c JOIN k USING (user_id)""",
)
def postprocess(spark, sf):
    return show(smooth.postprocess(series(spark, sf), "value", keys=KEYS), ID, ["processed"])


@query(
    "j07_apply_policy",
    f"""WITH {PREDICTIONS} SELECT user_id, row_idx, round(0.9 * (1 - exp(-greatest(md, 0) / 85)) * (0.91 * pred_a + 0.09 * pred_b), 6) + 0.0 AS policy_delta FROM p""",
)
def apply_policy(spark, sf):
    return show(smooth.apply_policy(predictions(spark, sf), "pred_a", "pred_b", "md", 0.9, 85.0, 0.09), ID, ["policy_delta"])


@query(
    "j08_clip_delta",
    f"""WITH {PREDICTIONS}, b AS (SELECT quantile_cont(value - pred_c, 0.005) AS lo, quantile_cont(value - pred_c, 0.995) AS hi FROM p WHERE NOT is_eval)
        SELECT user_id, row_idx, round(0.9 * least(greatest(pred_b - pred_c, lo), hi), 5) + 0.0 AS clipped_delta FROM p, b WHERE is_eval""",
)
def clip_delta(spark, sf):
    rows = predictions(spark, sf).withColumns({"d": F.col("pred_b") - F.col("pred_c"), "t": F.col("value") - F.col("pred_c")})
    train, tail = rows.where(F.col("tvt_input").isNotNull()), rows.where(F.col("tvt_input").isNull())
    return show(smooth.clip_delta(tail, train, "d", "t", alpha=0.9), ID, ["clipped_delta"], 5)


@query(
    "j09_slope_limit",
    f"""WITH RECURSIVE {SERIES}, {ANCHOR}, w AS (SELECT user_id, row_idx - eval_start AS i, row_idx, md, value FROM s WHERE is_eval),
        f(user_id, i, row_idx, md, v) AS (
          SELECT w.user_id, i, w.row_idx, w.md, least(greatest(w.value, av - 2 * greatest(abs(w.md - amd), 1e-6)), av + 2 * greatest(abs(w.md - amd), 1e-6))
            FROM w JOIN k ON k.user_id = w.user_id WHERE i = 0
          UNION ALL SELECT w.user_id, w.i, w.row_idx, w.md, least(greatest(w.value, f.v - 2 * greatest(abs(w.md - f.md), 1e-6)), f.v + 2 * greatest(abs(w.md - f.md), 1e-6))
            FROM f JOIN w ON w.user_id = f.user_id AND w.i = f.i + 1)
        SELECT user_id, row_idx, round(v, 6) + 0.0 AS limited FROM f""",
)
def slope_limit(spark, sf):
    from strataline.operators.zones import last_known

    rows = last_known(series(spark, sf), {"v0": "tvt_input", "m0": "md"}, "tvt_input", KEYS)
    tail = rows.where(F.col("tvt_input").isNull())
    return show(smooth.slope_limit(tail, "value", 2.0, "v0", "m0", keys=KEYS), ID, ["limited"])


@query(
    "j10_slope_quantiles",
    f"""WITH {SERIES}, g AS (SELECT abs((value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0)) AS a FROM s WINDOW w AS ({BY}))
        SELECT q::DOUBLE AS quantile, round(quantile_cont(a, 0.5), 6) + 0.0 AS max_abs_slope FROM g, (VALUES (0.5)) t(q) GROUP BY 1
        UNION ALL SELECT 0.9::DOUBLE, round(quantile_cont(a, 0.9), 6) + 0.0 FROM g UNION ALL SELECT 0.995::DOUBLE, round(quantile_cont(a, 0.995), 4) + 0.0 FROM g""",
)
def slope_quantiles(spark, sf):
    found = smooth.slope_quantiles(series(spark, sf), [0.5, 0.9, 0.995], "value", keys=KEYS)
    digits = F.when(F.col("quantile") == 0.995, F.round("max_abs_slope", 4)).otherwise(F.round("max_abs_slope", 6))
    return found.select("quantile", (digits + 0.0).alias("max_abs_slope"))


BIASES = ["bias_last", "bias_late_mean", "bias_late_median", "bias_exp"]


@query(
    "j11_anchor_bias",
    f"""WITH {PREDICTIONS}, r AS (SELECT *, tvt_input - pred_c AS res, eval_start - row_idx AS b FROM p WHERE NOT is_eval),
        k AS (SELECT user_id, max(md) AS amd, arg_max(res, row_idx) AS bias_last, avg(res) FILTER (b <= 10) AS bias_late_mean, quantile_cont(res, 0.5) FILTER (b <= 10) AS bias_late_median,
          sum(exp(-2.0 * (b - 1) / 9) * res) FILTER (b <= 10) / sum(exp(-2.0 * (b - 1) / 9)) FILTER (b <= 10) AS bias_exp FROM r GROUP BY 1)
        SELECT user_id, row_idx, {", ".join(f"round(pred_c + 0.8 * {b} * exp(-greatest(md - amd, 0) / 100), 6) + 0.0 AS {b}" for b in BIASES)} FROM p JOIN k USING (user_id)""",
)
def anchor_bias(spark, sf):
    rows = predictions(spark, sf)
    for mode in ("last", "late_mean", "late_median", "exp"):
        rows = smooth.anchor_bias(rows, mode, 10, 100.0, 0.8, "pred_c", out=f"bias_{mode}", keys=KEYS)
    return show(rows, ID, BIASES)


@query(
    "j12_anchor_trend",
    f"""WITH {PREDICTIONS}, r AS (SELECT *, tvt_input - pred_c AS res FROM p WHERE NOT is_eval AND row_idx >= eval_start - 10),
        k AS (SELECT user_id, max(md) AS amd, avg(res) AS b, regr_slope(res, md) AS sl, quantile_cont(res, 0.5) AS bm,
          (arg_max(res, row_idx) - arg_min(res, row_idx)) / (max(md) - min(md)) AS sf FROM r GROUP BY 1)
        SELECT user_id, row_idx, round(pred_c + 0.9 * b + 0.5 * least(greatest(sl * greatest(md - amd, 0), -20), 20), 6) + 0.0 AS linear,
          round(pred_c + bm + sf * greatest(md - amd, 0), 5) + 0.0 AS ends FROM p JOIN k USING (user_id)""",
)
def anchor_trend(spark, sf):
    rows = smooth.anchor_trend(
        predictions(spark, sf), 10, "mean", "linear", 0.9, 0.5, 20.0, "pred_c", out="linear", keys=KEYS
    )
    rows = smooth.anchor_trend(rows, 10, "median", "last_first", pred="pred_c", out="ends", keys=KEYS)
    return rows.select(*ID, (F.round("linear", 6) + 0.0).alias("linear"), (F.round("ends", 5) + 0.0).alias("ends"))


@query("j13_poly_project")
def poly_project(spark, sf):
    """No SQL: reweighted least squares; checked against numpy in the tests."""
    return show(smooth.poly_project(predictions(spark, sf), 3, 0.75, pred="pred_a", keys=KEYS), ID, ["projected"], 4)


def line_passes(count):
    """Weighted lines fitted again and again: CTEs f0 … f{count} with c0 and c1 per series, from rows "ba" with s and u."""
    out, rows, weight = [], "ba", "1.0::DOUBLE"
    for i in range(count + 1):
        out.append(f"""a{i} AS (SELECT user_id, sum(wt) AS p0, sum(wt * sx) AS p1, sum(wt * sx * sx) AS p2, sum(wt * u) AS t0, sum(wt * sx * u) AS t1 FROM (SELECT *, {weight} AS wt FROM {rows}) GROUP BY 1),
        f{i} AS (SELECT user_id, (t0 - p1 * (p0 * t1 - p1 * t0) / (p0 * p2 - p1 * p1)) / p0 AS c0, (p0 * t1 - p1 * t0) / (p0 * p2 - p1 * p1) AS c1 FROM a{i})""")
        out.append(f"""e{i} AS (SELECT ba.*, u - c0 - c1 * sx AS r FROM ba JOIN f{i} USING (user_id)),
        q{i} AS (SELECT e{i}.*, mad FROM e{i} JOIN (SELECT user_id, quantile_cont(abs(r), 0.5) AS mad FROM e{i} GROUP BY 1) USING (user_id))""")
        rows, weight = f"q{i}", "pow(1 / (1 + pow(r / (2.0 * (mad * 1.4826::DOUBLE + 1e-6)), 2)), 2)"
    return ", ".join(out)


@query(
    "j13_project_line",
    f"""WITH {PREDICTIONS}, an AS (SELECT user_id, count(tvt_input) AS known, count(*) FILTER (is_eval) AS tails, arg_max(tvt_input, row_idx) AS v, arg_max(z, row_idx) FILTER (NOT is_eval) AS z0,
          arg_max(md, row_idx) FILTER (NOT is_eval) AS m0, arg_max(md, row_idx) AS m1 FROM p GROUP BY 1),
        ba AS (SELECT user_id, row_idx, 2 * (md - m0) / greatest(m1 - m0, 1e-6) - 1 AS sx, pred_a + z - v - z0 AS u FROM p JOIN an USING (user_id) WHERE is_eval AND known >= 5 AND tails >= 3),
        {line_passes(4)}
        SELECT p.user_id, p.row_idx, round(pred_a + 0.75 * coalesce(c0 + c1 * sx - u, 0), 4) + 0.0 AS projected FROM p LEFT JOIN ba USING (user_id, row_idx) LEFT JOIN f4 ON f4.user_id = p.user_id""",
)
def project_line(spark, sf):
    """The reweighted fit of a line has a closed form in each pass."""
    return show(smooth.poly_project(predictions(spark, sf), 1, 0.75, pred="pred_a", keys=KEYS), ID, ["projected"], 4)


@query(
    "j14_offset_round",
    f"WITH {SERIES} SELECT user_id, row_idx, round(round_even((x + 0.1) / 0.05, 0) * 0.05, 6) + 0.0 AS rounded FROM s",
)
def offset_round(spark, sf):
    return show(smooth.offset_round(series(spark, sf), "x", 0.1, 0.05), ID, ["rounded"])


@query("j15_pin_known", f"WITH {PREDICTIONS} SELECT user_id, row_idx, round(coalesce(tvt_input, pred_a), 6) + 0.0 AS pinned FROM p")
def pin_known(spark, sf):
    return show(smooth.pin_known(predictions(spark, sf), "pred_a"), ID, ["pinned"])


BASELINES = ["constant", "linear", "position"]


@query(
    "j16_trend_baseline",
    f"""WITH {SERIES}, {ANCHOR}, g AS (SELECT *, (value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0) AS d1, (value + z - lag(value + z) OVER w) / nullif(md - lag(md) OVER w, 0) AS d2 FROM s WINDOW w AS ({BY})),
        h AS (SELECT user_id, least(greatest(quantile_cont(d1, 0.5), -0.12), 0.12) AS r1, least(greatest(quantile_cont(d2, 0.5), -0.12), 0.12) AS r2 FROM g WHERE NOT is_eval AND row_idx > eval_start - 30 GROUP BY 1),
        o AS (SELECT s.user_id, row_idx, av AS constant, av + r1 * (md - amd) AS linear, av + az + r2 * (md - amd) - z AS position FROM s JOIN k USING (user_id) JOIN h USING (user_id))
        SELECT user_id, row_idx, {rounded(*BASELINES)} FROM o""",
)
def trend_baseline(spark, sf):
    rows = series(spark, sf)
    for mode in BASELINES:
        rows = smooth.trend_baseline(rows, mode, out=mode, keys=KEYS)
    return show(rows, ID, BASELINES)
