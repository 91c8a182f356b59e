"""Queries for window features."""

from pyspark.sql import functions as F

from strataline.functions.series import apply_frames
from strataline.operators import windows
from strataline.operators.align import prepare_reference
from strataline.plans.fixtures import ID, KEYS, REFERENCE, SERIES, reference, rounded, series, show
from strataline.plans.gaps import NEIGHBOURS
from strataline.plans.registry import query

BY = "PARTITION BY user_id ORDER BY row_idx"


def over(before, after):
    ahead = f"{after} FOLLOWING" if after else "CURRENT ROW"
    return f"OVER ({BY} ROWS BETWEEN {before} PRECEDING AND {ahead})"


def stats_sql(col, before, after, w):
    o = over(before, after)
    return (
        f"round(avg({col}) {o}, 6) + 0.0 AS mean_{w}, round(coalesce(stddev_samp({col}) {o}, 0), 6) + 0.0 AS std_{w}, "
        f"min({col}) {o} AS min_{w}, max({col}) {o} AS max_{w}"
    )


def stat_names(*sizes):
    return [f"{s}_{w}" for w in sizes for s in ("mean", "std", "min", "max")]


@query(
    "d01_rolling_trailing",
    f"WITH {SERIES} SELECT user_id, row_idx, {stats_sql('gr', 4, 0, 5)}, {stats_sql('gr', 19, 0, 20)} FROM s",
)
def rolling_trailing(spark, sf):
    return show(windows.rolling_stats(series(spark, sf), "gr", [5, 20], keys=KEYS), ID, stat_names(5, 20))


@query(
    "d02_rolling_centered",
    f"WITH {SERIES} SELECT user_id, row_idx, {stats_sql('gr', 5, 4, 10)}, {stats_sql('gr', 10, 10, 21)} FROM s",
)
def rolling_centered(spark, sf):
    rows = windows.rolling_stats(series(spark, sf), "gr", [10, 21], center=True, keys=KEYS)
    return show(rows, ID, stat_names(10, 21))


@query("d03_rolling_symmetric", f"WITH {SERIES} SELECT user_id, row_idx, {stats_sql('gr', 5, 5, 10)} FROM s")
def rolling_symmetric(spark, sf):
    rows = windows.rolling_stats(series(spark, sf), "gr", [10], symmetric=True, keys=KEYS)
    return show(rows, ID, stat_names(10))


@query("d04_rolling_median", f"WITH {SERIES} SELECT user_id, row_idx, round(quantile_cont(gr, 0.5) {over(5, 5)}, 6) + 0.0 AS median FROM s")
def rolling_median(spark, sf):
    return show(windows.rolling_median(series(spark, sf), "gr", 11, keys=KEYS), ID, ["median"])


@query(
    "d05_rolling_slope",
    f"""WITH {SERIES}, f AS (SELECT user_id, row_idx, regr_slope(value, md) {over(14, 0)} AS b, count(*) {over(14, 0)} AS c FROM s)
        SELECT user_id, row_idx, round(CASE WHEN c < 2 THEN 0 ELSE b END, 6) + 0.0 AS slope FROM f""",
)
def rolling_slope(spark, sf):
    return show(windows.rolling_slope(series(spark, sf), "value", "md", 15, keys=KEYS), ID, ["slope"])


DIFFS = ["diff_1", "diff_5", "diff2"]


@query(
    "d06_diff",
    f"""WITH {SERIES} SELECT user_id, row_idx, round(coalesce(value - lag(value, 1) OVER w, 0), 6) + 0.0 AS diff_1,
          round(coalesce(value - lag(value, 5) OVER w, 0), 6) + 0.0 AS diff_5,
          round(coalesce(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 0), 6) + 0.0 AS diff2
        FROM s WINDOW w AS ({BY})""",
)
def diff(spark, sf):
    return show(windows.diff(series(spark, sf), "value", [1, 5], keys=KEYS), ID, DIFFS)


SHIFTS = ["lag_1", "lead_1", "lag_5", "lead_5"]


@query(
    "d07_lag_lead",
    f"""WITH {SERIES}, q AS (SELECT user_id, row_idx, {", ".join(f"lag(gr, {k}) OVER w AS a{k}, lead(gr, {k}) OVER w AS b{k}" for k in (1, 5))}
          FROM s WINDOW w AS ({BY}))
        SELECT user_id, row_idx, {", ".join(
        f"first_value(a{k} IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lag_{k}, "
        f"last_value(b{k} IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead_{k}" for k in (1, 5))} FROM q""",
)
def lag_lead(spark, sf):
    return windows.lag_lead(series(spark, sf), "gr", [1, 5], keys=KEYS).select(*ID, *SHIFTS)


WELL_STATS = ["well_mean", "well_std", "well_min", "well_max", "well_skew"]


@query(
    "d08_entity_stats",
    f"""WITH {SERIES}, k AS (SELECT user_id, avg(gr) AS well_mean, stddev_samp(gr) AS well_std, min(gr) AS well_min,
          max(gr) AS well_max, skewness(gr) AS well_skew FROM s GROUP BY 1)
        SELECT user_id, row_idx, {rounded(*WELL_STATS)} FROM s JOIN k USING (user_id)""",
)
def entity_stats(spark, sf):
    return show(windows.entity_stats(series(spark, sf), "gr", keys=KEYS), ID, WELL_STATS)


@query(
    "d09_depth_position",
    f"""WITH {SERIES}, k AS (SELECT user_id, min(md) AS lo, max(md) AS hi FROM s GROUP BY 1)
        SELECT user_id, row_idx, round(md - lo, 6) + 0.0 AS depth_from_start, round((md - lo) / (hi - lo), 6) + 0.0 AS depth_fraction
        FROM s JOIN k USING (user_id)""",
)
def depth_position(spark, sf):
    return show(windows.depth_position(series(spark, sf), keys=KEYS), ID, ["depth_from_start", "depth_fraction"])


@query(
    "d10_envelope_energy",
    f"WITH {SERIES} SELECT user_id, row_idx, max(gr) {over(10, 10)} AS envelope, round(sqrt(avg(gr * gr) {over(10, 10)}), 6) + 0.0 AS energy FROM s",
)
def envelope_energy(spark, sf):
    return show(windows.envelope_energy(series(spark, sf), "gr", 21, keys=KEYS), ID, ["envelope", "energy"])


SIGNATURE = ["sig_mean", "sig_std", "sig_range", "sig_grad", "sig_center"]
SIGNATURE_SQL = f"""
d0 AS (SELECT *, gr - lag(gr) OVER ({BY}) AS st FROM s),
sg AS (SELECT *, CASE WHEN count(gr) {over(7, 7)} >= 5 THEN avg(gr) {over(7, 7)} END AS sig_mean,
         coalesce(CASE WHEN count(gr) {over(7, 7)} >= 5 THEN stddev_samp(gr) {over(7, 7)} END, 0) AS sig_std,
         coalesce(CASE WHEN count(gr) {over(7, 7)} >= 5 THEN max(gr) {over(7, 7)} - min(gr) {over(7, 7)} END, 0) AS sig_range,
         coalesce(CASE WHEN count(st) {over(7, 7)} >= 5 THEN avg(st) {over(7, 7)} END, 0) AS sig_grad, gr AS sig_center FROM d0)"""


@query("d11_window_signature", f"WITH {SERIES}, {SIGNATURE_SQL} SELECT user_id, row_idx, {rounded(*SIGNATURE)} FROM sg")
def window_signature(spark, sf):
    return show(windows.window_signature(series(spark, sf), "gr", 7, keys=KEYS), ID, SIGNATURE)


@query(
    "d12_normalized_cumsum",
    f"""WITH {SERIES} SELECT user_id, row_idx, round(sum(value - 60) OVER ({BY}) / sqrt(row_idx + 1), 6) + 0.0 AS norm_cumsum FROM s""",
)
def normalized_cumsum(spark, sf):
    centred = series(spark, sf).withColumn("centred", F.col("value") - 60)
    return show(windows.normalized_cumsum(centred, "centred", keys=KEYS), ID, ["norm_cumsum"])


RESIDUALS = ["residual_mean_5", "residual_cumsum", "residual_p95"]


@query(
    "d13_residual_stats",
    f"""WITH {SERIES}, q AS (SELECT user_id, row_idx, value - 50 AS res FROM s),
          k AS (SELECT user_id, quantile_cont(abs(res), 0.95) AS residual_p95 FROM q GROUP BY 1)
        SELECT user_id, row_idx, round(avg(res) {over(4, 0)}, 6) + 0.0 AS residual_mean_5,
          round(sum(res) OVER ({BY}) / sqrt(row_idx + 1), 6) + 0.0 AS residual_cumsum, round(residual_p95, 6) + 0.0 AS residual_p95
        FROM q JOIN k USING (user_id)""",
)
def residual_stats(spark, sf):
    rows = series(spark, sf).withColumn("residual", F.col("value") - 50)
    return show(windows.residual_stats(rows, keys=KEYS), ID, RESIDUALS)


AUGMENTED = ["value_m1", "value_p1", "value_m2", "value_p2", "value_grad"]


@query(
    "d14_neighbor_augment",
    f"""WITH {SERIES} SELECT user_id, row_idx, lag(value, 1, 0) OVER w AS value_m1, lead(value, 1, 0) OVER w AS value_p1,
          lag(value, 2, 0) OVER w AS value_m2, lead(value, 2, 0) OVER w AS value_p2,
          round(coalesce((lead(value) OVER w - value) / nullif(lead(md) OVER w - md, 0), 0), 6) + 0.0 AS value_grad FROM s WINDOW w AS ({BY})""",
)
def neighbor_augment(spark, sf):
    return show(windows.neighbor_augment(series(spark, sf), ["value"], 2, keys=KEYS), ID, AUGMENTED)


@query(
    "d15_median_mean_smooth",
    f"""WITH {SERIES}, m AS (SELECT user_id, row_idx, quantile_cont(gr, 0.5) {over(2, 2)} AS md5 FROM s)
        SELECT user_id, row_idx, round(avg(md5) {over(2, 2)}, 6) + 0.0 AS smooth FROM m""",
)
def median_mean_smooth(spark, sf):
    return show(windows.median_mean_smooth(series(spark, sf), "gr", keys=KEYS), ID, ["smooth"])


ENERGY = ["energy_1", "energy_2", "energy_3"]


@query(
    "d16_band_energy",
    f"""WITH {SERIES}, a AS (SELECT user_id, row_idx, x AS a0, avg(x) {over(1, 0)} AS a1, avg(x) {over(2, 1)} AS a2,
          avg(x) {over(4, 3)} AS a3 FROM s),
        b AS (SELECT user_id, row_idx, {", ".join(f"avg((a{j - 1} - a{j}) * (a{j - 1} - a{j})) {over(10, 10)} AS energy_{j}" for j in (1, 2, 3))} FROM a)
        SELECT user_id, row_idx, {rounded(*ENERGY)}, CASE WHEN energy_1 >= energy_2 AND energy_1 >= energy_3 THEN 1::BIGINT
          WHEN energy_2 >= energy_3 THEN 2 ELSE 3 END AS dominant_scale FROM b""",
)
def band_energy(spark, sf):
    return show(windows.band_energy(series(spark, sf), "x", keys=KEYS), [*ID, "dominant_scale"], ENERGY)


@query(
    "d17_distinct_in_range",
    f"""WITH {SERIES}, {REFERENCE} SELECT user_id, row_idx, count(DISTINCT geology) AS distinct_labels
        FROM s LEFT JOIN r ON r.ref_id = s.ref_id AND tvt BETWEEN prior - 2 AND prior + 2 GROUP BY 1, 2""",
)
def distinct_in_range(spark, sf):
    curves = prepare_reference(reference(spark, sf), label="geology", keys=["ref_id"])
    found = windows.distinct_in_range(series(spark, sf), curves, 2.0, "prior", keys=["ref_id"], ids=ID)
    return found.select(*ID, "distinct_labels")


CHAIN = [*stat_names(5, 20), "c_mean_21", "c_std_21", "median", "slope", "diff_1", "diff2"]


@query(
    "d20_window_chain",
    f"""WITH {SERIES}, f AS (SELECT *, regr_slope(value, md) {over(14, 0)} AS b, count(*) {over(14, 0)} AS c FROM s)
        SELECT user_id, row_idx, {stats_sql('value', 4, 0, 5)}, {stats_sql('value', 19, 0, 20)},
          round(avg(value) {over(10, 10)}, 6) + 0.0 AS c_mean_21, round(coalesce(stddev_samp(value) {over(10, 10)}, 0), 6) + 0.0 AS c_std_21,
          round(quantile_cont(value, 0.5) {over(5, 5)}, 6) + 0.0 AS median, round(CASE WHEN c < 2 THEN 0 ELSE b END, 6) + 0.0 AS slope,
          round(coalesce(value - lag(value) OVER ({BY}), 0), 6) + 0.0 AS diff_1,
          round(coalesce(value - 2 * lag(value) OVER ({BY}) + lag(value, 2) OVER ({BY}), 0), 6) + 0.0 AS diff2 FROM f""",
)
def window_chain(spark, sf):
    """Rolling, median, slope and difference features together: one exchange for all of them."""
    frames = [
        *windows.rolling_frame("value", [5, 20]),
        *windows.rolling_frame("value", [21], ["mean", "std"], center=True, prefix="c_"),
        windows.median_frame("value", 11),
        windows.slope_frame("value", "md", 15),
        windows.diff_frame("value", [1], second="diff2"),
    ]
    return show(apply_frames(series(spark, sf), KEYS, frames), ID, CHAIN)
