"""Queries for profiles."""

from pyspark.sql import functions as F

from strataline.operators import profile
from strataline.plans.fixtures import ID, KEYS, SERIES, rounded, series, show, table
from strataline.plans.geometry import STEPS
from strataline.plans.registry import query
from strataline.plans.windows import BY

NUMBERS = ["mean", "std", "min", "max", "p01", "p05", "p25", "p50", "p75", "p95", "p99"]


def summary_sql(column, source, shares=(1, 5, 25, 50, 75, 95, 99)):
    c = column
    parts = ", ".join(f"quantile_cont({c}, {p / 100}) AS p{p:02d}" for p in shares)
    return f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, {parts} FROM {source}"


@query(
    "p01_numeric_summary",
    f"""WITH {SERIES}, o AS ({" UNION ALL ".join(summary_sql(c, "s") for c in ("md", "gr", "z", "tvt_input"))}) SELECT "column", "count", missing, {rounded(*NUMBERS)} FROM o""",
)
def numeric_summary(spark, sf):
    return show(profile.numeric_summary(series(spark, sf), ["md", "gr", "z", "tvt_input"]), ["column", "count", "missing"], NUMBERS)


@query(
    "p02_missing_summary",
    f"""WITH {SERIES}, o AS (SELECT 'gr' AS "column", count(*) - count(gr) AS missing, count(*) AS n FROM s UNION ALL SELECT 'tvt_input', count(*) - count(tvt_input), count(*) FROM s
        UNION ALL SELECT 'absent', count(*), count(*) FROM s) SELECT "column", missing, round(missing::DOUBLE / n, 6) + 0.0 AS share FROM o""",
)
def missing_summary(spark, sf):
    return show(profile.missing_summary(series(spark, sf), ["gr", "tvt_input", "absent"]), ["column", "missing"], ["share"])


ENTITY = [f"{c}_{k}" for c in ("gr", "value", "md") for k in ("min", "max", "mean", "std", "range")]


@query(
    "p03_entity_summary",
    f"""WITH {SERIES}, o AS (SELECT user_id, count(*) AS rows, {", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, max({c}) - min({c}) AS {c}_range" for c in ("gr", "value", "md"))} FROM s GROUP BY 1)
        SELECT user_id, rows, {rounded(*ENTITY)} FROM o""",
)
def entity_summary(spark, sf):
    return show(profile.entity_summary(series(spark, sf), ["gr", "value", "md"], KEYS), [*KEYS, "rows"], ENTITY)


SUMMARY_SQL = """
su AS (SELECT user_id, count(*) AS rows, avg(gr) AS gr_mean, stddev_samp(gr) AS gr_std, max(md) - min(md) AS md_range FROM s GROUP BY 1)"""


def summary(spark, sf):
    return profile.entity_summary(series(spark, sf), ["gr", "md"], KEYS)


@query(
    "p04_outlier_entities",
    f"""WITH {SERIES}, {SUMMARY_SQL}, z AS (SELECT user_id, rows, {", ".join(f"abs(({m} - avg({m}) OVER ()) / stddev_samp({m}) OVER ()) AS z{i}" for i, m in enumerate(["rows", "gr_mean", "gr_std", "md_range"]))} FROM su)
        SELECT user_id, rows, round(greatest(z0, z1, z2, z3), 6) + 0.0 AS outlier_score FROM z ORDER BY greatest(z0, z1, z2, z3) DESC, user_id LIMIT 10""",
)
def outlier_entities(spark, sf):
    found = profile.outlier_entities(summary(spark, sf), ["rows", "gr_mean", "gr_std", "md_range"], 10, KEYS)
    return show(found, [*KEYS, "rows"], ["outlier_score"])


@query(
    "p05_representative_entities",
    f"""WITH {SERIES}, {SUMMARY_SQL}, r AS (SELECT user_id, rows, row_number() OVER (ORDER BY rows, user_id) - 1 AS p, count(*) OVER () AS n FROM su)
        SELECT CASE WHEN p = 0 THEN 'shortest' WHEN p = n // 2 THEN 'median' ELSE 'longest' END AS role, user_id, rows FROM r WHERE p IN (0, n // 2, n - 1)""",
)
def representative_entities(spark, sf):
    return profile.representative_entities(summary(spark, sf), keys=KEYS)


DRIFT = ["left_mean", "left_std", "right_mean", "right_std", "mean_delta"]


@query(
    "p06_drift_report",
    f"""WITH {SERIES}, o AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg({c}) FILTER (NOT is_eval) AS left_mean, stddev_samp({c}) FILTER (NOT is_eval) AS left_std, avg({c}) FILTER (is_eval) AS right_mean, stddev_samp({c}) FILTER (is_eval) AS right_std, avg({c}) FILTER (is_eval) - avg({c}) FILTER (NOT is_eval) AS mean_delta FROM s"
        for c in ("md", "gr", "z"))}) SELECT "column", {rounded(*DRIFT)} FROM o""",
)
def drift_report(spark, sf):
    rows = series(spark, sf)
    known, tail = rows.where(F.col("tvt_input").isNotNull()), rows.where(F.col("tvt_input").isNull())
    return show(profile.drift_report(known, tail, ["md", "gr", "z"]), ["column"], DRIFT)


@query(
    "p07_safe_corr",
    f"""WITH {SERIES} SELECT 'gr' AS "left", 'value' AS "right", count(gr) AS rows, round(corr(gr, value), 6) + 0.0 AS corr FROM s WHERE gr IS NOT NULL
        UNION ALL SELECT 'z', 'value', count(*), round(corr(z, value), 6) + 0.0 FROM s UNION ALL SELECT 'z', 'flat', count(*), NULL FROM s""",
)
def safe_corr(spark, sf):
    rows = series(spark, sf).withColumn("flat", F.lit(1.0))
    return show(profile.safe_corr(rows, [("gr", "value"), ("z", "value"), ("z", "flat")]), ["left", "right", "rows"], ["corr"])


SHARES = ["missing_all", "missing_prefix", "missing_tail"]


@query(
    "p08_log_quality",
    f"""WITH {SERIES}, g AS (SELECT *, row_idx - row_number() OVER (PARTITION BY user_id, gr IS NULL ORDER BY row_idx) AS ga,
          row_idx - row_number() OVER (PARTITION BY user_id, is_eval, gr IS NULL ORDER BY row_idx) AS gz FROM s),
        ra AS (SELECT user_id, max(c) AS m FROM (SELECT user_id, ga, count(*) AS c FROM g WHERE gr IS NULL GROUP BY 1, 2) GROUP BY 1),
        rz AS (SELECT user_id, max(c) FILTER (NOT is_eval) AS mp, max(c) FILTER (is_eval) AS mt FROM (SELECT user_id, is_eval, gz, count(*) AS c FROM g WHERE gr IS NULL GROUP BY 1, 2, 3) GROUP BY 1),
        o AS (SELECT user_id, count(*) AS rows, count(*) FILTER (NOT is_eval) AS prefix_rows, 1 - count(gr)::DOUBLE / count(*) AS missing_all,
          1 - count(gr) FILTER (NOT is_eval)::DOUBLE / count(*) FILTER (NOT is_eval) AS missing_prefix, 1 - count(gr) FILTER (is_eval)::DOUBLE / count(*) FILTER (is_eval) AS missing_tail FROM s GROUP BY 1)
        SELECT o.user_id, rows, prefix_rows, coalesce(m, 0) AS longest_all, coalesce(mp, 0) AS longest_prefix, coalesce(mt, 0) AS longest_tail, {rounded(*SHARES)} FROM o LEFT JOIN ra USING (user_id) LEFT JOIN rz USING (user_id)""",
)
def log_quality(spark, sf):
    ids = [*KEYS, "rows", "prefix_rows", "longest_all", "longest_prefix", "longest_tail"]
    return show(profile.log_quality(series(spark, sf), keys=KEYS), ids, SHARES)


SERIES_VALUES = ["md_span", "xy_span", "z_delta", "heading", "last_known", "log_missing", "baseline_rmse", "median_abs_step"]


@query(
    "p09_series_summary",
    f"""WITH {SERIES}, st AS (SELECT user_id, quantile_cont(a, 0.5) AS median_abs_step FROM (SELECT user_id, abs(value - lag(value) OVER ({BY})) AS a FROM s) GROUP BY 1),
        k AS (SELECT user_id, arg_max(value, row_idx) AS av FROM s WHERE NOT is_eval GROUP BY 1),
        o AS (SELECT s.user_id, count(*) AS n_rows, count(tvt_input) AS known_rows, count(*) FILTER (is_eval) AS tail_rows, max(av) AS last_known, 1 - count(gr)::DOUBLE / count(*) AS log_missing,
          sqrt(avg(pow(value - av, 2)) FILTER (is_eval)) AS baseline_rmse, arg_max(md, row_idx) - arg_min(md, row_idx) AS md_span,
          sqrt(pow(arg_max(x, row_idx) - arg_min(x, row_idx), 2) + pow(arg_max(y, row_idx) - arg_min(y, row_idx), 2)) AS xy_span, arg_max(z, row_idx) - arg_min(z, row_idx) AS z_delta,
          (degrees(atan2(arg_max(x, row_idx) - arg_min(x, row_idx), arg_max(y, row_idx) - arg_min(y, row_idx))) + 360) % 360 AS heading FROM s JOIN k USING (user_id) GROUP BY 1)
        SELECT user_id, n_rows, known_rows, tail_rows, {rounded(*SERIES_VALUES)} FROM o JOIN st USING (user_id)""",
)
def series_summary(spark, sf):
    found = profile.series_summary(series(spark, sf), "value", keys=KEYS)
    return show(found, [*KEYS, "n_rows", "known_rows", "tail_rows"], SERIES_VALUES)


STEP = ["mean", "std", "min", "max", "p05", "p50", "p95"]


@query(
    "p10_step_summary",
    f"""WITH {SERIES}, {STEPS}, q AS (SELECT step_length, step_length / nullif(md_step, 0) AS step_ratio FROM sl WHERE row_idx > 0),
        o AS ({" UNION ALL ".join(summary_sql(c, "q", (5, 50, 95)) for c in ("step_length", "step_ratio"))}) SELECT "column", "count", missing, {rounded(*STEP, digits=5)} FROM o""",
)
def step_summary(spark, sf):
    return show(profile.step_summary(series(spark, sf), keys=KEYS), ["column", "count", "missing"], STEP, 5)


@query(
    "p11_bounded_sample",
    "SELECT event_id, value FROM events ORDER BY md5(concat_ws('|', event_id, 42)), event_id LIMIT 500",
)
def bounded_sample(spark, sf):
    return profile.bounded_sample(table(spark, sf, "events").select("event_id", "value"), 500, ["event_id"])
