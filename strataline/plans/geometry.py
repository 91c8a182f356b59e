"""Queries for trajectory geometry."""

from strataline.operators import geometry
from strataline.plans.fixtures import ID, KEYS, SERIES, rounded, series, show
from strataline.plans.registry import query
from strataline.plans.windows import BY, over

STEPS = f"""
st AS (SELECT *, coalesce(md - lag(md) OVER w, 0) AS md_step, coalesce(x - lag(x) OVER w, 0) AS x_step,
         coalesce(y - lag(y) OVER w, 0) AS y_step, coalesce(z - lag(z) OVER w, 0) AS z_step FROM s WINDOW w AS ({BY})),
sl AS (SELECT *, sqrt(x_step * x_step + y_step * y_step) AS xy_step,
         sqrt(x_step * x_step + y_step * y_step + z_step * z_step) AS step_length FROM st)"""


def outer(ctes, source, names, digits=6):
    return f"WITH {SERIES}, {ctes} SELECT user_id, row_idx, {rounded(*names, digits=digits)} FROM {source}"


STEP = ["md_step", "x_step", "y_step", "z_step", "xy_step", "step_length"]


@query("e01_step_features", outer(STEPS, "sl", STEP))
def step_features(spark, sf):
    return show(geometry.step_features(series(spark, sf), keys=KEYS), ID, STEP)


RATIO = ["step_ratio", "step_ratio_mean", "z_gradient_mean"]


@query(
    "e02_dls_ratio",
    outer(
        STEPS + """, g AS (SELECT *, coalesce(step_length / nullif(abs(md_step), 0), 0) AS step_ratio,
            coalesce(z_step / nullif(abs(md_step), 0), 0) AS gr0 FROM sl),
        h AS (SELECT user_id, row_idx, step_ratio, avg(step_ratio) """ + over(29, 0) + """ AS step_ratio_mean,
            avg(gr0) """ + over(29, 0) + """ AS z_gradient_mean FROM g)""",
        "h",
        RATIO,
    ),
)
def dls_ratio(spark, sf):
    return show(geometry.dls_ratio(series(spark, sf), keys=KEYS), ID, RATIO)


LATERAL = ["lateral_distance", "straight_distance", "below_start"]


@query(
    "e03_lateral_distance",
    outer(
        STEPS + f""", g AS (SELECT user_id, row_idx, sum(xy_step) OVER w AS lateral_distance,
            sqrt((x - first(x) OVER w) * (x - first(x) OVER w) + (y - first(y) OVER w) * (y - first(y) OVER w)) AS straight_distance,
            first(z) OVER w - z AS below_start FROM sl WINDOW w AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        "g",
        LATERAL,
        4,
    ),
)
def lateral_distance(spark, sf):
    return show(geometry.lateral_distance(series(spark, sf), keys=KEYS), ID, LATERAL, 4)


@query(
    "e04_z_curvature",
    outer(
        f"""m AS (SELECT user_id, row_idx, avg(z) {over(15, 14)} AS a FROM s),
        g AS (SELECT user_id, row_idx, coalesce(a - 2 * lag(a) OVER w + lag(a, 2) OVER w, 0) AS z_curvature FROM m WINDOW w AS ({BY}))""",
        "g",
        ["z_curvature"],
    ),
)
def z_curvature(spark, sf):
    return show(geometry.z_curvature(series(spark, sf), keys=KEYS), ID, ["z_curvature"])


ANGLES = ["inclination", "azimuth"]
ANGLE_SQL = STEPS + ", an AS (SELECT *, atan2(xy_step, z_step) AS inclination, atan2(y_step, x_step) AS azimuth FROM sl)"


@query("e05_incl_azimuth", outer(ANGLE_SQL, "an", ANGLES))
def incl_azimuth(spark, sf):
    return show(geometry.incl_azimuth(series(spark, sf), keys=KEYS), ID, ANGLES)


@query(
    "e06_dogleg_simple",
    outer(
        ANGLE_SQL + f""", g AS (SELECT user_id, row_idx, sqrt(pow(coalesce(inclination - lag(inclination) OVER w, 0), 2)
            + pow(coalesce(azimuth - lag(azimuth) OVER w, 0), 2)) AS dls, coalesce(z - lag(z) OVER w, 0) AS tvd_gradient
            FROM an WINDOW w AS ({BY}))""",
        "g",
        ["dls", "tvd_gradient"],
    ),
)
def dogleg_simple(spark, sf):
    angles = geometry.incl_azimuth(series(spark, sf), keys=KEYS)
    return show(geometry.dogleg_simple(angles, keys=KEYS), ID, ["dls", "tvd_gradient"])


@query(
    "e07_dogleg_angle",
    f"""WITH {SERIES}, {STEPS}, u AS (SELECT user_id, row_idx, eval_start, x_step / (step_length + 1e-9) AS a, y_step / (step_length + 1e-9) AS b,
          z_step / (step_length + 1e-9) AS c FROM sl),
        g AS (SELECT user_id, row_idx, eval_start, CASE WHEN row_idx < 2 THEN 0 ELSE degrees(acos(least(greatest(
            a * lag(a) OVER w + b * lag(b) OVER w + c * lag(c) OVER w, -1), 1))) END AS dogleg FROM u WINDOW w AS ({BY})),
        k AS (SELECT user_id, quantile_cont(dogleg, 0.95) AS dogleg_p95 FROM g WHERE row_idx < eval_start AND row_idx >= eval_start - 20 GROUP BY 1)
        SELECT user_id, row_idx, round(dogleg, 4) + 0.0 AS dogleg, round(dogleg_p95, 4) + 0.0 AS dogleg_p95 FROM g JOIN k USING (user_id)""",
)
def dogleg_angle(spark, sf):
    from pyspark.sql import functions as F

    found = geometry.dogleg_angle(series(spark, sf), context=20, keys=KEYS)
    return found.select(*ID, *[(F.round(c, 4) + 0.0).alias(c) for c in ("dogleg", "dogleg_p95")])


@query(
    "e08_local_slope",
    outer(
        f"g AS (SELECT user_id, row_idx, CASE WHEN row_idx < 5 OR row_idx >= n - 5 THEN 0 ELSE regr_slope(z, md) {over(5, 5)} END AS local_slope FROM s)",
        "g",
        ["local_slope"],
    ),
)
def local_slope(spark, sf):
    return show(geometry.local_slope(series(spark, sf), keys=KEYS), ID, ["local_slope"])


@query(
    "e09_jerk",
    outer(
        f"""g AS (SELECT *, coalesce((z - lag(z) OVER w) / greatest(md - lag(md) OVER w, 1e-9), 0) AS dz,
            greatest(md - lag(md) OVER w, 1e-9) AS run FROM s WINDOW w AS ({BY})),
        h AS (SELECT user_id, row_idx, coalesce((dz - lag(dz) OVER w) / run, 0) AS jerk FROM g WINDOW w AS ({BY})),
        i AS (SELECT *, avg(jerk) {over(2, 2)} AS jerk_mean FROM h)""",
        "i",
        ["jerk", "jerk_mean"],
    ),
)
def jerk(spark, sf):
    return show(geometry.jerk(series(spark, sf), keys=KEYS), ID, ["jerk", "jerk_mean"])


def tortuosity_sql(w):
    o = f"OVER ({BY} ROWS BETWEEN {w} PRECEDING AND CURRENT ROW)"
    chord = " + ".join(f"({c} - first({c}) {o}) * ({c} - first({c}) {o})" for c in "xyz")
    return f"greatest(sum(step_length) {over(w - 1, 0)} / (sqrt({chord}) + 1e-6) - 1, 0) AS tortuosity_{w}"


TORT = ["tortuosity_10", "tortuosity_25", "tortuosity_10_slope"]


@query(
    "e10_tortuosity",
    outer(
        STEPS + f""", g AS (SELECT user_id, row_idx, {tortuosity_sql(10)}, {tortuosity_sql(25)} FROM sl),
        h AS (SELECT *, tortuosity_10 - lag(tortuosity_10) OVER ({BY}) AS ch FROM g),
        i AS (SELECT *, coalesce(avg(ch) {over(15, 15)}, 0) AS tortuosity_10_slope FROM h)""",
        "i",
        TORT,
    ),
)
def tortuosity(spark, sf):
    return show(geometry.tortuosity(series(spark, sf), (10, 25), keys=KEYS), ID, TORT)


TURN = ["direction_change", "direction_change_mean"]


@query(
    "e11_direction_change",
    outer(
        f"""c AS (SELECT user_id, row_idx, {", ".join(
            f"last({c}) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) - first({c}) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS {c}1"
            for c in "xyz")}, coalesce((lead(md) OVER w - lag(md) OVER w) / 2, lead(md) OVER w - md, md - lag(md) OVER w) AS run FROM s WINDOW w AS ({BY})),
        d AS (SELECT *, lag(x1) OVER w AS x0, lag(y1) OVER w AS y0, lag(z1) OVER w AS z0 FROM c WINDOW w AS ({BY})),
        g AS (SELECT user_id, row_idx, coalesce(atan2(sqrt(pow(y0 * z1 - z0 * y1, 2) + pow(z0 * x1 - x0 * z1, 2) + pow(x0 * y1 - y0 * x1, 2)),
            x0 * x1 + y0 * y1 + z0 * z1), 0) / (abs(run) + 1e-6) AS direction_change FROM d),
        i AS (SELECT *, avg(direction_change) {over(15, 15)} AS direction_change_mean FROM g)""",
        "i",
        TURN,
    ),
)
def direction_change(spark, sf):
    return show(geometry.direction_change(series(spark, sf), keys=KEYS), ID, TURN)


SUMMARY = ["md_span", "xy_span", "z_delta", "heading", "gradient_median", "gradient_p95", "curvature_median", "curvature_p95"]
GRADIENTS = f"""
gr1 AS (SELECT *, md < lag(md) OVER w AS back, {", ".join(
    f"({c} - lag({c}) OVER w) / nullif(md - lag(md) OVER w, 0) AS g{c}" for c in "xyz")} FROM s WINDOW w AS ({BY})),
gr2 AS (SELECT *, sqrt({" + ".join(f"pow(g{c} - lag(g{c}) OVER w, 2)" for c in "xyz")}) AS curve FROM gr1 WINDOW w AS ({BY}))"""


@query(
    "e12_path_summary",
    f"""WITH {SERIES}, {GRADIENTS}, o AS (SELECT user_id, count(*) AS n_rows, NOT coalesce(bool_or(back), FALSE) AS md_monotonic,
          arg_max(md, row_idx) - arg_min(md, row_idx) AS md_span,
          sqrt(pow(arg_max(x, row_idx) - arg_min(x, row_idx), 2) + pow(arg_max(y, row_idx) - arg_min(y, row_idx), 2)) AS xy_span,
          arg_max(z, row_idx) - arg_min(z, row_idx) AS z_delta,
          (degrees(atan2(arg_max(x, row_idx) - arg_min(x, row_idx), arg_max(y, row_idx) - arg_min(y, row_idx))) + 360) % 360 AS heading,
          quantile_cont(gz, 0.5) AS gradient_median, quantile_cont(abs(gz), 0.95) AS gradient_p95,
          quantile_cont(curve, 0.5) AS curvature_median, quantile_cont(curve, 0.95) AS curvature_p95 FROM gr2 GROUP BY 1)
        SELECT user_id, n_rows, md_monotonic, {rounded(*SUMMARY)} FROM o""",
)
def path_summary(spark, sf):
    return show(geometry.path_summary(series(spark, sf), keys=KEYS), [*KEYS, "n_rows", "md_monotonic"], SUMMARY)


DERIVATIVES = ["dx_dmd", "dy_dmd", "dz_dmd", "dip_proxy", "dip_change"]


@query(
    "e13_per_depth_derivatives",
    f"""WITH {SERIES}, {GRADIENTS}, o AS (SELECT user_id, row_idx, gx AS dx_dmd, gy AS dy_dmd, gz AS dz_dmd, coalesce(gz, 0) AS dip_proxy,
          coalesce(coalesce(gz, 0) - lag(coalesce(gz, 0)) OVER ({BY}), 0) AS dip_change FROM gr1)
        SELECT user_id, row_idx, {rounded(*DERIVATIVES)} FROM o""",
)
def per_depth_derivatives(spark, sf):
    return show(geometry.per_depth_derivatives(series(spark, sf), keys=KEYS), ID, DERIVATIVES)
