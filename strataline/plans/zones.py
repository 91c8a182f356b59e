"""Queries for prefix, tail and anchor operators."""

from strataline.operators import zones
from strataline.plans.fixtures import ID, KEYS, REFERENCE, SERIES, reference, rounded, series, show
from strataline.plans.registry import query

ANCHOR = """
k AS (SELECT user_id, arg_max(value, row_idx) AS av, arg_max(md, row_idx) AS amd, arg_max(x, row_idx) AS ax,
        arg_max(y, row_idx) AS ay, arg_max(z, row_idx) AS az, count(*) AS n_known
      FROM s WHERE tvt_input IS NOT NULL GROUP BY 1)"""


@query("b01_split_zone", f"WITH {SERIES} SELECT user_id, row_idx, eval_start, NOT is_eval AS in_prefix, is_eval FROM s")
def split_zone(spark, sf):
    return zones.split_zone(series(spark, sf), keys=KEYS).select(*ID, "eval_start", "in_prefix", "is_eval")


@query(
    "b02_zone_info",
    f"""WITH {SERIES}, f AS (SELECT *, gr IS NULL AS m,
          lag(gr IS NULL, 1, FALSE) OVER (PARTITION BY user_id ORDER BY row_idx) AS pm FROM s)
        SELECT user_id, count(*) AS n_rows, count(gr) AS known_rows,
          CAST(sum(m::INT) AS BIGINT) AS eval_rows, min(row_idx) FILTER (m) AS first_eval,
          max(row_idx) FILTER (m) AS last_eval, CAST(sum((m AND NOT pm)::INT) AS BIGINT) AS null_blocks
        FROM f GROUP BY 1""",
)
def zone_info(spark, sf):
    return zones.zone_info(series(spark, sf), "gr", keys=KEYS)


@query(
    "b03_longest_null_run",
    f"""WITH {SERIES}, g AS (SELECT *, row_idx - row_number() OVER (PARTITION BY user_id, gr IS NULL ORDER BY row_idx) AS ga,
          row_idx - row_number() OVER (PARTITION BY user_id, is_eval, gr IS NULL ORDER BY row_idx) AS gz FROM s),
        ra AS (SELECT user_id, ga, count(*) AS n FROM g WHERE gr IS NULL GROUP BY 1, 2),
        rz AS (SELECT user_id, is_eval, gz, count(*) AS n FROM g WHERE gr IS NULL GROUP BY 1, 2, 3)
        SELECT u.user_id, coalesce((SELECT max(n) FROM ra WHERE ra.user_id = u.user_id), 0) AS longest_all,
          coalesce((SELECT max(n) FROM rz WHERE rz.user_id = u.user_id AND NOT is_eval), 0) AS longest_prefix,
          coalesce((SELECT max(n) FROM rz WHERE rz.user_id = u.user_id AND is_eval), 0) AS longest_tail
        FROM (SELECT DISTINCT user_id FROM s) u""",
)
def longest_null_run(spark, sf):
    return zones.longest_null_run(series(spark, sf), "gr", keys=KEYS)


OFFSETS = ["anchor_value", "delta_md", "delta_x", "delta_y", "delta_z", "delta_xy"]


@query(
    "b04_anchor_offsets",
    f"""WITH {SERIES}, {ANCHOR}, o AS (SELECT s.user_id, row_idx, av AS anchor_value, md - amd AS delta_md, x - ax AS delta_x,
          y - ay AS delta_y, z - az AS delta_z, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS delta_xy
        FROM s JOIN k USING (user_id)) SELECT user_id, row_idx, {rounded(*OFFSETS)} FROM o""",
)
def anchor_offsets(spark, sf):
    return show(zones.anchor_offsets(series(spark, sf), keys=KEYS), ID, OFFSETS)


CARRIED = ["last_known_value", "last_known_md", "dist_from_known"]


@query(
    "b05_carry_last_known",
    f"""WITH {SERIES}, c AS (SELECT user_id, row_idx, md, last_value(gr IGNORE NULLS) OVER w AS last_known_value,
          last_value(CASE WHEN gr IS NOT NULL THEN md END IGNORE NULLS) OVER w AS last_known_md FROM s
        WINDOW w AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        o AS (SELECT *, md - last_known_md AS dist_from_known FROM c) SELECT user_id, row_idx, {rounded(*CARRIED)} FROM o""",
)
def carry_last_known(spark, sf):
    return show(zones.carry_last_known(series(spark, sf), "gr", keys=KEYS), ID, CARRIED)


LINE = ["prefix_slope", "prefix_intercept", "extrapolated"]


@query(
    "b06_prefix_linear_fit",
    f"""WITH {SERIES}, f AS (SELECT user_id, count(tvt_input) AS n_known, coalesce(regr_slope(tvt_input, md), 0) AS b,
          avg(tvt_input) AS my, avg(md) FILTER (tvt_input IS NOT NULL) AS mx FROM s GROUP BY 1),
        o AS (SELECT user_id, row_idx, n_known, b AS prefix_slope, my - b * mx AS prefix_intercept,
          b * md + my - b * mx AS extrapolated FROM s JOIN f USING (user_id))
        SELECT user_id, row_idx, n_known, {rounded(*LINE)} FROM o""",
)
def prefix_linear_fit(spark, sf):
    return show(zones.prefix_linear_fit(series(spark, sf), keys=KEYS), [*ID, "n_known"], LINE)


@query(
    "b07_recent_slope",
    f"""WITH {SERIES} SELECT user_id, round(regr_slope(tvt_input, md), 6) + 0.0 AS recent_slope FROM s
        WHERE row_idx < eval_start AND row_idx >= eval_start - 20 GROUP BY 1""",
)
def recent_slope(spark, sf):
    return show(zones.recent_slope(series(spark, sf), 20, keys=KEYS), KEYS, ["recent_slope"])


@query(
    "b08_recent_mean_diff",
    f"""WITH {SERIES} SELECT user_id, round((arg_max(value, row_idx) - arg_min(value, row_idx)) / (count(*) - 1), 6) + 0.0
          AS recent_mean_diff FROM s WHERE row_idx < eval_start AND row_idx >= eval_start - 11 GROUP BY 1""",
)
def recent_mean_diff(spark, sf):
    return show(zones.recent_mean_diff(series(spark, sf), 10, keys=KEYS), KEYS, ["recent_mean_diff"])


CONTEXT = [f"ctx_{m}_{w}" for w in (10, 30) for m in ("mean", "std", "slope")]


@query(
    "b09_context_stats",
    f"""WITH {SERIES} SELECT user_id, arg_max(value, row_idx) AS anchor_value, {", ".join(
        f"round(avg(value) FILTER (row_idx >= eval_start - {w}), 6) + 0.0 AS ctx_mean_{w}, "
        f"round(stddev_pop(value) FILTER (row_idx >= eval_start - {w}), 6) + 0.0 AS ctx_std_{w}, "
        f"round(regr_slope(value, md) FILTER (row_idx >= eval_start - {w}), 6) + 0.0 AS ctx_slope_{w}" for w in (10, 30))}
        FROM s WHERE row_idx < eval_start GROUP BY 1""",
)
def context_stats(spark, sf):
    return show(zones.context_stats(series(spark, sf), (10, 30), keys=KEYS), KEYS, ["anchor_value", *CONTEXT])


@query(
    "b10_endpoint_slopes",
    f"""WITH {SERIES}, p AS (SELECT user_id, arg_max(value, row_idx) AS v1, arg_max(md, row_idx) AS m1,
          arg_min(value, row_idx) AS v0, arg_min(md, row_idx) AS m0,
          max(value) FILTER (row_idx = eval_start - 10) AS vr, max(md) FILTER (row_idx = eval_start - 10) AS mr
        FROM s WHERE row_idx < eval_start GROUP BY 1),
        o AS (SELECT user_id, (v1 - v0) / (m1 - m0) AS slope_all, coalesce((v1 - vr) / (m1 - mr), (v1 - v0) / (m1 - m0)) AS slope_recent FROM p)
        SELECT user_id, {rounded("slope_all", "slope_recent")} FROM o""",
)
def endpoint_slopes(spark, sf):
    return show(zones.endpoint_slopes(series(spark, sf), keys=KEYS), KEYS, ["slope_all", "slope_recent"])


PLANE = ["plane_a", "plane_b", "plane_c", "plane_value", "plane_minus_anchor", "plane_distance", "plane_std", "plane_p95"]


@query(
    "b11_plane_prior",
    f"""WITH {SERIES}, q AS (SELECT *, z + sin(row_idx) AS d FROM s), m AS (SELECT user_id, avg(md) AS am, avg(d) AS ad, avg(value) AS ta,
          var_pop(md) AS mm, var_pop(d) AS zz, covar_pop(md, d) AS mz, covar_pop(md, value) AS mt, covar_pop(d, value) AS zt,
          arg_max(value, row_idx) AS lastv FROM q WHERE row_idx < eval_start GROUP BY 1),
        c AS (SELECT *, (mt * zz - zt * mz) / (mm * zz - mz * mz) AS plane_a, (zt * mm - mt * mz) / (mm * zz - mz * mz) AS plane_b FROM m),
        f AS (SELECT q.user_id, row_idx, tvt_input, plane_a, plane_b, ta - plane_a * am - plane_b * ad AS plane_c,
          plane_a * md + plane_b * d + ta - plane_a * am - plane_b * ad AS plane_value, lastv,
          sqrt((md - am) * (md - am) + (d - ad) * (d - ad)) AS plane_distance FROM q JOIN c USING (user_id)),
        e2 AS (SELECT user_id, stddev_pop(tvt_input - plane_value) AS plane_std,
          quantile_cont(abs(tvt_input - plane_value), 0.95) AS plane_p95 FROM f WHERE tvt_input IS NOT NULL GROUP BY 1),
        o AS (SELECT *, plane_value - lastv AS plane_minus_anchor FROM f JOIN e2 USING (user_id))
        SELECT user_id, row_idx, {rounded(*PLANE)} FROM o""",
)
def plane_prior(spark, sf):
    from pyspark.sql import functions as F

    bent = series(spark, sf).withColumn("d", F.col("z") + F.sin(F.col("row_idx").cast("double")))
    return show(zones.plane_prior(bent, z="d", keys=KEYS), ID, PLANE)


PLACE = ["frac", "frac2", "sqrt_frac", "delta_md", "row_frac", "log1p_delta_md"]


@query(
    "b12_positional",
    f"""WITH {SERIES}, k AS (SELECT user_id, max(md) AS amd FROM s WHERE NOT is_eval GROUP BY 1),
        o AS (SELECT s.user_id, row_idx, CAST(row_idx = eval_start AS INT) AS is_first,
          (row_idx - eval_start)::DOUBLE / greatest(n - eval_start - 1, 1) AS frac, frac * frac AS frac2, sqrt(frac) AS sqrt_frac,
          md - amd AS delta_md, row_idx::DOUBLE / greatest(n - 1, 1) AS row_frac, ln(1 + md - amd) AS log1p_delta_md
        FROM s JOIN k USING (user_id) WHERE is_eval) SELECT user_id, row_idx, is_first, {rounded(*PLACE)} FROM o""",
)
def positional(spark, sf):
    return show(zones.positional(series(spark, sf), keys=KEYS), [*ID, "is_first"], PLACE)


@query(
    "b13_entity_meta",
    f"""WITH {SERIES}, {REFERENCE}, c AS (SELECT ref_id, count(*) AS ref_rows, max(tvt) - min(tvt) AS ref_span FROM r GROUP BY 1),
        m AS (SELECT user_id, min(ref_id) AS ref_id, count(*) AS n_rows, count(tvt_input) AS known_len,
          count(*) - count(tvt_input) AS eval_len, 1 - count(tvt_input)::DOUBLE / count(*) AS eval_share,
          1 - count(gr)::DOUBLE / count(*) AS log_null_share FROM s GROUP BY 1)
        SELECT user_id, n_rows, known_len, eval_len, coalesce(ref_rows, 0) AS ref_rows, {rounded("eval_share", "log_null_share")},
          round(coalesce(ref_span, 0), 6) + 0.0 AS ref_span FROM m LEFT JOIN c USING (ref_id)""",
)
def entity_meta(spark, sf):
    from strataline.operators.align import prepare_reference

    curves = prepare_reference(reference(spark, sf), keys=["ref_id"])
    meta = zones.entity_meta(series(spark, sf), curves, keys=KEYS, ref_keys=["ref_id"])
    return show(
        meta,
        ["user_id", "n_rows", "known_len", "eval_len", "ref_rows"],
        ["eval_share", "log_null_share", "ref_span"],
    )


KNOTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
KNOT_NAMES = [f"knot_{round(k * 100):03d}" for k in KNOTS]


@query(
    "b14_knot_targets",
    f"""WITH {SERIES}, {ANCHOR}, t AS (SELECT s.user_id, row_idx - eval_start AS i, n - eval_start - 1 AS span, value - av AS d, av
          FROM s JOIN k USING (user_id) WHERE is_eval)
        SELECT user_id, count(*) AS tail_len, max(av) AS last_known, round(min(d), 6) + 0.0 AS tail_min, round(max(d), 6) + 0.0 AS tail_max,
          round(arg_max(d, i), 6) + 0.0 AS tail_end, {", ".join(
        f"round(sum(CASE WHEN i = floor({k}::DOUBLE * span) THEN d * (1 - ({k}::DOUBLE * span - floor({k}::DOUBLE * span))) "
        f"WHEN i = floor({k}::DOUBLE * span) + 1 THEN d * ({k}::DOUBLE * span - floor({k}::DOUBLE * span)) END), 6) + 0.0 AS {name}"
        for k, name in zip(KNOTS, KNOT_NAMES))}
        FROM t GROUP BY 1""",
)
def knot_targets(spark, sf):
    knots = zones.knot_targets(series(spark, sf), KNOTS, "value", keys=KEYS)
    return show(knots, [*KEYS, "tail_len"], ["last_known", "tail_min", "tail_max", "tail_end", *KNOT_NAMES])


@query(
    "b15_truncate_prefix",
    f"""WITH {SERIES}, c AS (SELECT DISTINCT user_id, CAST(floor(10.0::DOUBLE + j * ((eval_start - 12) / 2.0::DOUBLE)) AS BIGINT) AS cut
          FROM s, range(3) t(j) WHERE eval_start >= 15)
        SELECT s.user_id, row_idx, cut, CASE WHEN row_idx < cut THEN tvt_input END AS masked, row_idx >= cut AS is_label
        FROM s JOIN c USING (user_id) WHERE row_idx < eval_start""",
)
def truncate_prefix(spark, sf):
    return zones.truncate_prefix(series(spark, sf), keys=KEYS).select(*ID, "cut", "masked", "is_label")
