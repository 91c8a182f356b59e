"""Queries for alignment with the reference curve and self alignment."""

from pyspark.sql import functions as F

from strataline.operators import align, zones
from strataline.plans.fixtures import (
    ID,
    KEYS,
    REF_KEYS,
    REFERENCE,
    SERIES,
    interp_from,
    interp_sql,
    predictions,
    PREDICTIONS,
    reference,
    rounded,
    series,
    show,
)
from strataline.plans.registry import query
from strataline.plans.windows import BY, over
from strataline.plans.zones import ANCHOR

REF = {"keys": KEYS, "ref_keys": REF_KEYS}


def curves(spark, sf):
    return align.prepare_reference(reference(spark, sf), keys=REF_KEYS)


def probes(spark, sf):
    """Series with a look-up position that runs a little outside the curve on both sides."""
    return series(spark, sf).withColumn("place", F.lit(899.0) + F.col("value") % 103)


PROBES = "q AS (SELECT *, 899.0::DOUBLE + value % 103 AS place FROM s)"


@query(
    "f01_interp_join",
    f"""WITH {SERIES}, {REFERENCE}, {PROBES} SELECT q.user_id, q.row_idx, round({interp_sql("a", "q.place")}, 6) + 0.0 AS clamped,
          round({interp_sql("a", "q.place", "null")}, 6) + 0.0 AS inside
        FROM {interp_from("a", "q", "q.place", "q.ref_id")}""",
)
def interp_join(spark, sf):
    from strataline.functions.asof import bracket, interpolated

    found = bracket(probes(spark, sf), curves(spark, sf), REF_KEYS, "place", "tvt", ["gr"])
    both = found.withColumns(
        {"clamped": interpolated(F.col("place"), "gr", "clamp"), "inside": interpolated(F.col("place"), "gr", "null")}
    )
    return show(both, ID, ["clamped", "inside"])


NEAREST = """
nr AS (SELECT q.user_id, q.row_idx, q.place, a.tvt AS ta, a.gr AS ga, b.tvt AS tb, b.gr AS gb FROM q
       ASOF LEFT JOIN r a ON a.ref_id = q.ref_id AND q.place >= a.tvt ASOF LEFT JOIN r b ON b.ref_id = q.ref_id AND q.place < b.tvt)"""


@query(
    "f02_nearest_join",
    f"""WITH {SERIES}, {REFERENCE}, {PROBES}, {NEAREST} SELECT user_id, row_idx,
          CASE WHEN tb IS NULL OR (ta IS NOT NULL AND place - ta <= tb - place) THEN ta ELSE tb END AS near_tvt,
          CASE WHEN tb IS NULL OR (ta IS NOT NULL AND place - ta <= tb - place) THEN ga ELSE gb END AS near_gr FROM nr""",
)
def nearest_join(spark, sf):
    near = align.nearest_reference(
        probes(spark, sf), curves(spark, sf), "place", "tvt", {"near_tvt": "tvt", "near_gr": "gr"}, keys=REF_KEYS
    )
    return near.select(*ID, "near_tvt", "near_gr")


@query(
    "f03_prepare_reference",
    """WITH r0 AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 25 AS ref_id, p_retailprice AS tvt,
          CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS gr FROM part),
        m AS (SELECT ref_id, tvt, avg(gr) AS gr FROM r0 GROUP BY 1, 2),
        i AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tvt) - 1 AS row_idx FROM m),
        n AS (SELECT *, last_value(gr IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER b AS p0,
          first_value(gr IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER a AS p1 FROM i
          WINDOW b AS (PARTITION BY ref_id ORDER BY tvt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            a AS (PARTITION BY ref_id ORDER BY tvt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT ref_id, row_idx, tvt, round(CASE WHEN gr IS NOT NULL THEN gr WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
          ELSE v0 + (v1 - v0) * ((row_idx - p0)::DOUBLE / (p1 - p0)) END, 6) + 0.0 AS gr FROM n""",
)
def prepare_reference(spark, sf):
    gappy = reference(spark, sf).withColumn("gr", F.when(F.col("gr") % 5 != 0, F.col("gr")))
    return show(align.prepare_reference(gappy, keys=REF_KEYS), ["ref_id", "row_idx", "tvt"], ["gr"])


@query(
    "f04_regrid_reference",
    f"""WITH {REFERENCE}, g AS (SELECT ref_id, lo, hi, unnest(range(CAST(ceil((hi + 0.5::DOUBLE - lo) / 0.5::DOUBLE) AS BIGINT))) AS cell FROM rb),
        q AS (SELECT ref_id, cell, lo + cell * 0.5::DOUBLE AS grid_x FROM g)
        SELECT q.ref_id, q.cell, round(q.grid_x, 6) + 0.0 AS grid_x, round({interp_sql("a", "q.grid_x")}, 6) + 0.0 AS grid_y
        FROM {interp_from("a", "q", "q.grid_x", "q.ref_id")}""",
)
def regrid_reference(spark, sf):
    return show(align.regrid_reference(curves(spark, sf), 0.5, keys=REF_KEYS), ["ref_id", "cell"], ["grid_x", "grid_y"])


def offsets_sql(offsets, edge, source="s", place="prior", ids="user_id, row_idx", extra="gr"):
    """Long look-up table "lk" of source rows × offsets."""
    values = ", ".join(f"({float(o)}::DOUBLE)" for o in offsets)
    return f"""ex AS (SELECT {source}.*, o AS off, {place} + o AS at_x FROM {source}, (VALUES {values}) t(o)),
        lk AS (SELECT ex.*, {interp_sql("a", "ex.at_x", edge)} AS ref_at FROM {interp_from("a", "ex", "ex.at_x", "ex.ref_id")})"""


FAMILY = [-10.0, -5.0, 0.0, 5.0, 10.0]
FAMILY_NAMES = ["resid_m10", "resid_m5", "resid_p0", "resid_p5", "resid_p10"]


@query(
    "f05_offset_family",
    f"""WITH {SERIES}, {REFERENCE}, {offsets_sql(FAMILY, "null")} SELECT user_id, row_idx, {", ".join(
        f"round(max(gr - ref_at) FILTER (off = {o}), 6) + 0.0 AS {n}" for o, n in zip(FAMILY, FAMILY_NAMES))} FROM lk GROUP BY 1, 2""",
)
def offset_family(spark, sf):
    found = align.offset_family(series(spark, sf), curves(spark, sf), "prior", FAMILY, ids=ID, keys=REF_KEYS)
    return show(found, ID, FAMILY_NAMES)


SCAN_LAGS = [float(v) for v in range(-80, 81)]


def correlation_sql(half, epsilon, name="corr"):
    # lc is ly less the series' least value: where a window touches the end of the curve, its spread is a small part of ly.
    o = f"OVER (PARTITION BY user_id, off ORDER BY row_idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    cov, vx, vy = (f"({moment} {o} * count(*) {o})" for moment in ("covar_pop(lx, lc)", "var_pop(lx)", "var_pop(lc)"))
    usable = f"count(*) {o} >= 3 AND {vx} > 1e-9 * sum(lx * lx) {o} AND {vy} > 1e-9 * sum(ly * ly) {o}"
    if epsilon:
        return f"CASE WHEN {usable} THEN {cov} / (sqrt({vx} * {vy}) + 1e-6) ELSE 0 END AS {name}"
    return f"CASE WHEN {usable} AND sqrt({vx} * {vy}) > 1e-8 THEN {cov} / sqrt({vx} * {vy}) ELSE 0 END AS {name}"


# Log with the gaps filled by the series' median.
FILLED_SQL = """
sm AS (SELECT user_id, quantile_cont(gr, 0.5) AS med FROM s GROUP BY 1),
sf AS (SELECT s.*, coalesce(gr, med, 0) AS lx FROM s JOIN sm USING (user_id))"""

SCAN = ["best_lag", "best_corr", "corr_at_0", "corr_max_minus_mean", "peakiness", "ref_at_best", "ref_minus_log"]


@query(
    "f06_lag_scan",
    f"""WITH {SERIES}, {REFERENCE}, {FILLED_SQL}, {offsets_sql(SCAN_LAGS, "clamp", "sf")}, w AS (SELECT user_id, row_idx, off, lx, ref_at AS ly, ref_at - min(ref_at) OVER (PARTITION BY user_id) AS lc FROM lk),
        c AS (SELECT *, {correlation_sql(25, True)} FROM w),
        b AS (SELECT user_id, row_idx, arg_max({{'off': off, 'corr': corr, 'lx': lx, 'ly': ly}}, (round(corr, 9), -off)) AS m,
          max(corr) FILTER (off = 0) AS corr_at_0, avg(corr) AS av, quantile_cont(corr, 0.5) AS me, stddev_pop(corr) AS sd FROM c GROUP BY 1, 2),
        o AS (SELECT user_id, row_idx, m.off AS best_lag, m.corr AS best_corr, corr_at_0, m.corr - av AS corr_max_minus_mean,
          (m.corr - me) / (sd + 1e-6) AS peakiness, m.ly AS ref_at_best, m.ly - m.lx AS ref_minus_log FROM b)
        SELECT user_id, row_idx, {rounded(*SCAN)} FROM o""",
)
def lag_scan(spark, sf):
    found = align.lag_scan(series(spark, sf), curves(spark, sf), 80, 51, **REF)
    return show(found, ID, SCAN)



MULTI_WINDOWS = (21, 51, 101)
MULTI = [*(f"best_lag_{w}" for w in MULTI_WINDOWS), *(f"best_corr_{w}" for w in MULTI_WINDOWS), "lag_agreement", "median_lag", "lag_consensus", "ref_z_at_median", "residual_z"]


def robust_sql(table, key, col, out, name):
    return f"""{name}1 AS (SELECT {key}, quantile_cont({col}, 0.5) AS m, stddev_pop({col}) AS d FROM {table} GROUP BY 1),
        {name}2 AS (SELECT {key}, max(m) AS m, max(d) AS d, 1.4826::DOUBLE * quantile_cont(abs({col} - m), 0.5) AS mad FROM {table} JOIN {name}1 USING ({key}) GROUP BY 1),
        {name} AS (SELECT {table}.*, coalesce(({col} - m) / CASE WHEN mad >= 1e-6 THEN mad WHEN d >= 1e-6 THEN d ELSE 1 END, 0) AS {out}
          FROM {table} JOIN {name}2 USING ({key}))"""


@query(
    "f07_lag_scan_multiscale",
    f"""WITH {SERIES}, {REFERENCE}, {robust_sql("s", "user_id", "gr", "lz", "sz")}, {robust_sql("r", "ref_id", "gr", "rz", "rzt")},
        zseg AS (SELECT ref_id, tvt AS x0, rz AS y0, lead(tvt) OVER w AS x1, lead(rz) OVER w AS y1 FROM rzt WINDOW w AS (PARTITION BY ref_id ORDER BY tvt)),
        zrb AS (SELECT ref_id, min(tvt) AS lo, max(tvt) AS hi, arg_min(rz, tvt) AS ylo, arg_max(rz, tvt) AS yhi FROM rzt GROUP BY 1),
        {offsets_sql(SCAN_LAGS, "clamp", "sz").replace("rb ab", "zrb ab").replace("seg ag", "zseg ag")},
        w AS (SELECT user_id, row_idx, off, lz AS lx, ref_at AS ly, ref_at - min(ref_at) OVER (PARTITION BY user_id) AS lc FROM lk),
        c AS (SELECT *, {", ".join(correlation_sql(v // 2, False, f"c{v}") for v in MULTI_WINDOWS)} FROM w),
        b AS (SELECT user_id, row_idx, max(lx) AS lz, {", ".join(f"arg_max({{'off': off, 'corr': c{v}}}, (round(c{v}, 9), -off)) AS m{v}" for v in MULTI_WINDOWS)} FROM c GROUP BY 1, 2),
        d AS (SELECT b.user_id, b.row_idx, lz, prior, ref_id, {", ".join(f"m{v}.off AS best_lag_{v}, m{v}.corr AS best_corr_{v}" for v in MULTI_WINDOWS)},
          list_stddev_pop([{", ".join(f"m{v}.off" for v in MULTI_WINDOWS)}]) AS lag_agreement, list_median([{", ".join(f"m{v}.off" for v in MULTI_WINDOWS)}]) AS median_lag FROM b JOIN s USING (user_id, row_idx)),
        q AS (SELECT *, prior + median_lag AS place, avg(median_lag) OVER ({BY} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS lag_consensus FROM d),
        o AS (SELECT q.*, {interp_sql("a", "q.place")} AS ref_z_at_median, lz - ref_z_at_median AS residual_z
          FROM {interp_from("a", "q", "q.place", "q.ref_id").replace("rb ab", "zrb ab").replace("seg ag", "zseg ag")})
        SELECT user_id, row_idx, {rounded(*MULTI)} FROM o""",
)
def lag_scan_multiscale(spark, sf):
    found = align.lag_scan_multiscale(series(spark, sf), curves(spark, sf), 80, MULTI_WINDOWS, **REF)
    return show(found, ID, MULTI)


@query(
    "f08_smooth_lag",
    f"""WITH {SERIES}, q AS (SELECT *, value % 13 - 6 AS best_lag FROM s) SELECT user_id, row_idx,
          round(avg(best_lag) {over(25, 24)}, 9) + 0.0 AS lag_mean_50, round(quantile_cont(best_lag, 0.5) {over(37, 37)}, 9) + 0.0 AS lag_median_75 FROM q""",
)
def smooth_lag(spark, sf):
    rows = series(spark, sf).withColumn("best_lag", F.col("value") % 13 - 6)
    return show(align.smooth_lag(rows, keys=KEYS), ID, ["lag_mean_50", "lag_median_75"], 9)


SHIFTS = [float(v) for v in range(-5, 6)]
SHIFT = [f"{n}_{t}" for t in ("15", "all") for n in ("shift", "misfit", "confidence")] + ["shift_spread"]


@query(
    "f09_best_shift",
    f"""WITH {SERIES}, {REFERENCE}, k AS (SELECT *, prior AS pos FROM s WHERE NOT is_eval AND gr IS NOT NULL), {offsets_sql(SHIFTS, "clamp", "k")},
        p AS (SELECT user_id, off, avg((gr - ref_at) * (gr - ref_at)) FILTER (row_idx >= eval_start - 15) AS m15, avg((gr - ref_at) * (gr - ref_at)) AS mall,
          count(*) FILTER (row_idx >= eval_start - 15) AS n15, count(*) AS nall FROM lk GROUP BY 1, 2),
        b AS (SELECT user_id, {", ".join(f"arg_min(off, (m{t}, off)) AS s{t}, min(m{t}) AS b{t}, avg(m{t}) AS a{t}, max(n{t}) AS n{t}" for t in ("15", "all"))} FROM p GROUP BY 1),
        o AS (SELECT user_id, {", ".join(f"CASE WHEN n{t} >= 10 THEN s{t} ELSE 0 END AS shift_{t}, CASE WHEN n{t} >= 10 THEN b{t} ELSE 1e6 END AS misfit_{t}, CASE WHEN n{t} >= 10 THEN 1 - b{t} / (a{t} + 1e-9) ELSE 0 END AS confidence_{t}" for t in ("15", "all"))} FROM b)
        SELECT user_id, {rounded(*SHIFT[:-1])}, round(abs(shift_15 - shift_all) / 2, 6) + 0.0 AS shift_spread FROM o""",
)
def best_shift(spark, sf):
    rows = series(spark, sf).withColumn("tvt_input", F.when(F.col("tvt_input").isNotNull(), F.col("prior")))
    return show(align.best_shift(rows, curves(spark, sf), SHIFTS, (15, None), **REF), KEYS, SHIFT)


REDUCED_SQL = """
      arg_min(off, (abs(gr - ref_at), off)) FILTER (gr IS NOT NULL AND ref_at IS NOT NULL) AS best, min(abs(gr - ref_at)) AS best_miss,
      list_sort(list(abs(gr - ref_at)) FILTER (gr IS NOT NULL AND ref_at IS NOT NULL)) AS ms,
      sum(exp(-abs(gr - ref_at) / 20) * off) / sum(exp(-abs(gr - ref_at) / 20)) AS soft,
      arg_min(ref_at, (abs(gr - ref_at), off)) FILTER (gr IS NOT NULL AND ref_at IS NOT NULL) AS best_ref"""
SEARCH = ["best_offset", "best_abs_resid", "zero_abs_resid", "top2_gap", "soft_offset", "best_ref"]


@query(
    "f10_local_offset_search",
    f"""WITH {SERIES}, {REFERENCE}, {offsets_sql(FAMILY, "null")}, b AS (SELECT user_id, row_idx, {REDUCED_SQL}, max(abs(gr - ref_at)) FILTER (off = 0) AS z FROM lk GROUP BY 1, 2),
        o AS (SELECT user_id, row_idx, best AS best_offset, best_miss AS best_abs_resid, z AS zero_abs_resid, ms[2] - ms[1] AS top2_gap, soft AS soft_offset, best_ref FROM b)
        SELECT user_id, row_idx, {rounded(*SEARCH)} FROM o""",
)
def local_offset_search(spark, sf):
    found = align.local_offset_search(series(spark, sf), curves(spark, sf), FAMILY, ids=ID, keys=REF_KEYS)
    return show(found, ID, SEARCH)


PATHS = [f"path_resid_{n}" for n in ("m10", "m5", "p0", "p5", "p10")] + ["min_abs_resid", "best_endpoint", "best_endpoint_centered", "top2_gap", "soft_endpoint", "best_resid"]


@query(
    "f11_candidate_paths",
    f"""WITH {SERIES}, {REFERENCE}, t AS (SELECT *, (row_idx - eval_start)::DOUBLE / greatest(n - eval_start - 1, 1) AS frac FROM s WHERE is_eval),
        ex AS (SELECT t.*, o AS off, prior + frac * o AS at_x FROM t, (VALUES {", ".join(f"({o}::DOUBLE)" for o in FAMILY)}) v(o)),
        lk AS (SELECT ex.*, {interp_sql("a", "ex.at_x", "null")} AS ref_at FROM {interp_from("a", "ex", "ex.at_x", "ex.ref_id")}),
        b AS (SELECT user_id, row_idx, {REDUCED_SQL}, max(gr) AS lg, {", ".join(f"max(gr - ref_at) FILTER (off = {o}) AS {n}" for o, n in zip(FAMILY, PATHS))} FROM lk GROUP BY 1, 2),
        o AS (SELECT *, best_miss AS min_abs_resid, best AS best_endpoint, best / 10 AS best_endpoint_centered, ms[2] - ms[1] AS top2_gap, soft AS soft_endpoint, lg - best_ref AS best_resid FROM b)
        SELECT user_id, row_idx, {rounded(*PATHS)} FROM o""",
)
def candidate_paths(spark, sf):
    tail = zones.positional(series(spark, sf), keys=KEYS)
    return show(align.candidate_paths(tail, curves(spark, sf), FAMILY, "prior", ids=ID, keys=REF_KEYS), ID, PATHS)


def known(spark, sf):
    """Series whose known values are positions on the reference curve."""
    return series(spark, sf).withColumn("tvt_input", F.when(F.col("tvt_input").isNotNull(), F.lit(899.0) + F.col("value") % 103))


def pairs_sql(edge):
    return f"""kq AS (SELECT *, 899.0::DOUBLE + value % 103 AS place FROM s WHERE tvt_input IS NOT NULL),
        pr AS (SELECT kq.user_id, kq.row_idx, kq.gr AS py, {interp_sql("a", "kq.place", edge)} AS px FROM {interp_from("a", "kq", "kq.place", "kq.ref_id")}),
        pv AS (SELECT * FROM pr WHERE px IS NOT NULL AND py IS NOT NULL)"""


CAL = ["cal_slope", "cal_intercept"]


@query(
    "f12_affine_calibration",
    f"""WITH {SERIES}, {REFERENCE}, {pairs_sql("clamp")}, c AS (SELECT user_id, count(*) AS n, stddev_pop(px) AS sd, regr_slope(py, px) AS a,
          regr_intercept(py, px) AS b, avg(py) - avg(px) AS d FROM pv GROUP BY 1),
        al AS (SELECT user_id, avg(py) - avg(px) AS d FROM pr GROUP BY 1),
        o AS (SELECT user_id, coalesce(n, 0) AS cal_rows, CASE WHEN n >= 20 AND sd >= 1e-6 THEN a ELSE 1 END AS cal_slope,
          CASE WHEN n >= 20 AND sd >= 1e-6 THEN b WHEN n > 0 THEN al.d ELSE 0 END AS cal_intercept FROM al LEFT JOIN c USING (user_id))
        SELECT user_id, cal_rows, {rounded(*CAL)} FROM o""",
)
def affine_calibration(spark, sf):
    return show(align.affine_calibration(known(spark, sf), curves(spark, sf), **REF), ["user_id", "cal_rows"], CAL)


def mad_sql(table, value, default, name):
    return f"""{name}m AS (SELECT user_id, quantile_cont({value}, 0.5) AS med, stddev_pop({value}) AS sd FROM {table} GROUP BY 1),
        {name} AS (SELECT user_id, max({name}m.med) AS med, CASE WHEN quantile_cont(abs({value} - {name}m.med), 0.5) > 1e-12 THEN 1.4826::DOUBLE * quantile_cont(abs({value} - {name}m.med), 0.5)
          WHEN max({name}m.sd) > 1e-12 THEN max({name}m.sd) ELSE {default} END AS scale FROM {table} JOIN {name}m USING (user_id) GROUP BY 1)"""


ROBUST_CAL = ["cal_slope", "cal_intercept", "cal_sigma", "cal_quality"]


@query(
    "f13_robust_calibration",
    f"""WITH {SERIES}, {REFERENCE}, {pairs_sql("clamp")}, f0 AS (SELECT user_id, count(*) AS n, regr_slope(py, px) AS a0, regr_intercept(py, px) AS b0,
          stddev_pop(px) AS sx, stddev_pop(py) AS sy, corr(py, px) AS cr FROM pv GROUP BY 1),
        r1 AS (SELECT *, py - a0 * px - b0 AS res0 FROM pv JOIN f0 USING (user_id)), {mad_sql("r1", "res0", "20", "k0")},
        r2 AS (SELECT r1.*, abs(res0 - med) <= 3.5 * greatest(scale, 1) AS keep FROM r1 JOIN k0 USING (user_id)),
        f1 AS (SELECT user_id, count(*) FILTER (keep) AS kept, regr_slope(py, px) FILTER (keep) AS a1 FROM r2 GROUP BY 1),
        r3 AS (SELECT r2.*, CASE WHEN n >= 12 AND sx >= 1e-6 THEN least(greatest(CASE WHEN kept >= 12 AND kept < n THEN a1 ELSE a0 END, 0.35), 2.25) ELSE 1 END AS cal_slope
          FROM r2 JOIN f1 USING (user_id)),
        f2 AS (SELECT user_id, quantile_cont(py - cal_slope * px, 0.5) AS cal_intercept FROM r3 GROUP BY 1),
        r4 AS (SELECT r3.*, cal_intercept, py - cal_slope * px - cal_intercept AS res1 FROM r3 JOIN f2 USING (user_id)), {mad_sql("r4", "res1", "20", "k1")}, {mad_sql("r4", "res1", "28", "k2")},
        o AS (SELECT r4.user_id, max(n) AS cal_rows, max(cal_slope) AS cal_slope, max(cal_intercept) AS cal_intercept,
          max(CASE WHEN n >= 12 AND sx >= 1e-6 THEN least(greatest(k1.scale, 7.5), 60) WHEN n < 12 THEN 28 ELSE least(greatest(k2.scale, 8), 60) END) AS cal_sigma,
          max(CASE WHEN n >= 12 AND sx >= 1e-6 THEN CASE WHEN sy > 1e-6 THEN least(abs(cr), 1) ELSE 0 END WHEN n < 12 THEN 0 ELSE 0.1 END) AS cal_quality
          FROM r4 JOIN k1 USING (user_id) JOIN k2 USING (user_id) GROUP BY 1)
        SELECT user_id, cal_rows, {rounded(*ROBUST_CAL)} FROM o""",
)
def robust_calibration(spark, sf):
    return show(align.robust_calibration(known(spark, sf), curves(spark, sf), **REF), ["user_id", "cal_rows"], ROBUST_CAL)


@query(
    "f14_residual_sigma",
    f"""WITH {SERIES}, {REFERENCE}, {pairs_sql("clamp")} SELECT user_id, round(CASE WHEN count(py - px) >= 20
          THEN least(greatest(stddev_pop(py - px), 10), 60) ELSE 30 END, 6) + 0.0 AS residual_sigma FROM pr GROUP BY 1""",
)
def residual_sigma(spark, sf):
    return show(align.residual_sigma(known(spark, sf), curves(spark, sf), **REF), KEYS, ["residual_sigma"])


PREFIX = ["prefix_corr", "prefix_rmse", "prefix_resid_std"]


@query(
    "f15_prefix_alignment",
    f"""WITH {SERIES}, {REFERENCE}, {pairs_sql("null")}, c AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 30 THEN corr(py, px) END AS c1,
          sqrt(avg((py - px) * (py - px))) AS c2, stddev_pop(py - px) AS c3 FROM pv GROUP BY 1)
        SELECT u.user_id, coalesce(n, 0) AS valid_points, round(c1, 6) + 0.0 AS prefix_corr, round(c2, 6) + 0.0 AS prefix_rmse, round(c3, 6) + 0.0 AS prefix_resid_std
        FROM (SELECT DISTINCT user_id FROM pr) u LEFT JOIN c USING (user_id)""",
)
def prefix_alignment(spark, sf):
    return show(align.prefix_alignment(known(spark, sf), curves(spark, sf), **REF), ["user_id", "valid_points"], PREFIX)


WINDOW5 = "OVER (PARTITION BY user_id, is_eval ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
UNIT_SQL = f"""
lm AS (SELECT user_id, quantile_cont(gr, 0.5) AS med FROM s GROUP BY 1),
sl AS (SELECT s.*, coalesce(gr, med, 0) AS lg FROM s JOIN lm USING (user_id)),
sm AS (SELECT *, avg(lg) {WINDOW5} AS sv, n - eval_start AS tail_n FROM sl),
wi AS (SELECT user_id, row_idx, is_eval, eval_start, n, tvt_input, list(sv) OVER (PARTITION BY user_id, is_eval ORDER BY row_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS w0 FROM sm),
pa AS (SELECT *, CASE WHEN is_eval THEN list_concat(list_concat(list_transform(range(greatest(15 - (row_idx - eval_start), 0)), lambda i: w0[1]), w0),
         list_transform(range(greatest(15 - (n - 1 - row_idx), 0)), lambda i: w0[-1])) ELSE w0 END AS w FROM wi),
un AS (SELECT *, list_transform(w, lambda v: (v - list_avg(w)) / (list_stddev_pop(w) + 1e-6)) AS u FROM pa)"""


@query(
    "f16_self_match",
    f"""WITH {SERIES}, {UNIT_SQL}, c AS (SELECT t.user_id, t.row_idx, p.row_idx AS center, p.tvt_input AS v, list_dot_product(t.u, p.u) / 31 AS sc
          FROM un t JOIN un p ON t.user_id = p.user_id AND t.is_eval AND NOT p.is_eval AND p.row_idx >= 15 AND p.row_idx + 15 < p.eval_start AND (p.row_idx - 15) % 3 = 0 AND p.eval_start >= 32)
        SELECT user_id, row_idx, arg_max(v, (round(sc, 9), -center)) AS match_value, round(max(sc), 6) + 0.0 AS match_score FROM c GROUP BY 1, 2""",
)
def self_match(spark, sf):
    return show(align.self_match(series(spark, sf), 15, 3, keys=KEYS), ID, ["match_value", "match_score"])


SCALES = ["scale_softmax", "scale_mean", "scale_delta"]


@query(
    "f17_combine_scales",
    f"""WITH {PREDICTIONS}, q AS (SELECT *, sin(row_idx) AS s1, cos(row_idx) AS s2 FROM p),
        o AS (SELECT user_id, row_idx, (pred_a * exp(3 * s1) + pred_b * exp(3 * s2)) / (exp(3 * s1) + exp(3 * s2) + 1e-9) AS scale_softmax, (pred_a + pred_b) / 2 AS scale_mean,
          CASE WHEN greatest(s1, 0) + greatest(s2, 0) > 0 THEN (greatest(s1, 0) * (pred_a - pred_c) + greatest(s2, 0) * (pred_b - pred_c)) / (greatest(s1, 0) + greatest(s2, 0)) ELSE 0 END AS scale_delta FROM q)
        SELECT user_id, row_idx, {rounded(*SCALES, digits=5)} FROM o""",
)
def combine_scales(spark, sf):
    angle = F.col("row_idx").cast("double")
    rows = predictions(spark, sf).withColumns({"s1": F.sin(angle), "s2": F.cos(angle)})
    return show(align.combine_scales(rows, ["pred_a", "pred_b"], ["s1", "s2"], "pred_c"), ID, SCALES, 5)


MATCH = ["match_value", "match_delta", "match_score", "match_trust", "match_gap"]
SIG = ["sig_mean", "sig_std", "sig_range", "sig_grad", "sig_center"]
PART = "PARTITION BY user_id, is_eval ORDER BY row_idx"
O15 = f"OVER ({PART} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"


@query(
    "f18_signature_match",
    f"""WITH {SERIES}, d0 AS (SELECT *, value - lag(value) OVER ({PART}) AS st FROM s),
        sg AS (SELECT *, CASE WHEN count(value) {O15} >= 3 THEN avg(value) {O15} END AS sig_mean, coalesce(stddev_samp(value) {O15}, 0) AS sig_std,
          max(value) {O15} - min(value) {O15} AS sig_range, coalesce(CASE WHEN count(st) {O15} >= 3 THEN avg(st) {O15} END, 0) AS sig_grad, value AS sig_center FROM d0),
        cn AS (SELECT * FROM sg WHERE NOT is_eval AND row_idx % 3 = 0 AND eval_start >= 30),
        sc AS (SELECT user_id, max(eval_start) AS known, {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN stddev_pop({c}) >= 1e-6 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in SIG)} FROM cn GROUP BY 1 HAVING count(*) >= 5),
        dd AS (SELECT t.user_id, t.row_idx, c.row_idx AS center, c.value AS v, known, sqrt({" + ".join(f"pow((t.{c} - c.{c}) / s_{c}, 2)" for c in SIG)}) AS d
          FROM sg t JOIN cn c ON t.user_id = c.user_id AND t.is_eval JOIN sc ON sc.user_id = t.user_id),
        b AS (SELECT user_id, row_idx, arg_min(v, (round(d, 9), center)) AS match_value, min(d) AS d1, list_sort(list(d))[2] AS d2, max(known) AS known FROM dd GROUP BY 1, 2),
        k AS (SELECT user_id, arg_max(value, row_idx) AS av FROM s WHERE NOT is_eval GROUP BY 1),
        o AS (SELECT s.user_id, s.row_idx, match_value, match_value - av AS match_delta, exp(-least(d1, 20) / 2.5) AS match_score,
          exp(-least(d1, 20) / 2.5) * least(known / 250.0::DOUBLE, 1) AS match_trust, d2 - d1 AS match_gap FROM s JOIN k USING (user_id) LEFT JOIN b USING (user_id, row_idx) WHERE is_eval)
        SELECT user_id, row_idx, {rounded(*MATCH)} FROM o""",
)
def signature_match(spark, sf):
    return show(align.signature_match(series(spark, sf), 15, 3, "value", keys=KEYS), ID, MATCH)


WARP_LAGS = [float(v) for v in range(-40, 41, 2)]
BAND = range(1, 12)  # cell t of row i is column i + t - 6, five on either side of the diagonal
CELLS = ", ".join(
    f"CASE WHEN i + {t} - 5 BETWEEN 1 AND m THEN (a[i + 1] - b[i + {t} - 5]) * (a[i + 1] - b[i + {t} - 5]) ELSE 'inf'::DOUBLE END"
    f" + least({', '.join([f'd{t}', *([f'd{t + 1}'] if t < 11 else []), *([f'n{t - 1}'] if t > 1 else [])])}) AS n{t}"
    for t in BAND
)
FILLED_IN = ", ".join(f"CASE WHEN r1 IS NULL THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * ((s.row_idx - r0)::DOUBLE / (r1 - r0)) END AS {c}" for c in align.WARPED)


@query(
    "f19_dtw_lag_features",
    f"""WITH RECURSIVE {SERIES}, {REFERENCE}, {FILLED_SQL}, {offsets_sql(WARP_LAGS, "clamp", "sf")},
        w AS (SELECT user_id, row_idx, off, n, list(lx) OVER o AS a, list(ref_at) OVER o AS b FROM lk WINDOW o AS (PARTITION BY user_id, off ORDER BY row_idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)),
        pr AS MATERIALIZED (SELECT row_number() OVER () AS id, user_id, row_idx, off, a, b, len(a) AS m FROM w WHERE row_idx % 5 = 0 OR row_idx = n - 1),
        d AS (SELECT id, 0::BIGINT AS i, {", ".join(f"{'0' if t == 6 else chr(39) + 'inf' + chr(39)}::DOUBLE AS d{t}" for t in BAND)} FROM pr
          UNION ALL SELECT id, i + 1, {", ".join(f"n{t}" for t in BAND)} FROM (SELECT d.id, d.i, {CELLS} FROM d JOIN pr USING (id) WHERE d.i < m)),
        e AS (SELECT user_id, row_idx, off, sqrt(d6 / m) AS v FROM d JOIN pr USING (id) WHERE i = m),
        f AS (SELECT user_id, row_idx, arg_min(off, (v, off)) AS dtw_best_lag, min(v) AS dtw_min_distance, max(v) FILTER (off = 0) AS dtw_distance_at_0, max(v) - min(v) AS dtw_spread,
          (list_sort(list(v))[2] - min(v)) / (min(v) + 1e-6) AS dtw_confidence FROM e GROUP BY 1, 2),
        k AS (SELECT user_id, row_idx AS r0, lead(row_idx) OVER o AS r1, {", ".join(f"{c} AS {c}0, lead({c}) OVER o AS {c}1" for c in align.WARPED)} FROM f WINDOW o AS (PARTITION BY user_id ORDER BY row_idx)),
        o AS (SELECT s.user_id, s.row_idx, {FILLED_IN} FROM s ASOF JOIN k ON s.user_id = k.user_id AND s.row_idx >= k.r0)
        SELECT user_id, row_idx, {rounded(*align.WARPED)} FROM o""",
)
def dtw_lag_features(spark, sf):
    found = align.dtw_lag_features(series(spark, sf), curves(spark, sf), **REF)
    return show(found, ID, align.WARPED)


@query(
    "f20_sample_and_interpolate",
    f"""WITH {SERIES}, k AS (SELECT user_id, row_idx AS r0, value AS v0, lead(row_idx) OVER w AS r1, lead(value) OVER w AS v1 FROM s
          WHERE row_idx % 5 = 0 OR row_idx = n - 1 WINDOW w AS (PARTITION BY user_id ORDER BY row_idx))
        SELECT s.user_id, row_idx, round(CASE WHEN r1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((row_idx - r0)::DOUBLE / (r1 - r0)) END, 6) + 0.0 AS value
        FROM s ASOF JOIN k ON s.user_id = k.user_id AND s.row_idx >= k.r0""",
)
def sample_and_interpolate(spark, sf):
    return show(align.sample_and_interpolate(series(spark, sf), 5, ["value"], keys=KEYS), ID, ["value"])


@query(
    "f21_alignment_interactions",
    f"""WITH {SERIES} SELECT user_id, row_idx, round(coalesce(gr - value / 3, 0), 6) + 0.0 AS lag_difference,
          round(coalesce(gr * (z + 100), 0), 5) + 0.0 AS lag_strength FROM s""",
)
def alignment_interactions(spark, sf):
    rows = series(spark, sf).withColumns({"b": F.col("value") / 3, "c": F.col("z") + 100})
    found = align.alignment_interactions(rows, "gr", "b", "gr", "c")
    return found.select(
        *ID, (F.round("lag_difference", 6) + 0.0).alias("lag_difference"), (F.round("lag_strength", 5) + 0.0).alias("lag_strength")
    )


FUSED = ["fused", "fused_delta", "fused_std", "weight_sum", "best_log_misfit"]


@query(
    "f22_fuse_candidates",
    f"""WITH {SERIES}, {REFERENCE}, ca AS (SELECT *, prior AS c0, CASE WHEN row_idx % 4 <> 0 THEN prior + sin(row_idx) * 5 END AS c1, 950.0::DOUBLE + value % 60 AS c2, 940.0::DOUBLE + z AS surf FROM s),
        un AS (SELECT user_id, row_idx, ref_id, gr, z, surf, 0 AS i, c0 AS v FROM ca UNION ALL SELECT user_id, row_idx, ref_id, gr, z, surf, 1, c1 FROM ca UNION ALL SELECT user_id, row_idx, ref_id, gr, z, surf, 2, c2 FROM ca),
        uv AS (SELECT * FROM un WHERE v IS NOT NULL),
        lk AS (SELECT uv.*, abs(gr - {interp_sql("a", "uv.v", "null")}) AS ms FROM {interp_from("a", "uv", "uv.v", "uv.ref_id")}),
        wt AS (SELECT *, exp(-least(greatest(coalesce(ms, 60) / 20, 0), 6)) * (0.2 + 0.8 * exp(-least(abs(v + z - surf) / 35, 6))) AS w FROM lk),
        f AS (SELECT user_id, row_idx, sum(w * v) / sum(w) AS fused, sum(w) AS weight_sum, count(*) AS candidate_count, min(ms) AS best_log_misfit FROM wt GROUP BY 1, 2),
        g AS (SELECT user_id, row_idx, sqrt(sum(w * (v - fused) * (v - fused)) / max(weight_sum)) AS fused_std FROM wt JOIN f USING (user_id, row_idx) GROUP BY 1, 2),
        o AS (SELECT f.*, fused_std, fused - prior AS fused_delta FROM f JOIN g USING (user_id, row_idx) JOIN s USING (user_id, row_idx))
        SELECT user_id, row_idx, candidate_count, {rounded(*FUSED)} FROM o""",
)
def fuse_candidates(spark, sf):
    wave = F.sin(F.col("row_idx").cast("double")) * 5
    rows = series(spark, sf).withColumns(
        {
            "c1": F.when(F.col("row_idx") % 4 != 0, F.col("prior") + wave),
            "c2": F.lit(950.0) + F.col("value") % 60,
            "surf": F.lit(940.0) + F.col("z"),
        }
    )
    found = align.fuse_candidates(
        rows, curves(spark, sf), ["prior", "c1", "c2"], surface="surf", anchor="prior", ids=ID, keys=REF_KEYS
    )
    return show(found, [*ID, "candidate_count"], FUSED)


CONSENSUS = ["sig_mean", "sig_std", "sig_median", "sig_range", "pred_a_minus_pred_b", "pred_a_minus_pred_c", "pred_b_minus_pred_c"]


@query(
    "f23_signal_consensus",
    f"""WITH {PREDICTIONS}, o AS (SELECT user_id, row_idx, (pred_a + pred_b + pred_c) / 3 AS sig_mean, list_stddev_pop([pred_a, pred_b, pred_c]) AS sig_std,
          list_median([pred_a, pred_b, pred_c]) AS sig_median, greatest(pred_a, pred_b, pred_c) - least(pred_a, pred_b, pred_c) AS sig_range,
          pred_a - pred_b AS pred_a_minus_pred_b, pred_a - pred_c AS pred_a_minus_pred_c, pred_b - pred_c AS pred_b_minus_pred_c FROM p)
        SELECT user_id, row_idx, {rounded(*CONSENSUS, digits=5)} FROM o""",
)
def signal_consensus(spark, sf):
    return show(align.signal_consensus(predictions(spark, sf), ["pred_a", "pred_b", "pred_c"]), ID, CONSENSUS, 5)


POSTERIOR = ["posterior_position", "posterior_peak"]


@query(
    "f24_posterior_match",
    f"""WITH {SERIES}, {REFERENCE}, j AS (SELECT s.user_id, s.row_idx, tvt, -(r.gr - s.gr) * (r.gr - s.gr) * (0.5 / 64.0) - (tvt - prior) * (tvt - prior) * (0.5 / 625.0) AS pw
          FROM s LEFT JOIN r ON r.ref_id = s.ref_id AND s.gr IS NOT NULL),
        m AS (SELECT user_id, row_idx, max(pw) AS top FROM j GROUP BY 1, 2),
        o AS (SELECT user_id, row_idx, sum(exp(pw - top) * tvt) / sum(exp(pw - top)) AS posterior_position, 1 / sum(exp(pw - top)) AS posterior_peak FROM j JOIN m USING (user_id, row_idx) GROUP BY 1, 2)
        SELECT user_id, row_idx, {rounded(*POSTERIOR)} FROM o""",
)
def posterior_match(spark, sf):
    found = align.posterior_match(series(spark, sf), curves(spark, sf), 8.0, 25.0, ids=ID, keys=REF_KEYS)
    return show(found, ID, POSTERIOR)
