"""Queries for gap filling and normalisation."""

from pyspark.sql import functions as F

from strataline.operators import gaps, zones
from strataline.plans.fixtures import (
    ID,
    KEYS,
    REFERENCE,
    SERIES,
    interp_from,
    interp_sql,
    reference,
    rounded,
    series,
    show,
)
from strataline.plans.registry import query

NEIGHBOURS = """
nb AS (SELECT *, last_value(gr IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER b AS r0,
         first_value(gr IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER a AS r1 FROM s
       WINDOW b AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gi AS (SELECT *, CASE WHEN gr IS NOT NULL THEN gr WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
         ELSE v0 + (v1 - v0) * ((row_idx - r0)::DOUBLE / (r1 - r0)) END AS filled FROM nb)"""


def one(name, sql_value, source="s", ctes="", column="filled"):
    more = f", {ctes}" if ctes else ""
    return f"WITH {SERIES}{more} SELECT user_id, row_idx, round({sql_value}, 6) + 0.0 AS {column} FROM {source}"


@query(
    "c01_fill_median",
    one("filled", "coalesce(gr, m, (SELECT quantile_cont(gr, 0.5) FROM s))", "s JOIN k USING (user_id)",
        "k AS (SELECT user_id, quantile_cont(gr, 0.5) AS m FROM s GROUP BY 1)"),
)
def fill_median(spark, sf):
    return show(gaps.fill_median(series(spark, sf), "gr", keys=KEYS), ID, ["filled"])


@query("c02_ffill_bfill", one("filled", "coalesce(v0, v1)", "nb", NEIGHBOURS))
def ffill_bfill(spark, sf):
    return show(gaps.ffill_bfill(series(spark, sf), "gr", keys=KEYS), ID, ["filled"])


@query("c03_interpolate_gaps", one("filled", "filled", "gi", NEIGHBOURS))
def interpolate_gaps(spark, sf):
    return show(gaps.interpolate_gaps(series(spark, sf), "gr", keys=KEYS), ID, ["filled"])


@query(
    "c04_observation_weight",
    one("weight", "CASE WHEN gr IS NOT NULL THEN 1 ELSE coalesce(0.30::DOUBLE * exp(-least(row_idx - r0, r1 - row_idx) / 25.0::DOUBLE), 0) END",
        "nb", NEIGHBOURS, "weight"),
)
def observation_weight(spark, sf):
    return show(gaps.observation_weight(series(spark, sf), "gr", keys=KEYS), ID, ["weight"])


@query(
    "c05_winsorize",
    one("winsorized", "CASE WHEN gr IS NOT NULL THEN least(greatest(gr, lo), hi) END", "s JOIN k USING (user_id)",
        "k AS (SELECT user_id, quantile_cont(gr, 0.005) AS lo, quantile_cont(gr, 0.995) AS hi FROM s GROUP BY 1)", "winsorized"),
)
def winsorize(spark, sf):
    return show(gaps.winsorize(series(spark, sf), "gr", keys=KEYS), ID, ["winsorized"])


@query("c06_null_flag", f"WITH {SERIES} SELECT user_id, row_idx, CAST(gr IS NULL AS INT) AS gr_isna FROM s")
def null_flag(spark, sf):
    return gaps.null_flag(series(spark, sf), "gr").select(*ID, "gr_isna")


@query(
    "c07_fill_from_reference",
    f"""WITH {SERIES}, {REFERENCE}, q AS (SELECT user_id, row_idx, ref_id, gr, prior + sin(row_idx) AS place FROM s)
        SELECT q.user_id, q.row_idx, round(coalesce(q.gr, {interp_sql("a", "q.place")}), 6) + 0.0 AS filled
        FROM {interp_from("a", "q", "q.place", "q.ref_id")}""",
)
def fill_from_reference(spark, sf):
    from strataline.operators.align import prepare_reference

    curves = prepare_reference(reference(spark, sf), keys=["ref_id"])
    rows = series(spark, sf).withColumn("place", F.col("prior") + F.sin(F.col("row_idx").cast("double")))
    return show(gaps.fill_from_reference(rows, curves, "gr", "place", keys=["ref_id"]), ID, ["filled"])


@query(
    "c08_scale_percentile",
    one("scaled", "(gr - lo) / greatest(hi - lo, 1)", "s JOIN k USING (user_id)",
        """k AS (SELECT user_id, CASE WHEN count(gr) < 10 THEN min(gr) ELSE quantile_cont(gr, 0.05) END AS lo,
             CASE WHEN count(gr) < 10 THEN max(gr) ELSE quantile_cont(gr, 0.95) END AS hi FROM s WHERE NOT is_eval GROUP BY 1)""", "scaled"),
)
def scale_percentile(spark, sf):
    known = zones.split_zone(series(spark, sf), keys=KEYS)
    return show(gaps.scale_percentile(known, "gr", "in_prefix", keys=KEYS), ID, ["scaled"])


@query(
    "c09_zscore",
    one("zscore", "(gr - m) / (d + 1e-8)", "s JOIN k USING (user_id)",
        "k AS (SELECT user_id, avg(gr) AS m, stddev_samp(gr) AS d FROM s GROUP BY 1)", "zscore"),
)
def zscore(spark, sf):
    return show(gaps.zscore(series(spark, sf), "gr", keys=KEYS), ID, ["zscore"])


ROBUST = """
k1 AS (SELECT user_id, quantile_cont(gr, 0.5) AS m, stddev_pop(gr) AS d FROM s GROUP BY 1),
k2 AS (SELECT s.user_id, max(m) AS m, max(d) AS d, 1.4826::DOUBLE * quantile_cont(abs(gr - m), 0.5) AS mad FROM s JOIN k1 USING (user_id) GROUP BY 1),
k AS (SELECT user_id, m, CASE WHEN mad >= 1e-6 THEN mad WHEN d >= 1e-6 THEN d ELSE 1 END AS scale FROM k2)"""


@query("c10_robust_zscore", one("robust_z", "coalesce((gr - m) / scale, 0)", "s JOIN k USING (user_id)", ROBUST, "robust_z"))
def robust_zscore(spark, sf):
    return show(gaps.robust_zscore(series(spark, sf), "gr", keys=KEYS), ID, ["robust_z"])


@query(
    "c11_pct_rank",
    one("pct_rank", """CASE WHEN gr IS NOT NULL THEN (rank() OVER (PARTITION BY user_id ORDER BY gr NULLS LAST)
          + (count(*) OVER (PARTITION BY user_id, gr) - 1) / 2.0::DOUBLE) / count(gr) OVER (PARTITION BY user_id) END""", column="pct_rank"),
)
def pct_rank(spark, sf):
    return show(gaps.pct_rank(series(spark, sf), "gr", keys=KEYS), ID, ["pct_rank"])
