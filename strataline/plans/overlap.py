"""Queries for overlap and leakage checks. Test: users divisible by 5; training: the others, and altered copies of some of them."""

from pyspark.sql import functions as F

from strataline.operators import overlap
from strataline.operators.align import prepare_reference
from strataline.plans.fixtures import ID, KEYS, REF_KEYS, REFERENCE, SERIES, reference, rounded, series, show
from strataline.plans.registry import query


def split(spark, sf):
    """Test rows; training rows with exact copies (user % 10 = 0) and copies rounded to one digit (user % 20 = 5)."""
    rows = series(spark, sf)
    test = rows.where(F.col("user_id") % 5 == 0).withColumns({"target": F.col("value"), "pred": F.col("value") * 0.9 + 1})
    copy = (F.col("user_id") % 10 == 0) | (F.col("user_id") % 20 == 5)
    train = rows.where((F.col("user_id") % 5 != 0) | copy)
    target = F.when(F.col("user_id") % 20 == 5, F.round("value", 1)).otherwise(F.col("value"))
    shifted = F.when(F.col("user_id") % 20 == 5, F.col("gr") + 0.25).otherwise(F.col("gr"))
    return test, train.withColumns({"target": target, "gr": shifted})


SPLIT = f"""{SERIES},
te AS (SELECT *, value AS target, value * 0.9::DOUBLE + 1 AS pred FROM s WHERE user_id % 5 = 0),
tr AS (SELECT * REPLACE (CASE WHEN user_id % 20 = 5 THEN gr + 0.25 ELSE gr END AS gr), CASE WHEN user_id % 20 = 5 THEN round(value, 1) ELSE value END AS target FROM s WHERE user_id % 5 <> 0 OR user_id % 10 = 0 OR user_id % 20 = 5)"""


@query(
    "n01_exact_coordinate_blend",
    f"""WITH {SPLIT}, k AS (SELECT CAST(round_even(x * 100, 0) AS BIGINT) AS a, CAST(round_even(y * 100, 0) AS BIGINT) AS b, CAST(round_even(z * 100, 0) AS BIGINT) AS c, arg_min(target, (user_id, row_idx)) AS t FROM tr GROUP BY 1, 2, 3)
        SELECT user_id, row_idx, round(coalesce(0.72 * pred + 0.28 * t, pred), 8) + 0.0 AS blended FROM te
        LEFT JOIN k ON a = CAST(round_even(x * 100, 0) AS BIGINT) AND b = CAST(round_even(y * 100, 0) AS BIGINT) AND c = CAST(round_even(z * 100, 0) AS BIGINT)""",
)
def exact_coordinate_blend(spark, sf):
    test, train = split(spark, sf)
    return show(overlap.exact_coordinate_blend(test, train, "pred", "target", 0.28, first=ID), ID, ["blended"], 8)


@query("n02_label_lookup", f"WITH {SPLIT} SELECT te.user_id, te.row_idx, tr.target AS label FROM te LEFT JOIN tr USING (user_id, row_idx)")
def label_lookup(spark, sf):
    test, train = split(spark, sf)
    return overlap.label_lookup(test.select(*ID), train, ID, "target").select(*ID, "label")


GATE = f"""
cu AS (SELECT user_id, md AS x0, z AS z0, target AS t0, gr AS g0, lead(gr) OVER w AS g1, lead(md) OVER w AS x1, lead(z) OVER w AS z1, lead(target) OVER w AS t1 FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY md)),
gp AS (SELECT te.*, z - CASE WHEN md = x0 THEN z0 ELSE z0 + (z1 - z0) * (md - x0) / (x1 - x0) END AS gz, tvt_input - CASE WHEN md = x0 THEN t0 ELSE t0 + (t1 - t0) * (md - x0) / (x1 - x0) END AS gt,
         CASE WHEN md = x0 THEN t0 ELSE t0 + (t1 - t0) * (md - x0) / (x1 - x0) END AS tv, abs(gr - CASE WHEN md = x0 THEN g0 ELSE g0 + (g1 - g0) * (md - x0) / (x1 - x0) END) AS gl FROM te ASOF LEFT JOIN cu ON cu.user_id = te.user_id AND te.md >= cu.x0),
gt AS (SELECT user_id, count(gz) AS z_rows, count(CASE WHEN gz IS NOT NULL THEN gr END) AS log_rows, count(gt) AS known_rows, avg(abs(gz)) AS z_gap,
         avg(CASE WHEN gz IS NOT NULL THEN gl END) AS log_gap, sqrt(avg(gt * gt)) AS target_rmse FROM gp GROUP BY 1),
ga AS (SELECT *, CASE WHEN user_id NOT IN (SELECT user_id FROM tr) THEN 'no_copy' WHEN z_rows < 20 THEN 'too_few_z_rows' WHEN known_rows < 20 THEN 'too_few_known_rows'
         WHEN target_rmse < 0.02 AND log_gap < 0.5 AND z_gap < 0.02 THEN 'accepted' ELSE 'gate_failed' END AS status FROM gt)"""


@query(
    "n03_overlap_gate",
    f"""WITH {SPLIT}, {GATE} SELECT user_id, z_rows, log_rows, known_rows, status, status = 'accepted' AS accepted, {rounded("z_gap", "log_gap", "target_rmse")} FROM ga""",
)
def overlap_gate(spark, sf):
    test, train = split(spark, sf)
    gate = overlap.overlap_gate(test, train, {"rows": 20}, "target", keys=KEYS)
    return show(gate, [*KEYS, "z_rows", "log_rows", "known_rows", "status", "accepted"], ["z_gap", "log_gap", "target_rmse"])


@query(
    "n04_gated_override",
    f"""WITH {SPLIT}, {GATE} SELECT gp.user_id, row_idx, status = 'accepted' AND tv IS NOT NULL AS changed,
          round(CASE WHEN status = 'accepted' AND tv IS NOT NULL THEN 0.5 * pred + 0.5 * tv ELSE pred END, 6) + 0.0 AS overridden FROM gp JOIN ga USING (user_id)""",
)
def gated_override(spark, sf):
    test, train = split(spark, sf)
    gate = overlap.overlap_gate(test, train, {"rows": 20}, "target", keys=KEYS)
    return show(overlap.gated_override(test, train, gate, "pred", 0.5, "target", keys=KEYS), [*ID, "changed"], ["overridden"])


@query(
    "n02_lookup_complete",
    f"""WITH {SPLIT}, l AS (SELECT te.user_id, te.row_idx, tr.target AS label FROM te LEFT JOIN tr USING (user_id, row_idx))
        SELECT count(*) AS rows, count(*) - count(label) AS missing, count(*) = count(label) AS complete FROM l""",
)
def lookup_complete(spark, sf):
    test, train = split(spark, sf)
    return overlap.lookup_complete(overlap.label_lookup(test.drop("target"), train, ID, "target"))


@query(
    "n04_changed_report",
    f"""WITH {SPLIT}, {GATE} SELECT gp.user_id, count(*) AS rows, CAST(sum(CASE WHEN status = 'accepted' AND tv IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS changed_rows
        FROM gp JOIN ga USING (user_id) GROUP BY 1""",
)
def changed_report(spark, sf):
    test, train = split(spark, sf)
    gate = overlap.overlap_gate(test, train, {"rows": 20}, "target", keys=KEYS)
    return overlap.changed_report(overlap.gated_override(test, train, gate, "pred", 0.5, "target", keys=KEYS), KEYS)


@query(
    "n05_contact_override",
    f"""WITH {SPLIT}, {REFERENCE}, ct AS (SELECT ref_id, coalesce(min(tvt) FILTER (geology = 'SMALL'), min(tvt)) AS c FROM r GROUP BY 1),
        ts AS (SELECT *, z + target + 10 + CASE WHEN user_id % 20 = 0 THEN sin(row_idx) * 30 ELSE 0 END AS surf FROM tr),
        mm AS (SELECT user_id, ref_id, avg(target - (surf - z)) AS m FROM ts GROUP BY 1, 2),
        ph AS (SELECT ts.user_id, md, c + (surf - z) + (m - c) AS p FROM ts JOIN mm ON mm.user_id = ts.user_id JOIN ct ON ct.ref_id = ts.ref_id),
        cv AS (SELECT user_id, md AS x0, p AS p0, lead(md) OVER w AS x1, lead(p) OVER w AS p1, count(*) OVER (PARTITION BY user_id) AS tn FROM ph WINDOW w AS (PARTITION BY user_id ORDER BY md)),
        lk AS (SELECT te.*, tn, CASE WHEN md = x0 THEN p0 ELSE p0 + (p1 - p0) * (md - x0) / (x1 - x0) END AS v FROM te ASOF LEFT JOIN cv ON cv.user_id = te.user_id AND te.md >= cv.x0),
        gk AS (SELECT user_id, coalesce(max(tn) >= 40 AND count(v - tvt_input) >= 20 AND sqrt(avg(pow(v - tvt_input, 2))) <= 1, FALSE) AS ok FROM lk GROUP BY 1)
        SELECT lk.user_id, row_idx, ok AND v IS NOT NULL AS changed, round(CASE WHEN ok AND v IS NOT NULL THEN v ELSE pred END, 5) + 0.0 AS overridden FROM lk JOIN gk USING (user_id)""",
)
def contact_override(spark, sf):
    test, train = split(spark, sf)
    bend = F.when(F.col("user_id") % 20 == 0, F.sin(F.col("row_idx").cast("double")) * 30).otherwise(0.0)
    train = train.withColumn("surf", F.col("z") + F.col("target") + 10 + bend)
    curve = prepare_reference(reference(spark, sf), label="geology", keys=REF_KEYS)
    found = overlap.contact_override(
        test, train, curve, "SMALL", "surf", "pred", 1.0, 20, 40, "target", keys=KEYS, ref_keys=REF_KEYS
    )
    return show(found, [*ID, "changed"], ["overridden"], 5)


@query("n06_exclude_entities", f"WITH {SPLIT} SELECT user_id, row_idx, value FROM te WHERE user_id NOT IN (SELECT user_id FROM tr)")
def exclude_entities(spark, sf):
    test, train = split(spark, sf)
    return overlap.exclude_entities(test, train, KEYS).select(*ID, "value")


@query(
    "n07_score_overlap",
    f"""WITH {SPLIT}, j AS (SELECT te.pred, tr.target AS t FROM te LEFT JOIN tr USING (user_id, row_idx))
        SELECT count(pred - t) AS rows, count(*) - count(t) AS missing_truth, round(sqrt(avg(pow(pred - t, 2))), 5) + 0.0 AS rmse, round(avg(pow(pred - t, 2)), 5) + 0.0 AS mse,
          round(avg(abs(pred - t)), 5) + 0.0 AS mae, round(avg(pred - t), 5) + 0.0 AS bias FROM j""",
)
def score_overlap(spark, sf):
    test, train = split(spark, sf)
    found = overlap.score_overlap(test.select(*ID, "pred"), train, ID, "pred", "target")
    return show(found, ["rows", "missing_truth"], ["rmse", "mse", "mae", "bias"], 5)
