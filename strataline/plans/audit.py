"""Queries for prediction tables, candidate comparison and the experiment log."""

from pyspark.sql import functions as F

from strataline.operators import audit
from strataline.operators.evaluate import metrics_by
from strataline.plans.evaluate import MIXED, mixed
from strataline.plans.fixtures import ID, KEYS, PREDICTIONS, predictions, rounded, show
from strataline.plans.registry import query
from strataline.settings import work_folder
from strataline.sources.tables import make_row_id

NAMES = ["a", "a_copy", "a_near", "b", "c"]


def sample(spark, sf):
    rows = predictions(spark, sf).where(F.col("tvt_input").isNull())
    return make_row_id(rows, "user_id").select("id")


def candidates(spark, sf):
    """Five candidate tables over the evaluation rows: two equal, one nearly equal, two others."""
    rows = make_row_id(predictions(spark, sf).where(F.col("tvt_input").isNull()), "user_id")
    values = {"a": F.col("pred_a"), "a_copy": F.col("pred_a"), "a_near": F.col("pred_a") + 0.01, "b": F.col("pred_b"), "c": F.col("pred_c")}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    return rows.select("id", F.explode(pairs).alias("_c")).select("id", "_c.*")


CANDIDATES = PREDICTIONS + """,
sm AS (SELECT concat_ws('_', user_id, row_idx) AS id, * FROM p WHERE is_eval),
cd AS (SELECT id, 'a' AS name, pred_a AS value FROM sm UNION ALL SELECT id, 'a_copy', pred_a FROM sm UNION ALL SELECT id, 'a_near', pred_a + 0.01 FROM sm
       UNION ALL SELECT id, 'b', pred_b FROM sm UNION ALL SELECT id, 'c', pred_c FROM sm),
ds AS (SELECT l.name AS "left", r.name AS "right", count(*) AS rows, sqrt(avg(pow(l.value - r.value, 2))) AS rmse, sum(abs(l.value - r.value)) AS abs_sum
       FROM cd l JOIN cd r ON l.id = r.id AND l.name < r.name GROUP BY 1, 2),
hx AS (SELECT id, name, CAST(round_even(value * 1000000, 0) AS BIGINT) AS q FROM cd),
fp AS (SELECT name, count(*) AS rows, CAST(sum(('0x' || substr(md5(concat_ws('|', id, q)), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS fingerprint FROM hx GROUP BY 1),
sy AS (SELECT "left" AS name, "right" AS other, rmse FROM ds UNION ALL SELECT "right", "left", rmse FROM ds),
nx AS (SELECT name, arg_min(other, (round(rmse, 9), other)) AS nearest, min(rmse) AS nearest_rmse FROM sy GROUP BY 1),
nd AS (SELECT sy.name, arg_min(other, (round(rmse, 9), other)) AS nearest, min(rmse) AS nearest_rmse FROM sy JOIN fp x ON x.name = sy.name JOIN fp y ON y.name = sy.other WHERE x.fingerprint <> y.fingerprint GROUP BY 1)"""


def some(spark, sf):
    """Predictions for two thirds of the sample, some of them twice, some not finite, and some under unknown ids."""
    a = candidates(spark, sf).where("name = 'a'").select("id", "value")
    row = F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
    return a.where(row % 3 != 0).unionByName(a.where(row % 3 == 1).withColumn("value", F.col("value") + 2))


def flawed(spark, sf):
    """The same with values that are missing or infinite and with ids that are not in the sample."""
    rows = some(spark, sf)
    row = F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
    broken = F.when(row % 11 == 4, F.lit(float("inf"))).when(row % 13 != 5, F.col("value"))
    strangers = rows.where(row % 7 == 2).withColumn("id", F.concat(F.lit("x"), F.col("id")))
    return rows.withColumn("value", broken).unionByName(strangers)


SOME = """
so AS (SELECT id, pred_a AS value FROM sm WHERE row_idx % 3 <> 0 UNION ALL SELECT id, pred_a + 2 FROM sm WHERE row_idx % 3 = 1)"""


@query(
    "o01_align_to_sample",
    f"""WITH {CANDIDATES}, {SOME}, d AS (SELECT id, avg(value) AS value FROM so GROUP BY 1), f AS (SELECT avg(value) AS m FROM so)
        SELECT sm.id, round(coalesce(d.value, m), 6) + 0.0 AS value FROM sm LEFT JOIN d USING (id), f""",
)
def align_to_sample(spark, sf):
    preds = some(spark, sf)
    fill = preds.agg(F.avg("value").alias("m"))
    return show(audit.align_to_sample(audit.dedupe_mean(preds, "value"), sample(spark, sf), "value", fill), ["id"], ["value"])


@query("o02_dedupe_mean", f"WITH {CANDIDATES}, {SOME} SELECT id, round(avg(value), 6) + 0.0 AS value FROM so GROUP BY 1")
def dedupe_mean(spark, sf):
    return show(audit.dedupe_mean(some(spark, sf), "value"), ["id"], ["value"])


@query(
    "o03_submission_audit",
    f"""WITH {CANDIDATES}, {SOME}, sr AS (SELECT *, CAST(regexp_extract(id, '_([0-9]+)$', 1) AS BIGINT) AS k FROM so),
        fl AS (SELECT id, CASE WHEN k % 11 = 4 THEN 'infinity'::DOUBLE WHEN k % 13 <> 5 THEN value END AS value FROM sr UNION ALL SELECT concat('x', id), value FROM sr WHERE k % 7 = 2),
        o AS (SELECT count(*) AS rows, (SELECT count(*) FROM sm) AS sample_rows, count(*) - count(DISTINCT id) AS duplicates, (SELECT count(*) FROM sm WHERE id NOT IN (SELECT id FROM fl)) AS missing_ids,
          (SELECT count(DISTINCT id) FROM fl WHERE id NOT IN (SELECT id FROM sm)) AS unknown_ids, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS non_finite,
          min(value) FILTER (isfinite(value)) AS lo, max(value) FILTER (isfinite(value)) AS hi, avg(value) FILTER (isfinite(value)) AS mean, stddev_pop(value) FILTER (isfinite(value)) AS std FROM fl)
        SELECT rows, sample_rows, duplicates, missing_ids, unknown_ids, non_finite, duplicates + missing_ids + unknown_ids + non_finite = 0 AS valid,
          round(lo, 6) + 0.0 AS min, round(hi, 6) + 0.0 AS max, round(mean, 6) + 0.0 AS mean, round(std, 5) + 0.0 AS std FROM o""",
)
def submission_audit(spark, sf):
    found = audit.submission_audit(flawed(spark, sf), sample(spark, sf), "value")
    ids = ["rows", "sample_rows", "duplicates", "missing_ids", "unknown_ids", "non_finite", "valid"]
    return found.select(*ids, *[(F.round(c, 5 if c == "std" else 6) + 0.0).alias(c) for c in ("min", "max", "mean", "std")])


@query("o04_content_hash", f"WITH {CANDIDATES} SELECT name, rows, fingerprint FROM fp")
def content_hash(spark, sf):
    return audit.content_hash(candidates(spark, sf), "value", ["name"])


STATS = ["mean", "std", "min", "max", "q01", "q50", "q99"]


@query(
    "o05_candidate_stats",
    f"""WITH {CANDIDATES.replace("FROM sm)", "FROM sm WHERE row_idx % 9 <> 3)")}, o AS (SELECT name, count(*) AS rows, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.01) AS q01,
          quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99 FROM cd GROUP BY 1) SELECT name, rows, rows = (SELECT count(*) FROM sm) AND rows = (SELECT count(*) FROM cd c JOIN sm USING (id) WHERE c.name = o.name AND isfinite(c.value)) AS valid, {rounded(*STATS)} FROM o""",
)
def candidate_stats(spark, sf):
    rows = candidates(spark, sf)
    row = F.regexp_extract("id", r"_(\d+)$", 1).cast("long")
    return show(audit.candidate_stats(rows.where((F.col("name") != "c") | (row % 9 != 3)), sample(spark, sf)), ["name", "rows", "valid"], STATS)


def distances(spark, sf):
    return audit.pairwise_distance(candidates(spark, sf), NAMES)


@query("o06_pairwise_distance", f"""WITH {CANDIDATES} SELECT "left", "right", rows, round(rmse, 6) + 0.0 AS rmse, round(abs_sum, 4) + 0.0 AS abs_sum FROM ds""")
def pairwise_distance(spark, sf):
    return distances(spark, sf).select(
        "left", "right", "rows", (F.round("rmse", 6) + 0.0).alias("rmse"), (F.round("abs_sum", 4) + 0.0).alias("abs_sum")
    )


def nearest(spark, sf):
    gaps, marks = distances(spark, sf), audit.content_hash(candidates(spark, sf), "value", ["name"])
    return audit.nearest_candidate(gaps), audit.nearest_candidate(gaps, marks)


@query(
    "o07_nearest_candidate",
    f"""WITH {CANDIDATES} SELECT name, 'any' AS scope, nearest, round(nearest_rmse, 6) + 0.0 AS nearest_rmse FROM nx UNION ALL SELECT name, 'distinct', nearest, round(nearest_rmse, 6) + 0.0 FROM nd""",
)
def nearest_candidate(spark, sf):
    every, distinct = nearest(spark, sf)
    both = every.withColumn("scope", F.lit("any")).unionByName(distinct.withColumn("scope", F.lit("distinct")))
    return show(both, ["name", "scope", "nearest"], ["nearest_rmse"])


@query(
    "o08_diversity_report",
    f"""WITH {CANDIDATES} SELECT nx.name, nx.nearest, nd.nearest AS distinct_nearest, nx.nearest_rmse < 0.02 AS near_duplicate, nd.nearest_rmse >= 1 AS diverse,
          round(nx.nearest_rmse, 6) + 0.0 AS nearest_rmse, round(nd.nearest_rmse, 6) + 0.0 AS distinct_rmse FROM nx LEFT JOIN nd USING (name)""",
)
def diversity_report(spark, sf):
    found = audit.diversity_report(*nearest(spark, sf))
    return show(found, ["name", "nearest", "distinct_nearest", "near_duplicate", "diverse"], ["nearest_rmse", "distinct_rmse"])


LOGGED = PREDICTIONS + """,
lg AS (SELECT concat('exp_', user_id) AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'features' ELSE 'blend' END AS phase, round(sqrt(avg(pow(pred_a - value, 2))), 4) AS cv_rmse FROM p GROUP BY user_id)"""


def experiments(spark, sf):
    """One record per series, appended to a log in two parts and read back."""
    scores = metrics_by(predictions(spark, sf), "value", "pred_a", KEYS)
    records = scores.select(
        F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
        F.when(F.col("user_id") % 2 == 0, "features").otherwise("blend").alias("phase"),
        F.col("rmse").alias("cv_rmse"),
    )
    path = work_folder(spark, "experiments")
    for phase in ("features", "blend"):
        audit.log_experiment(spark, records.where(F.col("phase") == phase), path)
    return audit.read_log(spark, path)


@query("o09_log_experiment", f"WITH {LOGGED} SELECT experiment_id, phase, cv_rmse FROM lg")
def log_experiment(spark, sf):
    return experiments(spark, sf).select("experiment_id", "phase", "cv_rmse")


@query("o10_best_experiments", f"WITH {LOGGED} SELECT experiment_id, phase, cv_rmse FROM lg WHERE phase = 'blend' ORDER BY cv_rmse, experiment_id LIMIT 5")
def best_experiments(spark, sf):
    return audit.best_experiments(experiments(spark, sf), 5, "blend").select("experiment_id", "phase", "cv_rmse")


@query(
    "o11_rank_counts",
    f"""WITH {MIXED}, l AS (SELECT user_id, row_idx, 0 AS i, 'm1' AS model, m1 AS v FROM mx UNION ALL SELECT user_id, row_idx, 1, 'm2', m2 FROM mx UNION ALL SELECT user_id, row_idx, 2, 'm3', m3 FROM mx),
        r AS (SELECT model, CAST(row_number() OVER (PARTITION BY user_id, row_idx ORDER BY v DESC, i) AS INT) AS place FROM l) SELECT model, place, count(*) AS rows FROM r GROUP BY 1, 2""",
)
def rank_counts(spark, sf):
    return audit.rank_counts(mixed(spark, sf), ["m1", "m2", "m3"])


LADDER = ["mean", "std", "rmse_change", "p95_change"]


@query(
    "o12_weight_ladder",
    f"""WITH {MIXED}, w AS (SELECT weight FROM (VALUES (0.5::DOUBLE), (0.75), (0.9)) t(weight)), b AS (SELECT weight, weight * m1 + (1 - weight) * m2 AS v, m1 FROM mx, w),
        o AS (SELECT weight, count(*) AS rows, avg(v) AS mean, stddev_samp(v) AS std, sqrt(avg(pow(v - m1, 2))) AS rmse_change, quantile_cont(abs(v - m1), 0.95) AS p95_change FROM b GROUP BY 1)
        SELECT weight, rows, {rounded(*LADDER, digits=5)} FROM o""",
)
def weight_ladder(spark, sf):
    rows = make_row_id(mixed(spark, sf), "user_id")
    a, b = rows.select("id", F.col("m1").alias("value")), rows.select("id", F.col("m2").alias("value"))
    return show(audit.weight_ladder(a, b, [0.5, 0.75, 0.9]), ["weight", "rows"], LADDER, 5)
