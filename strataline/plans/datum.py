"""Queries for datum identities."""

from pyspark.sql import functions as F

from strataline.operators import datum
from strataline.operators.align import prepare_reference
from strataline.plans.fixtures import ID, KEYS, REF_KEYS, REFERENCE, SERIES, reference, rounded, series, show
from strataline.plans.registry import query

SURFACES = ["sa", "sb", "sc"]


def surfaces(spark, sf):
    wave = F.sin(F.col("row_idx").cast("double"))
    base = F.col("z") + F.col("value")
    return series(spark, sf).withColumns({"sa": base + 10 + wave, "sb": base * 1.1 + 20, "sc": base + 7})


SURF = f"{SERIES}, u AS (SELECT *, z + value + 10 + sin(row_idx) AS sa, (z + value) * 1.1::DOUBLE + 20 AS sb, z + value + 7 AS sc FROM s)"


def offsets_sql(surface, prefix, name):
    b = f"tvt_input + z - {surface}"
    third, two = "eval_start // 3", "(2 * eval_start) // 3"
    return f"""{name} AS (SELECT user_id, quantile_cont({b}, 0.5) AS {prefix}_full,
          quantile_cont({b}, 0.5) FILTER ({third} = 0 OR row_idx < {third}) AS {prefix}_early,
          quantile_cont({b}, 0.5) FILTER ({two} <= {third} OR (row_idx >= {third} AND row_idx < {two})) AS {prefix}_mid,
          quantile_cont({b}, 0.5) FILTER (eval_start < 5 OR row_idx >= eval_start - 20) AS {prefix}_late,
          sum(exp(0.02 * (row_idx - eval_start + 1)) * ({b})) / sum(exp(0.02 * (row_idx - eval_start + 1))) AS {prefix}_exp
          FROM u WHERE NOT is_eval GROUP BY 1)"""


OFFSETS = [f"offset_{k}" for k in ("full", "early", "mid", "late", "exp")]


@query("i01_datum_offsets", f"WITH {SURF}, {offsets_sql('sa', 'offset', 'o')} SELECT user_id, {rounded(*OFFSETS)} FROM o")
def datum_offsets(spark, sf):
    return show(datum.datum_offsets(surfaces(spark, sf), "sa", 20, keys=KEYS), KEYS, OFFSETS)


PREDICTED = [f"{s}_{k}" for s in ("sa", "sb") for k in ("full", "late", "exp")]


@query(
    "i02_datum_predict",
    f"""WITH {SURF}, {offsets_sql("sa", "a", "oa")}, {offsets_sql("sb", "b", "ob")},
        o AS (SELECT u.user_id, row_idx, {", ".join(f"{s} - z + {p}_{k} AS {s}_{k}" for s, p in (("sa", "a"), ("sb", "b")) for k in ("full", "late", "exp"))}
          FROM u JOIN oa USING (user_id) JOIN ob USING (user_id)) SELECT user_id, row_idx, {rounded(*PREDICTED)} FROM o""",
)
def datum_predict(spark, sf):
    return show(datum.datum_predict(surfaces(spark, sf), ["sa", "sb"], 20, keys=KEYS), ID, PREDICTED)


SPREAD = [f"surface_{k}" for k in ("mean", "std", "min", "max", "range")]


@query(
    "i03_surface_spread",
    f"""WITH {SURF}, o AS (SELECT user_id, row_idx, list_avg([sa, sb, sc]) AS surface_mean, list_stddev_pop([sa, sb, sc]) AS surface_std, least(sa, sb, sc) AS surface_min,
          greatest(sa, sb, sc) AS surface_max, greatest(sa, sb, sc) - least(sa, sb, sc) AS surface_range FROM u) SELECT user_id, row_idx, {rounded(*SPREAD)} FROM o""",
)
def surface_spread(spark, sf):
    return show(datum.surface_spread(surfaces(spark, sf), SURFACES), ID, SPREAD)


@query(
    "i04_surface_error",
    f"""WITH {SURF}, l AS (SELECT user_id, 'sa' AS surface, tvt_input + z - sa AS b FROM u WHERE NOT is_eval UNION ALL SELECT user_id, 'sb', tvt_input + z - sb FROM u WHERE NOT is_eval),
        m AS (SELECT user_id, surface, quantile_cont(b, 0.5) AS offs, avg(b) AS bias FROM l GROUP BY 1, 2)
        SELECT user_id, surface, round(max(offs), 6) + 0.0 AS "offset", round(max(bias), 6) + 0.0 AS bias, round(sqrt(avg((b - offs) * (b - offs))), 6) + 0.0 AS prefix_rmse
        FROM l JOIN m USING (user_id, surface) GROUP BY 1, 2""",
)
def surface_error(spark, sf):
    found = datum.surface_error(surfaces(spark, sf), ["sa", "sb"], keys=KEYS)
    return show(found, [*KEYS, "surface"], ["offset", "bias", "prefix_rmse"])


@query(
    "i05_contact_predict",
    f"""WITH {SURF}, {REFERENCE}, c AS (SELECT ref_id, coalesce(min(tvt) FILTER (geology = 'SMALL'), min(tvt)) AS c FROM r GROUP BY 1),
        m AS (SELECT user_id, ref_id, avg(value - (sa - z)) AS m FROM u GROUP BY 1, 2)
        SELECT u.user_id, row_idx, round(c + (sa - z) + (m - c), 5) + 0.0 AS contact_value FROM u JOIN m ON m.user_id = u.user_id JOIN c ON c.ref_id = u.ref_id""",
)
def contact_predict(spark, sf):
    curve = prepare_reference(reference(spark, sf), label="geology", keys=REF_KEYS)
    found = datum.contact_predict(surfaces(spark, sf), curve, "SMALL", "sa", "value", keys=KEYS, ref_keys=REF_KEYS)
    return show(found, ID, ["contact_value"], 5)


@query(
    "i06_identity_check",
    f"""WITH {SURF}, k AS (SELECT user_id, stddev_samp(value - (sa - z)) AS d, stddev_samp(value - (sc - z)) AS e FROM u GROUP BY 1)
        SELECT 'sa' AS surface, count(*) AS entities, round(max(d), 6) + 0.0 AS worst_std, round(quantile_cont(d, 0.5), 6) + 0.0 AS median_std FROM k
        UNION ALL SELECT 'sc', count(*), round(max(e), 6) + 0.0, round(quantile_cont(e, 0.5), 6) + 0.0 FROM k""",
)
def identity_check(spark, sf):
    rows = surfaces(spark, sf)
    both = [
        datum.identity_check(rows, s, "value", keys=KEYS).withColumn("surface", F.lit(s)) for s in ("sa", "sc")
    ]
    return show(both[0].unionByName(both[1]), ["surface", "entities"], ["worst_std", "median_std"])
