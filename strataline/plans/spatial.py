"""Queries for spatial neighbours."""

from pyspark.sql import functions as F

from strataline.operators import spatial
from strataline.plans.datum import SURF, surfaces
from strataline.plans.fixtures import ID, KEYS, SERIES, rounded, series, show, table
from strataline.plans.registry import query


def points(spark, sf):
    parts = {n: F.get("embedding", F.lit(i)).cast("double") for i, n in enumerate(["x", "y", "v", "w"])}
    return table(spark, sf, "embeddings").select("vec_id", "label", *[c.alias(n) for n, c in parts.items()])


POINTS = """
pt AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v, embedding[4]::DOUBLE AS w FROM embeddings),
sc AS (SELECT CASE WHEN stddev_pop(x) < 1e-3 THEN 1 ELSE stddev_pop(x) END AS sx, CASE WHEN stddev_pop(y) < 1e-3 THEN 1 ELSE stddev_pop(y) END AS sy FROM pt)"""


def ranked(condition, scaled=True):
    sx, sy = ("/ sx", "/ sy") if scaled else ("", "")
    return f"""nb AS (SELECT a.vec_id, a.label, a.x AS ax, a.y AS ay, b.vec_id AS other, b.label AS olabel, b.x, b.y, b.v, b.w,
          sqrt(pow((a.x - b.x) {sx}, 2) + pow((a.y - b.y) {sy}, 2)) AS d FROM pt a, pt b, sc WHERE {condition}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM nb)"""


@query(
    "h01_entity_centroids",
    f"""WITH {SURF}, o AS (SELECT user_id, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y, quantile_cont(sa, 0.5) AS sa, quantile_cont(sb, 0.5) AS sb FROM u GROUP BY 1)
        SELECT user_id, {rounded("x", "y", "sa", "sb")} FROM o""",
)
def entity_centroids(spark, sf):
    return show(spatial.entity_centroids(surfaces(spark, sf), ["sa", "sb"], keys=KEYS), KEYS, ["x", "y", "sa", "sb"])


def plane_sql(value):
    return f"""sum(wt * dx * dx) + 1e-9 AS a, sum(wt * dx * dy) AS b, sum(wt * dx) AS c, sum(wt * dy * dy) + 1e-9 AS e, sum(wt * dy) AS f, sum(wt) + 1e-9 AS g,
          sum(wt * dx * {value}) AS p, sum(wt * dy * {value}) AS q, sum(wt * {value}) AS r"""


def plane_value(alias):
    a = {n: f"{alias}.{n}" for n in "abcefgpqr"}
    top = f"({a['a']} * ({a['e']} * {a['r']} - {a['q']} * {a['f']}) - {a['b']} * ({a['b']} * {a['r']} - {a['q']} * {a['c']}) + {a['p']} * ({a['b']} * {a['f']} - {a['e']} * {a['c']}))"
    det = f"({a['a']} * ({a['e']} * {a['g']} - {a['f']} * {a['f']}) - {a['b']} * ({a['b']} * {a['g']} - {a['f']} * {a['c']}) + {a['c']} * ({a['b']} * {a['f']} - {a['e']} * {a['c']}))"
    return f"{top} / {det}"


@query(
    "h02_knn_plane",
    f"""WITH {POINTS}, {ranked("a.vec_id <> b.vec_id")}, t AS (SELECT vec_id, d, x - ax AS dx, y - ay AS dy, v, w, 1 / (d + 1e-3) AS wt FROM rk WHERE k <= 10),
        pv AS (SELECT vec_id, min(d) AS d, {plane_sql("v")} FROM t GROUP BY 1), pw AS (SELECT vec_id, {plane_sql("w")} FROM t GROUP BY 1)
        SELECT pv.vec_id, round({plane_value("pv")}, 6) + 0.0 AS plane_v, round({plane_value("pw")}, 6) + 0.0 AS plane_w, round(d, 6) + 0.0 AS nearest_distance
        FROM pv JOIN pw ON pv.vec_id = pw.vec_id""",
)
def knn_plane(spark, sf):
    rows = points(spark, sf)
    found = spatial.knn_plane(rows, rows, ["v", "w"], 10, ids=["vec_id"], entity="vec_id")
    return show(found, ["vec_id"], ["plane_v", "plane_w", "nearest_distance"])


@query(
    "h03_even_sample",
    f"""WITH {SERIES} SELECT DISTINCT s.user_id, row_idx, value FROM s, range(20) t(i) WHERE row_idx = (i * (n - 1)) // (least(n, 20) - 1) AND i < least(n, 20)""",
)
def even_sample(spark, sf):
    return spatial.even_sample(series(spark, sf), 20, keys=KEYS).select(*ID, "value")


IDW = ["idw_value", "idw_spread", "nearest_distance"]


@query(
    "h04_knn_idw",
    f"""WITH {POINTS}, {ranked("a.label <> b.label")}, t AS (SELECT vec_id, d, v, 1 / (d + 1e-3) AS wt FROM rk WHERE k <= 20),
        m AS (SELECT vec_id, sum(wt * v) / sum(wt) AS idw_value, min(d) AS nearest_distance FROM t GROUP BY 1),
        o AS (SELECT vec_id, max(idw_value) AS idw_value, sqrt(sum(wt * (v - idw_value) * (v - idw_value)) / sum(wt)) AS idw_spread, max(nearest_distance) AS nearest_distance FROM t JOIN m USING (vec_id) GROUP BY 1)
        SELECT vec_id, {rounded(*IDW)} FROM o""",
)
def knn_idw(spark, sf):
    rows = points(spark, sf)
    found = spatial.knn_idw(rows, rows, "v", 20, ids=["vec_id"], differ=("label", "label"), tie="vec_id")
    return show(found, ["vec_id"], IDW)


ROWS = ["knn_v", "knn_w", "knn_std"]


@query(
    "h05_knn_rows",
    f"""WITH {POINTS}, {ranked("TRUE", False)}, f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label = olabel, k) AS j FROM rk WHERE k <= 40),
        t AS (SELECT vec_id, v, w, 1 / (d + 1e-6) AS wt FROM f WHERE j <= 20),
        o AS (SELECT vec_id, sum(wt * v) / sum(wt) AS knn_v, sum(wt * w) / sum(wt) AS knn_w, (stddev_pop(v) + stddev_pop(w)) / 2 AS knn_std, count(*) AS neighbours FROM t GROUP BY 1)
        SELECT vec_id, neighbours, {rounded(*ROWS)} FROM o""",
)
def knn_rows(spark, sf):
    rows = points(spark, sf)
    found = spatial.knn_rows(rows, rows, ["v", "w"], 40, 20, ids=["vec_id"], entity="label", tie="vec_id")
    return show(found, ["vec_id", "neighbours"], ROWS)


LOO = ["loo_rmse", "loo_mae", "p90_abs_error", "median_nearest"]


@query(
    "h06_loo_knn_error",
    f"""WITH {POINTS}, {ranked("a.vec_id <> b.vec_id", False)}, t AS (SELECT vec_id, d, v, w, 1 / greatest(d, 1e-6) AS wt FROM rk WHERE k <= 8),
        g AS (SELECT vec_id, sum(wt * v) / sum(wt) AS gv, sum(wt * w) / sum(wt) AS gw, min(d) AS md FROM t GROUP BY 1),
        e AS (SELECT 'v' AS surface, v - gv AS err, md FROM pt JOIN g USING (vec_id) UNION ALL SELECT 'w', w - gw, md FROM pt JOIN g USING (vec_id)),
        o AS (SELECT surface, count(*) AS entities, sqrt(avg(err * err)) AS loo_rmse, avg(abs(err)) AS loo_mae, quantile_cont(abs(err), 0.9) AS p90_abs_error, quantile_cont(md, 0.5) AS median_nearest FROM e GROUP BY 1)
        SELECT surface, entities, {rounded(*LOO)} FROM o""",
)
def loo_knn_error(spark, sf):
    return show(spatial.loo_knn_error(points(spark, sf), ["v", "w"], 8, entity="vec_id")[1], ["surface", "entities"], LOO)


@query(
    "h07_neighbor_dip",
    f"""WITH {SERIES}, g AS (SELECT *, (value - lag(value) OVER w) / nullif(md - lag(md) OVER w, 0) AS dp FROM s WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)),
        c AS (SELECT user_id, avg(dp) AS dip, avg(x) AS x, avg(y) AS y FROM g GROUP BY 1),
        r AS (SELECT a.user_id, b.dip AS od, row_number() OVER (PARTITION BY a.user_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.user_id) AS k
          FROM c a JOIN c b ON a.user_id <> b.user_id WHERE b.dip IS NOT NULL),
        m AS (SELECT user_id, avg(od) AS neighbor_dip, count(*) AS neighbours FROM r WHERE k <= 3 GROUP BY 1)
        SELECT c.user_id, neighbours, round(dip, 5) + 0.0 AS dip, round(neighbor_dip, 5) + 0.0 AS neighbor_dip FROM c LEFT JOIN m USING (user_id)""",
)
def neighbor_dip(spark, sf):
    found = spatial.neighbor_dip(series(spark, sf), 3, "value", key="user_id")
    return show(found, ["user_id", "neighbours"], ["dip", "neighbor_dip"], 5)


@query(
    "h08_spatial_elevation",
    f"""WITH {SERIES}, sp AS (SELECT DISTINCT s.user_id, row_idx, x, y, value + z AS el FROM s, range(80) t(i) WHERE row_idx = (i * (n - 1)) // (least(n, 80) - 1) AND i < least(n, 80)),
        nb AS (SELECT s.user_id, s.row_idx, el, sqrt(pow(s.x - sp.x, 2) + pow(s.y - sp.y, 2)) AS d, row_number() OVER (PARTITION BY s.user_id, s.row_idx
          ORDER BY sqrt(pow(s.x - sp.x, 2) + pow(s.y - sp.y, 2)), sp.user_id, sp.row_idx) AS k FROM s, sp WHERE s.user_id % 5 <> sp.user_id % 5),
        g AS (SELECT user_id, row_idx, sum(el / d) / sum(1 / d) AS guess FROM nb WHERE k <= 30 GROUP BY 1, 2),
        b AS (SELECT user_id, quantile_cont(value + z - guess, 0.5) AS bias FROM s JOIN g USING (user_id, row_idx) WHERE NOT is_eval GROUP BY 1)
        SELECT s.user_id, s.row_idx, round(guess - z, 5) + 0.0 AS spatial_raw, round(guess - z + bias, 5) + 0.0 AS spatial_anchored
        FROM s LEFT JOIN g USING (user_id, row_idx) JOIN b ON b.user_id = s.user_id WHERE is_eval""",
)
def spatial_elevation(spark, sf):
    rows = series(spark, sf).withColumn("fold", F.col("user_id") % 5)
    found = spatial.spatial_elevation(rows, "fold", 80, 30, "value", key="user_id")
    return show(found, ID, ["spatial_raw", "spatial_anchored"], 5)
