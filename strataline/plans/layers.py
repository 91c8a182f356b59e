"""Queries for layers of the reference curve and category encoding."""

from pyspark.sql import functions as F

from strataline.operators import layers
from strataline.operators.align import prepare_reference
from strataline.plans.align import PROBES, probes
from strataline.plans.fixtures import ID, REF_KEYS, REFERENCE, SERIES, reference, rounded, series, show, table
from strataline.plans.registry import query

KEY = {"keys": REF_KEYS}

RUNS = """
rl AS (SELECT *, lag(geology) OVER w AS pg, lag(tvt) OVER w AS pt FROM r WINDOW w AS (PARTITION BY ref_id ORDER BY tvt)),
rn AS (SELECT *, sum(CASE WHEN pg IS NULL OR pg <> geology THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY tvt) - 1 AS run_id FROM rl),
ms AS (SELECT ref_id, quantile_cont(tvt - pt, 0.5) AS step FROM rl GROUP BY 1),
ru AS (SELECT ref_id, CAST(run_id AS BIGINT) AS run_id, max(geology) AS label, min(tvt) AS top, max(tvt) AS bottom,
         greatest(max(tvt) - min(tvt) + max(step), 0) AS thickness, count(*) AS rows FROM rn JOIN ms USING (ref_id) GROUP BY 1, 2),
rc AS (SELECT *, coalesce(lag(label) OVER w, label) AS above, coalesce(lead(label) OVER w, label) AS below,
         count(*) OVER (PARTITION BY ref_id) AS n_runs FROM ru WINDOW w AS (PARTITION BY ref_id ORDER BY run_id)),
bo AS (SELECT ref_id, tvt AS boundary, (tvt + pt) / 2 AS midpoint FROM rl WHERE pg <> geology)"""


def labelled(spark, sf):
    return prepare_reference(reference(spark, sf), label="geology", keys=REF_KEYS)


@query(
    "g01_label_runs",
    f"WITH {REFERENCE}, {RUNS} SELECT ref_id, run_id, label, top, bottom, round(thickness, 6) + 0.0 AS thickness, rows FROM ru",
)
def label_runs(spark, sf):
    return show(layers.label_runs(labelled(spark, sf), **KEY), ["ref_id", "run_id", "label", "top", "bottom", "rows"], ["thickness"])


@query("g02_label_boundaries", f"WITH {REFERENCE}, {RUNS} SELECT ref_id, boundary, round(midpoint, 6) + 0.0 AS midpoint FROM bo")
def label_boundaries(spark, sf):
    return show(layers.label_boundaries(labelled(spark, sf), **KEY), ["ref_id", "boundary"], ["midpoint"])


NEAR = """
nn AS (SELECT q.*, CASE WHEN b.tvt IS NULL OR (a.tvt IS NOT NULL AND (q.place - a.tvt < b.tvt - q.place OR q.place = a.tvt)) THEN a.tvt ELSE b.tvt END AS at_x
       FROM q ASOF LEFT JOIN r a ON a.ref_id = q.ref_id AND q.place >= a.tvt ASOF LEFT JOIN r b ON b.ref_id = q.ref_id AND q.place < b.tvt),
nl AS (SELECT nn.*, rn.run_id AS run_id FROM nn LEFT JOIN rn ON rn.ref_id = nn.ref_id AND rn.tvt = nn.at_x)"""
LAYER = ["layer_top", "layer_bottom", "layer_thickness", "distance_to_top", "distance_to_bottom"]


@query(
    "g03_layer_lookup",
    f"""WITH {SERIES}, {REFERENCE}, {RUNS}, {PROBES}, {NEAR}, o AS (SELECT nl.user_id, nl.row_idx, label AS layer_label, above AS layer_above, below AS layer_below,
          top AS layer_top, bottom AS layer_bottom, thickness AS layer_thickness, greatest(place - top, 0) AS distance_to_top, greatest(bottom - place, 0) AS distance_to_bottom
          FROM nl LEFT JOIN rc ON rc.ref_id = nl.ref_id AND rc.run_id = nl.run_id)
        SELECT user_id, row_idx, layer_label, layer_above, layer_below, {rounded(*LAYER)} FROM o""",
)
def layer_lookup(spark, sf):
    found = layers.layer_lookup(probes(spark, sf), labelled(spark, sf), "place", **KEY)
    return show(found, [*ID, "layer_label", "layer_above", "layer_below"], LAYER)


CONTEXT = ["layer_fraction", "layer_top", "layer_bottom", "label_mean", "label_std", "log_minus_label", "log_label_z"]


def label_at(offset, name):
    return f"""{name} AS (SELECT q.user_id, q.row_idx, CASE WHEN b.tvt IS NULL OR (a.tvt IS NOT NULL AND (q.place + {offset} - a.tvt < b.tvt - (q.place + {offset}) OR q.place + {offset} = a.tvt))
          THEN a.geology ELSE b.geology END AS g FROM q ASOF LEFT JOIN r a ON a.ref_id = q.ref_id AND q.place + {offset} >= a.tvt ASOF LEFT JOIN r b ON b.ref_id = q.ref_id AND q.place + {offset} < b.tvt)"""


@query(
    "g04_layer_context",
    f"""WITH {SERIES}, {REFERENCE}, {RUNS}, {PROBES}, {NEAR}, ls AS (SELECT ref_id, geology, avg(gr) AS label_mean,
          CASE WHEN stddev_pop(gr) > 1e-6 THEN stddev_pop(gr) ELSE 1 END AS label_std FROM r GROUP BY 1, 2),
        {label_at("3.0", "lp")}, {label_at("-3.0", "lm")},
        dc AS (SELECT q.user_id, q.row_idx, count(DISTINCT geology) AS distinct_labels FROM q LEFT JOIN r ON r.ref_id = q.ref_id AND tvt BETWEEN place - 2 AND place + 2 GROUP BY 1, 2),
        o AS (SELECT nl.user_id, nl.row_idx, CAST(nl.run_id + 1 AS BIGINT) AS layer_index, CAST(n_runs - nl.run_id AS BIGINT) AS layer_index_from_bottom, n_runs AS n_layers,
          (place - top) / (bottom - top + 1e-6) AS layer_fraction, top AS layer_top, bottom AS layer_bottom, label_mean, label_std,
          gr - label_mean AS log_minus_label, (gr - label_mean) / (label_std + 1e-6) AS log_label_z, lp.g AS label_p3, lm.g AS label_m3, distinct_labels
          FROM nl JOIN rc ON rc.ref_id = nl.ref_id AND rc.run_id = nl.run_id JOIN ls ON ls.ref_id = nl.ref_id AND ls.geology = rc.label
          JOIN lp ON lp.user_id = nl.user_id AND lp.row_idx = nl.row_idx JOIN lm ON lm.user_id = nl.user_id AND lm.row_idx = nl.row_idx
          JOIN dc ON dc.user_id = nl.user_id AND dc.row_idx = nl.row_idx)
        SELECT user_id, row_idx, layer_index, layer_index_from_bottom, n_layers, label_p3, label_m3, distinct_labels, {rounded(*CONTEXT, digits=4)} FROM o""",
)
def layer_context(spark, sf):
    found = layers.layer_context(
        probes(spark, sf), labelled(spark, sf), "place", offsets=(3.0, -3.0), radius=2.0, ids=ID, **KEY
    )
    ids = [*ID, "layer_index", "layer_index_from_bottom", "n_layers", "label_p3", "label_m3", "distinct_labels"]
    return show(found, ids, CONTEXT, 4)


INTERVAL = [
    "prev_boundary_dist", "next_boundary_dist", "interval_thickness", "interval_phase",
    "phase_sin", "phase_cos", "boundary_balance", "boundary_proximity",
]


@query(
    "g05_interval_context",
    f"""WITH {SERIES}, {REFERENCE}, {RUNS}, {PROBES}, bd AS (SELECT ref_id, boundary AS b FROM bo UNION SELECT ref_id, lo FROM rb UNION SELECT ref_id, hi FROM rb),
        iv AS (SELECT * FROM (SELECT ref_id, b AS t, lead(b) OVER (PARTITION BY ref_id ORDER BY b) AS u FROM bd) WHERE u IS NOT NULL),
        f AS (SELECT q.*, greatest(place, lo) AS pl FROM q JOIN rb USING (ref_id)),
        j AS (SELECT f.user_id, f.row_idx, place - t AS p, u - place AS x, u - t AS th FROM f ASOF JOIN iv ON iv.ref_id = f.ref_id AND f.pl >= iv.t),
        o AS (SELECT user_id, row_idx, p AS prev_boundary_dist, x AS next_boundary_dist, th AS interval_thickness, p / th AS interval_phase, sin(pi() * p / th) AS phase_sin,
          cos(pi() * p / th) AS phase_cos, (x - p) / (th + 1e-6) AS boundary_balance, least(p, x) / (th + 1e-6) AS boundary_proximity FROM j)
        SELECT user_id, row_idx, {rounded(*INTERVAL, digits=5)} FROM o""",
)
def interval_context(spark, sf):
    return show(layers.interval_context(probes(spark, sf), labelled(spark, sf), "place", **KEY), ID, INTERVAL, 5)


@query(
    "g06_boundary_count",
    f"""WITH {SERIES}, {REFERENCE}, {RUNS}, {PROBES} SELECT q.user_id, q.row_idx, count(boundary) AS boundaries_crossed FROM q
        LEFT JOIN bo ON bo.ref_id = q.ref_id AND boundary > least(prior, place) AND boundary <= greatest(prior, place) GROUP BY 1, 2""",
)
def boundary_count(spark, sf):
    return layers.boundary_count(probes(spark, sf), labelled(spark, sf), "prior", "place", **KEY).select(*ID, "boundaries_crossed")


@query(
    "g07_boundary_distance",
    f"""WITH {SERIES}, {REFERENCE}, {RUNS}, {PROBES} SELECT q.user_id, q.row_idx, round(least(coalesce(min(abs(place - midpoint)), 2), 2), 6) + 0.0 AS boundary_distance
        FROM q LEFT JOIN bo ON bo.ref_id = q.ref_id GROUP BY 1, 2""",
)
def boundary_distance(spark, sf):
    return show(layers.boundary_distance(probes(spark, sf), labelled(spark, sf), "place", 2.0, **KEY), ID, ["boundary_distance"])


SUMMARY = ["x_min", "x_max", "x_span", "log_min", "log_max", "log_median", "modal_step"]


@query(
    "g08_reference_summary",
    f"""WITH {REFERENCE}, {RUNS}, st AS (SELECT ref_id, round(tvt - pt, 6) AS d, count(*) AS c FROM rl WHERE pt IS NOT NULL GROUP BY 1, 2),
        mo AS (SELECT ref_id, arg_max(d, (c, -d)) AS modal_step FROM st GROUP BY 1),
        o AS (SELECT ref_id, count(*) AS n_rows, min(tvt) AS x_min, max(tvt) AS x_max, max(tvt) - min(tvt) AS x_span, min(gr) AS log_min, max(gr) AS log_max,
          quantile_cont(gr, 0.5) AS log_median, count(DISTINCT geology) AS n_labels FROM r GROUP BY 1)
        SELECT ref_id, n_rows, n_labels, {rounded(*SUMMARY)} FROM o JOIN mo USING (ref_id)""",
)
def reference_summary(spark, sf):
    return show(layers.reference_summary(labelled(spark, sf), **KEY), ["ref_id", "n_rows", "n_labels"], SUMMARY)


@query(
    "g09_top_frequencies",
    "SELECT p_type AS value, count(*) AS rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
)
def top_frequencies(spark, sf):
    return layers.top_frequencies(table(spark, sf, "part"), "p_type", 4)


def encoded_tables(spark, sf):
    orders = table(spark, sf, "orders").withColumn("fold", F.col("o_custkey") % 5)
    return orders.where(F.col("o_custkey") % 7 != 0), orders.where(F.col("o_custkey") % 7 == 0)


@query(
    "g10_target_encode",
    """WITH o AS (SELECT *, o_custkey % 5 AS fold FROM orders), tr AS (SELECT * FROM o WHERE o_custkey % 7 <> 0), te AS (SELECT * FROM o WHERE o_custkey % 7 = 0),
        g AS (SELECT avg(o_totalprice) AS g FROM tr), p AS (SELECT fold, o_orderpriority AS c, sum(o_totalprice) AS s, count(*) AS n FROM tr GROUP BY 1, 2),
        w AS (SELECT c, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1),
        a AS (SELECT o_orderkey, 'train' AS part, (w.s - p.s + g * 20) / (w.n - p.n + 20) AS encoded FROM tr JOIN p ON p.fold = tr.fold AND p.c = o_orderpriority JOIN w ON w.c = p.c, g),
        b AS (SELECT o_orderkey, 'test' AS part, (w.s + g * 20) / (w.n + 20) AS encoded FROM te JOIN w ON w.c = o_orderpriority, g)
        SELECT o_orderkey, part, round(encoded, 4) + 0.0 AS encoded FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def target_encode(spark, sf):
    train, test = layers.target_encode(*encoded_tables(spark, sf), "o_orderpriority", "o_totalprice", "fold")
    both = train.select("o_orderkey", F.lit("train").alias("part"), "encoded").unionByName(
        test.select("o_orderkey", F.lit("test").alias("part"), "encoded")
    )
    return show(both, ["o_orderkey", "part"], ["encoded"], 4)


@query(
    "g11_encode_categories",
    """WITH v AS (SELECT o_orderpriority AS c, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
        SELECT o_orderkey, code AS o_orderpriority_code FROM orders JOIN v ON c = o_orderpriority""",
)
def encode_categories(spark, sf):
    train, test = layers.encode_categories(*encoded_tables(spark, sf), ["o_orderpriority"])
    return train.unionByName(test).select("o_orderkey", "o_orderpriority_code")
