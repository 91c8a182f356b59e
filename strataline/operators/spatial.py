"""Values borrowed from neighbours in the plane; a series never sees its own points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.nearest import nearest_points
from strataline.functions.quantiles import add_overall, key_percentiles
from strataline.functions.series import ROW, Frame, apply_frames, attach, longest, with_bound, with_key_stats

WELL = ("well_id",)


def entity_centroids(df: DataFrame, cols: Sequence[str], xy: Sequence[str] = ("x", "y"), *, keys=WELL, row=ROW) -> DataFrame:
    """Median position and median surfaces per series, over rows where all are known."""
    known = df.dropna(subset=[*xy, *cols])
    return key_percentiles(known, keys, {c: (c, 0.5) for c in [*xy, *cols]}, row)


def axis_scale(points: DataFrame, xy: Sequence[str]) -> list[float]:
    """Population std per axis, 1 for an axis without spread: two numbers for the whole table."""
    found = points.agg(*[F.stddev_pop(c) for c in xy]).first()
    return [1.0 if v is None or v < 1e-3 else float(v) for v in found]


def _plane_at_query(weights: str, dx: Column, dy: Column, value: Column) -> tuple[dict[str, Column], Column]:
    """Weighted sums for a plane around the probe, and the plane's value there (Cramer's rule, ridge 1e-9)."""
    w = F.col(weights)
    sums = {
        "_xx": F.sum(w * dx * dx), "_xy": F.sum(w * dx * dy), "_yy": F.sum(w * dy * dy),
        "_x": F.sum(w * dx), "_y": F.sum(w * dy), "_1": F.sum(w),
        "_vx": F.sum(w * dx * value), "_vy": F.sum(w * dy * value), "_v": F.sum(w * value),
    }
    a, b, c = F.col("_xx") + 1e-9, F.col("_xy"), F.col("_x")
    d, e, f = F.col("_yy") + 1e-9, F.col("_y"), F.col("_1") + 1e-9
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    top = (
        a * (d * F.col("_v") - F.col("_vy") * e)
        - b * (b * F.col("_v") - F.col("_vy") * c)
        + F.col("_vx") * (b * e - d * c)
    )
    return sums, F.try_divide(top, det)


def knn_plane(
    query: DataFrame,
    points: DataFrame,
    surfaces: Sequence[str],
    k: int = 10,
    xy: Sequence[str] = ("x", "y"),
    *,
    ids: Sequence[str] = (*WELL, ROW),
    entity: str = "well_id",
) -> DataFrame:
    """Inverse-distance plane through the k nearest other entities, per surface, evaluated at the probe.

    Axes are scaled by their spread; weights are 1/(d + 1e-3). Without neighbours: the mean of the surface.
    Returns ``plane_<surface>`` and ``nearest_distance``.
    """
    scale = axis_scale(points, xy)
    there = [f"to_{c}" for c in xy]
    placed = points.select(
        F.col(entity).alias("_other"), *xy, *[F.col(c).cast("double").alias(t) for c, t in zip(xy, there)], *surfaces
    )
    near = nearest_points(
        query, placed, xy, k, ids=ids, differ=(entity, "_other"), payload=[*there, *surfaces], tie="_other", scale=scale
    )
    own = query.select(*ids, *[F.col(c).cast("double").alias(f"_{c}") for c in xy])
    rows = near.join(own, list(ids)).withColumn("_w", 1 / (F.col("distance") + 1e-3))
    dx, dy = F.col(f"to_{xy[0]}") - F.col(f"_{xy[0]}"), F.col(f"to_{xy[1]}") - F.col(f"_{xy[1]}")
    long = rows.select(
        *ids, "_w", "distance", dx.alias("_dx"), dy.alias("_dy"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).cast("double").alias("value")) for s in surfaces])).alias("_s"),
    ).select("*", "_s.s", "_s.value")
    sums, at_query = _plane_at_query("_w", F.col("_dx"), F.col("_dy"), F.col("value"))
    fitted = long.groupBy(*ids, "s").agg(*[c.alias(n) for n, c in sums.items()], F.min("distance").alias("_d"))
    wide = fitted.withColumn("_p", at_query).groupBy(*ids).agg(
        *[F.max(F.when(F.col("s") == s, F.col("_p"))).alias(f"plane_{s}") for s in surfaces],
        F.min("_d").alias("nearest_distance"),
    )
    means = points.agg(*[F.avg(s).alias(f"_mean_{s}") for s in surfaces])
    joined = add_overall(query.select(*ids).join(wide, list(ids), "left"), means)
    return joined.select(
        *ids, *[F.coalesce(f"plane_{s}", f"_mean_{s}").alias(f"plane_{s}") for s in surfaces], "nearest_distance"
    )


def even_sample(df: DataFrame, n: int, *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """At most n rows per series, evenly spaced, both ends included: rows ``floor(i·(N−1)/(n−1))``.

    A filter on the row number: whether some i gives a row can be told from the row itself.
    """
    sized = with_key_stats(df, keys, {"_N": F.count(F.lit(1))}, row)
    take = F.least(F.col("_N"), F.lit(n))
    span, steps = F.col("_N") - 1, take - 1
    i = F.when(span > 0, F.ceil(F.col(row) * steps / span)).otherwise(0)
    hit = F.when(steps > 0, F.floor(i * span / steps) == F.col(row)).otherwise(F.col(row) == 0)
    return sized.where(hit).drop("_N")


def knn_idw(
    query: DataFrame,
    points: DataFrame,
    value: str,
    k: int = 20,
    xy: Sequence[str] = ("x", "y"),
    epsilon: float = 1e-3,
    *,
    ids: Sequence[str] = (*WELL, ROW),
    differ: tuple[str, str] | None = ("well_id", "well_id"),
    tie: str = "_point",
    scale: Sequence[float] | None = None,
) -> DataFrame:
    """Inverse-distance mean of the k nearest points, weighted spread, and nearest distance.

    ``differ`` names the columns of probe and point that must not be equal. Without neighbours the
    mean of all points. ``tie`` orders points at equal distance.
    """
    scale = list(scale) if scale else axis_scale(points, xy)
    owner = [F.col(differ[1]).alias("_other")] if differ else []
    known = points.select(F.col(value).cast("double").alias("_value"), *xy, *owner, F.col(tie).alias("_tie"))
    near = nearest_points(
        query, known, xy, k, ids=ids, differ=(differ[0], "_other") if differ else None, payload=["_value"], tie="_tie", scale=scale
    )
    weight = 1 / (F.col("distance") + epsilon)
    sums = near.groupBy(*ids).agg(
        F.sum(weight).alias("_w"),
        F.sum(weight * F.col("_value")).alias("_wv"),
        F.min("distance").alias("nearest_distance"),
        F.collect_list(F.struct(weight.alias("w"), F.col("_value").alias("v"))).alias("_all"),
    )
    mean = F.col("_wv") / F.col("_w")
    spread = F.aggregate("_all", F.lit(0.0), lambda a, p: a + p["w"] * (p["v"] - mean) * (p["v"] - mean)) / F.col("_w")
    found = sums.select(*ids, mean.alias("idw_value"), F.sqrt(spread).alias("idw_spread"), "nearest_distance")
    joined = add_overall(query.select(*ids).join(found, list(ids), "left"), points.agg(F.avg(value).alias("_all_mean")))
    return joined.withColumn("idw_value", F.coalesce("idw_value", "_all_mean")).drop("_all_mean")


def knn_rows(
    query: DataFrame,
    points: DataFrame,
    values: Sequence[str],
    k_query: int = 40,
    k_keep: int = 20,
    xy: Sequence[str] = ("x", "y"),
    *,
    ids: Sequence[str] = (*WELL, ROW),
    entity: str = "well_id",
    tie: str = "_point",
) -> DataFrame:
    """Several surfaces from row points: of the k_query nearest the first k_keep of other entities, weights 1/(d + 1e-6).

    Where the k_query nearest hold fewer of others, the nearest of the own entity fill up; a probe without any
    neighbour has NULLs. Also the mean over the surfaces of their population std among the kept neighbours.
    """
    known = points.select(*[F.col(v).cast("double").alias(f"v_{v}") for v in values], *xy, F.col(entity).alias("_other"), F.col(tie).alias("_tie"))
    near = nearest_points(query, known, xy, k_query, ids=ids, payload=["_other", *[f"v_{v}" for v in values]], tie="_tie")
    near = near.join(query.select(*dict.fromkeys([*ids, entity])), list(ids))
    own = F.col("_other").eqNullSafe(F.col(entity)).alias("_own")
    ranked = near.groupBy(*ids).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(own, "rank", "distance", *[f"v_{v}" for v in values]))), 1, k_keep).alias("_n")
    )
    kept = ranked.select(*ids, F.explode("_n").alias("_e")).select(*ids, "_e.*")
    weight = 1 / (F.col("distance") + 1e-6)
    spread = [F.stddev_pop(f"v_{v}") for v in values]
    total = spread[0]
    for s in spread[1:]:
        total = total + s
    found = kept.groupBy(*ids).agg(
        *[(F.sum(weight * F.col(f"v_{v}")) / F.sum(weight)).alias(f"knn_{v}") for v in values],
        (total / float(len(values))).alias("knn_std"),
        F.count(F.lit(1)).alias("neighbours"),
    )
    return query.select(*ids).join(found, list(ids), "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))


def loo_knn_error(
    points: DataFrame, values: Sequence[str], k: int = 8, xy: Sequence[str] = ("x", "y"), *, entity: str = "well_id"
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-out inverse-distance error of each surface at each point, and its summary per surface."""
    others = points.select(F.col(entity).alias("_other"), *xy, *[F.col(v).cast("double").alias(f"v_{v}") for v in values])
    near = nearest_points(
        points, others, xy, k, ids=[entity], differ=(entity, "_other"), payload=[f"v_{v}" for v in values], tie="_other"
    )
    weight = 1 / F.greatest(F.col("distance"), F.lit(1e-6))
    guess = near.groupBy(entity).agg(
        *[(F.sum(weight * F.col(f"v_{v}")) / F.sum(weight)).alias(f"p_{v}") for v in values],
        F.min("distance").alias("nearest_distance"),
    )
    rows = points.join(guess, entity).select(
        entity,
        "nearest_distance",
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("surface"), F.col(v).cast("double").alias("actual"), F.col(f"p_{v}").alias("predicted")) for v in values])
        ).alias("_s"),
    ).select(entity, "_s.*", "nearest_distance")
    rows = rows.withColumn("error", F.col("actual") - F.col("predicted"))
    sums = rows.groupBy("surface").agg(
        F.count_distinct(entity).alias("entities"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("loo_rmse"),
        F.avg(F.abs("error")).alias("loo_mae"),
    )
    shares = key_percentiles(
        rows, ["surface"], {"p90_abs_error": (F.abs(F.col("error")), 0.9), "median_nearest": ("nearest_distance", 0.5)}
    )
    return rows, sums.join(shares, "surface")


def neighbor_dip(
    df: DataFrame,
    k: int = 3,
    target: str = "tvt",
    md: str = "md",
    xy: Sequence[str] = ("x", "y"),
    *,
    key: str = "well_id",
    row: str = ROW,
) -> DataFrame:
    """Mean dip (target step per depth step) of the k nearest other series, by mean position."""
    known = df.where(F.col(target).isNotNull())

    def dip(rows) -> dict[str, Column]:
        run = F.col(md) - F.lag(md, 1).over(rows.order)
        return {"_dip": (F.col(target) - F.lag(target, 1).over(rows.order)) / F.when(run != 0, run)}

    per_key = apply_frames(known, [key], Frame(1, 0, dip), row=row).groupBy(key).agg(
        F.avg("_dip").alias("dip"), *[F.avg(c).alias(c) for c in xy]
    )
    others = per_key.where(F.col("dip").isNotNull()).select(F.col(key).alias("_other"), *xy, "dip")
    near = nearest_points(per_key, others, xy, k, ids=[key], differ=(key, "_other"), payload=["dip"], tie="_other")
    means = near.groupBy(key).agg(F.avg("dip").alias("neighbor_dip"), F.count(F.lit(1)).alias("neighbours"))
    return per_key.select(key, "dip").join(means, key, "left")


def spatial_elevation(
    df: DataFrame,
    fold: str,
    samples: int = 80,
    k: int = 30,
    target: str = "tvt",
    probe: str = "tvt_input",
    z: str = "z",
    xy: Sequence[str] = ("x", "y"),
    *,
    key: str = "well_id",
    row: str = ROW,
) -> DataFrame:
    """Target of the tail from the elevation ``target + z`` of other folds' points, raw and anchored on the prefix.

    Points are an even sample of each series; weights are inverse distances (an exact hit counts
    alone); the anchor is the median prefix residual. Every tail row is there, without neighbours with NULLs.
    """
    points = even_sample(df, samples, keys=[key], row=row).select(
        F.col(fold).alias("_fold"),
        F.struct(F.col(key), F.col(row)).alias("_tie"),
        *xy,
        (F.col(target) + F.col(z)).alias("_s"),
    )
    near = nearest_points(
        df, points, xy, k, ids=[key, row], differ=(fold, "_fold"), payload=["_s"], tie="_tie"
    )
    exact = F.col("distance") == 0
    weight = 1 / F.col("distance")
    found = near.groupBy(key, row).agg(
        F.coalesce(
            F.avg(F.when(exact, F.col("_s"))), F.sum(F.when(~exact, weight * F.col("_s"))) / F.sum(F.when(~exact, weight))
        ).alias("_guess")
    )
    rows = df.select(key, row, z, probe, target).join(found, [key, row], "left")
    bound = longest(df, row)
    rows = with_bound(rows, bound, row) if bound else rows
    miss = rows.where(F.col(probe).isNotNull()).withColumn("_miss", F.col(target) + F.col(z) - F.col("_guess"))
    bias = key_percentiles(miss, [key], {"_bias": ("_miss", 0.5)}, row)
    tail = attach(rows.where(F.col(probe).isNull()), bias, [key], row)
    raw = F.col("_guess") - F.col(z)
    return tail.select(key, row, raw.alias("spatial_raw"), (raw + F.coalesce("_bias", F.lit(0.0))).alias("spatial_anchored"))
