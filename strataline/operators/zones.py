"""Known prefix and evaluation tail: zones, anchors, prefix statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.quantiles import add_overall, overall, with_key_percentiles
from strataline.functions.series import (
    ROW,
    Frame,
    apply_frames,
    carried,
    with_key_stats,
)

WELL = ("well_id",)


def split_zone(df: DataFrame, probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Add ``eval_start`` (first row without a probe value, or the row count), ``in_prefix`` and ``is_eval``."""
    missing = F.col(probe).isNull()
    marked = with_key_stats(
        df, keys, {"_first": F.min(F.when(missing, F.col(row))), "_n": F.count(F.lit(1))}, row
    )
    start = F.coalesce("_first", "_n")
    return marked.withColumns(
        {"eval_start": start, "in_prefix": F.col(row) < start, "is_eval": missing}
    ).drop("_first", "_n")


def zone_info(df: DataFrame, probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Rows, known rows, evaluation rows, first and last evaluation row and number of NULL blocks per key."""
    missing = F.col(probe).isNull()

    def starts(rows) -> dict[str, Column]:
        return {"_starts": (missing & ~F.coalesce(F.lag(missing).over(rows.order), F.lit(False))).cast("long")}

    return apply_frames(df, keys, Frame(1, 0, starts), row=row).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(probe).alias("known_rows"),
        F.sum(missing.cast("long")).alias("eval_rows"),
        F.min(F.when(missing, F.col(row))).alias("first_eval"),
        F.max(F.when(missing, F.col(row))).alias("last_eval"),
        F.sum("_starts").alias("null_blocks"),
    )


def longest_null_run(
    df: DataFrame, col: str, probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Longest run of NULLs in ``col`` per key: all rows, prefix only, tail only."""
    zoned = split_zone(df, probe, keys=keys, row=row)
    seen = carried(zoned, keys, last={"_seen": F.when(F.col(col).isNotNull(), F.col(row))}, row=row)
    since = F.col(row) - F.coalesce("_seen", F.lit(-1))
    gap = F.col(col).isNull()
    in_tail = F.col(row) - F.greatest(F.coalesce("_seen", F.lit(-1)), F.col("eval_start") - 1)

    def best(condition: Column, length: Column) -> Column:
        return F.coalesce(F.max(F.when(condition, length)), F.lit(0).cast("long"))

    return seen.groupBy(*keys).agg(
        best(gap, since).alias("longest_all"),
        best(gap & F.col("in_prefix"), since).alias("longest_prefix"),
        best(gap & ~F.col("in_prefix"), in_tail).alias("longest_tail"),
    )


def last_known(df: DataFrame, values: dict[str, str], probe: str, keys: Sequence[str], row: str = ROW) -> DataFrame:
    """Add ``{output: column}`` of the last row that has a probe value."""
    at = F.when(F.col(probe).isNotNull(), F.col(row))
    point = F.struct(*[F.col(c).alias(o) for o, c in values.items()])
    return with_key_stats(df, keys, {"_anchor": F.max_by(point, at)}, row).select(
        *df.columns, *[F.col(f"_anchor.{o}").alias(o) for o in values]
    )


def anchor_offsets(
    df: DataFrame,
    probe: str = "tvt_input",
    md: str = "md",
    xyz: Sequence[str] = ("x", "y", "z"),
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Offsets of every row from the last known row: depth, x, y, z and horizontal distance."""
    x, y, z = xyz
    anchored = last_known(
        df, {"anchor_value": probe, "_md": md, "_x": x, "_y": y, "_z": z}, probe, keys, row
    )
    dx, dy = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    return anchored.withColumns(
        {
            "delta_md": F.col(md) - F.col("_md"),
            "delta_x": dx,
            "delta_y": dy,
            "delta_z": F.col(z) - F.col("_z"),
            "delta_xy": F.sqrt(dx * dx + dy * dy),
        }
    ).drop("_md", "_x", "_y", "_z")


def carry_last_known(
    df: DataFrame, probe: str = "tvt_input", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Running last known value, its depth and the distance since; only rows at or before are read."""
    point = F.when(F.col(probe).isNotNull(), F.struct(F.col(probe).alias("v"), F.col(md).alias("md")))
    return (
        carried(df, keys, last={"_known": point}, row=row)
        .withColumns(
            {
                "last_known_value": F.col("_known.v"),
                "last_known_md": F.col("_known.md"),
                "dist_from_known": F.col(md) - F.col("_known.md"),
            }
        )
        .drop("_known")
    )


def prefix_linear_fit(
    df: DataFrame, probe: str = "tvt_input", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Line through the known values: slope, intercept, number of values and its value at every row.

    One known value gives a flat line; none gives the median of all known values.
    """
    y, x = F.col(probe), F.when(F.col(probe).isNotNull(), F.col(md))
    fitted = with_key_stats(
        df,
        keys,
        {
            "n_known": F.count(probe),
            "_slope": F.regr_slope(y, x),
            "_my": F.avg(y),
            "_mx": F.avg(x),
        },
        row,
    )
    fitted = add_overall(fitted, overall(df, {"_median": (probe, 0.5)}))
    slope = F.coalesce("_slope", F.lit(0.0))
    return (
        fitted.withColumn("prefix_slope", slope)
        .withColumn(
            "prefix_intercept",
            F.coalesce(F.col("_my") - slope * F.col("_mx"), F.col("_median"), F.lit(0.0)),
        )
        .withColumn("extrapolated", F.col("prefix_slope") * F.col(md) + F.col("prefix_intercept"))
        .drop("_slope", "_my", "_mx", "_median")
    )


def _prefix(df: DataFrame, probe: str, keys: Sequence[str], row: str) -> DataFrame:
    """Prefix rows with ``from_end``: 1 for the last known row, 2 for the one before, …"""
    zoned = split_zone(df, probe, keys=keys, row=row).where(F.col("in_prefix"))
    return zoned.withColumn("from_end", F.col("eval_start") - F.col(row))


def recent_slope(
    df: DataFrame, n: int, probe: str = "tvt_input", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Slope of the last ``n`` known rows, NULL with fewer than two rows or no spread in depth."""
    recent = _prefix(df, probe, keys, row).where(F.col("from_end") <= n)
    spread = F.var_pop(md) * F.count(probe)
    return recent.groupBy(*keys).agg(
        F.when((F.count(probe) >= 2) & (spread > 1e-12), F.regr_slope(F.col(probe), F.col(md))).alias("recent_slope")
    )


def recent_mean_diff(
    df: DataFrame, n: int, probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Mean step over the last ``n`` steps of the known values."""
    recent = _prefix(df, probe, keys, row).where(F.col("from_end") <= n + 1)
    return recent.groupBy(*keys).agg(
        F.when(
            F.count(probe) >= 2,
            (F.max_by(probe, row) - F.min_by(probe, row)) / (F.count(probe) - 1),
        ).alias("recent_mean_diff")
    )


def context_stats(
    df: DataFrame,
    windows: Sequence[int] = (30, 100),
    probe: str = "tvt_input",
    md: str = "md",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Mean, population standard deviation and slope of the last ``w`` known rows, for several ``w`` in one pass."""
    prefix = _prefix(df, probe, keys, row)
    picks = [F.max_by(probe, row).alias("anchor_value")]
    for w in windows:
        y = F.when(F.col("from_end") <= w, F.col(probe))
        enough = F.count(y) >= 2
        picks += [
            F.when(enough, F.avg(y)).alias(f"_mean_{w}"),
            F.when(enough, F.stddev_pop(y)).otherwise(0.0).alias(f"ctx_std_{w}"),
            F.coalesce(F.when(enough, F.regr_slope(y, F.col(md))), F.lit(0.0)).alias(f"ctx_slope_{w}"),
        ]
    stats = prefix.groupBy(*keys).agg(*picks)
    return stats.withColumns({f"ctx_mean_{w}": F.coalesce(f"_mean_{w}", "anchor_value") for w in windows}).drop(
        *[f"_mean_{w}" for w in windows]
    )


def endpoint_slopes(
    df: DataFrame, n: int = 10, probe: str = "tvt_input", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Slope between the ends of the prefix, and between its last and its n-th last row."""
    prefix = _prefix(df, probe, keys, row)
    point = F.struct(F.col(md).alias("md"), F.col(probe).alias("v"))
    ends = prefix.groupBy(*keys).agg(
        F.min_by(point, row).alias("a"),
        F.max_by(point, row).alias("b"),
        F.max(F.when(F.col("from_end") == n, point)).alias("c"),
    )

    def slope(start: str) -> Column:
        run = F.col("b.md") - F.col(f"{start}.md")
        return F.when(run != 0, (F.col("b.v") - F.col(f"{start}.v")) / run)

    whole = F.coalesce(slope("a"), F.lit(0.0))
    return ends.select(*keys, whole.alias("slope_all"), F.coalesce(slope("c"), whole).alias("slope_recent"))


def plane_prior(
    df: DataFrame,
    probe: str = "tvt_input",
    md: str = "md",
    z: str = "z",
    *,
    min_rows: int = 5,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Least-squares plane ``value ≈ a·md + b·z + c`` on the prefix, evaluated at every row, with residual spread."""
    zoned = split_zone(df, probe, keys=keys, row=row)
    known = F.col("in_prefix") & F.col(probe).isNotNull()
    m, d, t = F.when(known, F.col(md)), F.when(known, F.col(z)), F.when(known, F.col(probe))
    fitted = with_key_stats(
        zoned,
        keys,
        {
            "_n": F.count(t),
            "_m": F.avg(m),
            "_z": F.avg(d),
            "_t": F.avg(t),
            "_mm": F.var_pop(m),
            "_zz": F.var_pop(d),
            "_mz": F.covar_pop(m, d),
            "_mt": F.covar_pop(m, t),
            "_zt": F.covar_pop(d, t),
            "_end": F.max_by(t, F.when(known, F.col(row))),
        },
        row,
    )
    det = F.col("_mm") * F.col("_zz") - F.col("_mz") * F.col("_mz")
    flat = det <= F.lit(1e-12) * F.col("_mm") * F.col("_zz")
    a = F.when(flat, F.try_divide(F.col("_mt"), F.col("_mm"))).otherwise(
        (F.col("_mt") * F.col("_zz") - F.col("_zt") * F.col("_mz")) / det
    )
    b = F.when(flat, F.lit(0.0)).otherwise((F.col("_zt") * F.col("_mm") - F.col("_mt") * F.col("_mz")) / det)
    enough = F.col("_n") >= min_rows
    rows = (
        fitted.withColumns({"plane_a": F.when(enough, a), "plane_b": F.when(enough, b)})
        .withColumn("plane_c", F.col("_t") - F.col("plane_a") * F.col("_m") - F.col("plane_b") * F.col("_z"))
        .withColumn("plane_value", F.col("plane_a") * F.col(md) + F.col("plane_b") * F.col(z) + F.col("plane_c"))
        .withColumn("_residual", F.when(known, F.col(probe) - F.col("plane_value")))
    )
    rows = with_key_stats(rows, keys, {"plane_std": F.stddev_pop("_residual")}, row)
    rows = with_key_percentiles(rows, keys, {"plane_p95": (F.abs("_residual"), 0.95)}, row)
    distance = F.sqrt(F.pow(F.col(md) - F.col("_m"), 2) + F.pow(F.col(z) - F.col("_z"), 2))
    outputs = {
        "plane_minus_anchor": F.col("plane_value") - F.col("_end"),
        "plane_distance": F.when(enough, distance),
    }
    names = ["plane_a", "plane_b", "plane_c", "plane_value", "plane_std", "plane_p95", *outputs]
    full = rows.withColumns(outputs).withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    return full.select(*df.columns, *names)


def positional(
    df: DataFrame, probe: str = "tvt_input", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Place of each evaluation row in the tail: fraction, its square and root, depth since the anchor, first-row flag."""
    zoned = split_zone(df, probe, keys=keys, row=row)
    zoned = with_key_stats(
        zoned,
        keys,
        {"_n": F.count(F.lit(1)), "_md": F.max(F.when(F.col("in_prefix"), F.col(md)))},
        row,
    )
    step = F.col(row) - F.col("eval_start")
    tail = F.greatest(F.col("_n") - F.col("eval_start") - 1, F.lit(1))
    return (
        zoned.where(F.col("is_eval"))
        .withColumn("frac", step / tail)
        .withColumns(
            {
                "frac2": F.col("frac") * F.col("frac"),
                "sqrt_frac": F.sqrt("frac"),
                "delta_md": F.col(md) - F.col("_md"),
                "row_frac": F.col(row) / F.greatest(F.col("_n") - 1, F.lit(1)),
                "is_first": (step == 0).cast("int"),
            }
        )
        .withColumn("log1p_delta_md", F.log1p("delta_md"))
        .drop("_n", "_md")
    )


def entity_meta(
    df: DataFrame,
    ref: DataFrame,
    probe: str = "tvt_input",
    log: str = "gr",
    ref_x: str = "tvt",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Known and evaluation length, shares, log NULL share, and size and span of the reference curve."""
    ref_keys = list(ref_keys or keys)
    curves = ref.groupBy(*ref_keys).agg(
        F.count(F.lit(1)).alias("ref_rows"), (F.max(ref_x) - F.min(ref_x)).alias("ref_span")
    )
    extra = [k for k in ref_keys if k not in keys]
    meta = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(probe).alias("known_len"),
        (F.count(F.lit(1)) - F.count(probe)).alias("eval_len"),
        (1 - F.count(probe) / F.count(F.lit(1))).alias("eval_share"),
        (1 - F.count(log) / F.count(F.lit(1))).alias("log_null_share"),
        *[F.min(k).alias(k) for k in extra],
    )
    return meta.join(curves, ref_keys, "left").select(
        *keys,
        "n_rows",
        "known_len",
        "eval_len",
        "eval_share",
        "log_null_share",
        F.coalesce("ref_rows", F.lit(0).cast("long")).alias("ref_rows"),
        F.coalesce("ref_span", F.lit(0.0)).alias("ref_span"),
    )


def knot_targets(
    df: DataFrame,
    knots: Sequence[float],
    target: str = "tvt",
    probe: str = "tvt_input",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Tail curve, relative to the last known value, at fixed fractions of the tail; plus its min, max and end."""
    zoned = last_known(split_zone(df, probe, keys=keys, row=row), {"_anchor": probe}, probe, keys, row)
    zoned = with_key_stats(zoned, keys, {"_n": F.count(F.lit(1))}, row)
    tail = zoned.where(~F.col("in_prefix")).withColumns(
        {
            "_i": F.col(row) - F.col("eval_start"),
            "_span": F.col("_n") - F.col("eval_start") - 1,
            "_d": F.col(target) - F.col("_anchor"),
        }
    )
    picks = []
    for knot in knots:
        place = F.lit(float(knot)) * F.col("_span")
        low, part = F.floor(place), place - F.floor(place)
        weight = F.when(F.col("_i") == low, 1 - part).when(F.col("_i") == low + 1, part)
        picks.append(F.sum(weight * F.col("_d")).alias(f"knot_{round(knot * 100):03d}"))
    return tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tail_len"),
        F.max("_anchor").alias("last_known"),
        *picks,
        F.min("_d").alias("tail_min"),
        F.max("_d").alias("tail_max"),
        F.max_by("_d", "_i").alias("tail_end"),
    )


def truncate_prefix(
    df: DataFrame,
    cuts: int = 3,
    min_known: int = 10,
    probe: str = "tvt_input",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Training variants: the prefix cut at several points, the known rows after the cut as labelled tail.

    Adds ``cut``, the masked probe and ``is_label``; later operators then key on ``(key, cut)``.
    """
    known = with_key_stats(df, keys, {"_known": F.count(probe)}, row)
    known = known.where((F.col("_known") >= min_known + 5) & (F.col(row) < F.col("_known")))
    step = (F.col("_known") - 2 - min_known) / float(max(cuts - 1, 1))
    places = F.array_distinct(F.array(*[F.floor(F.lit(float(min_known)) + F.lit(float(j)) * step) for j in range(cuts)]))
    variants = known.withColumn("cut", F.explode(places))
    return variants.withColumns(
        {
            "masked": F.when(F.col(row) < F.col("cut"), F.col(probe)),
            "is_label": F.col(row) >= F.col("cut"),
        }
    ).drop("_known")
