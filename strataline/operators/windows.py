"""Window features along a series.

Each feature is a ``Frame`` (``*_frame`` functions), so that a chain of features is one
``apply_frames`` call with one exchange; the plain functions apply a single one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.asof import bracket
from strataline.functions.columns import col as as_col
from strataline.functions.quantiles import with_key_percentiles
from strataline.functions.moving import apply_moving, moving_slopes, moving_stats
from strataline.functions.scan import Part, curve_fits, per_part, scan_chunks
from strataline.functions.series import ROW, Frame, Rows, apply_frames, carried, spread_join, with_key_stats

WELL = ("well_id",)
STATS = ("mean", "std", "min", "max")


def _bounds(window: int, center: bool, symmetric: bool) -> tuple[int, int]:
    if symmetric:
        return window // 2, window // 2
    if center:
        return window // 2, (window - 1) // 2
    return window - 1, 0


def rolling_frame(
    value: str | Column,
    windows: Sequence[int],
    stats: Sequence[str] = STATS,
    *,
    prefix: str = "",
    center: bool = False,
    symmetric: bool = False,
) -> list[Frame]:
    """Mean, std (ddof 1, one row gives 0), min, max of trailing, centred or symmetric windows that shrink at the ends."""
    v = as_col(value)
    makers = {
        "mean": F.avg,
        "min": F.min,
        "max": F.max,
        "std": F.stddev_samp,
    }

    def one(w: int) -> Frame:
        before, after = _bounds(w, center, symmetric)

        def columns(rows: Rows) -> dict[str, Column]:
            out = {}
            for s in stats:
                c = makers[s](v).over(rows(-before, after))
                out[f"{prefix}{s}_{w}"] = F.coalesce(c, F.lit(0.0)) if s == "std" else c
            return out

        return Frame(before, after, columns)

    return [one(w) for w in windows]


# Windows of more rows move along arrays, so that their time does not grow with the rows.
WIDE = 100


def rolling_stats(
    df: DataFrame,
    col: str,
    windows: Sequence[int],
    stats: Sequence[str] = STATS,
    *,
    prefix: str = "",
    center: bool = False,
    symmetric: bool = False,
    keys=WELL,
    row: str = ROW,
) -> DataFrame:
    """The statistics of ``rolling_frame``; wide windows in time that does not depend on their width."""
    if max(windows, default=0) <= WIDE:
        return apply_frames(df, keys, rolling_frame(col, windows, stats, prefix=prefix, center=center, symmetric=symmetric), row=row)
    steps = [moving_stats(col, *_bounds(w, center, symmetric), {s: f"{prefix}{s}_{w}" for s in stats}) for w in windows]
    return apply_moving(df, keys, steps, row)


def median_frame(value: str | Column, window: int, out: str = "median", *, center: bool = True) -> Frame:
    before, after = _bounds(window, center, False)
    return Frame(
        before, after, lambda rows: {out: F.percentile(as_col(value), F.lit(0.5)).over(rows(-before, after))}
    )


def rolling_median(df: DataFrame, col: str, window: int, out: str = "median", *, center=True, keys=WELL, row: str = ROW):
    """Median of the known values of a trailing or centred window, in time that does not depend on the window."""
    return apply_moving(df, keys, [moving_stats(col, *_bounds(window, center, False), {"median": out})], row)


def slope_frame(y: str, x: str, window: int, out: str = "slope") -> Frame:
    """Trailing regression slope of ``y`` on ``x``; fewer than two rows or no spread give 0."""
    slope = F.regr_slope(F.col(y), F.col(x))
    return Frame(window - 1, 0, lambda rows: {out: F.coalesce(slope.over(rows(-(window - 1), 0)), F.lit(0.0))})


def rolling_slope(df: DataFrame, y: str, x: str, window: int, out: str = "slope", *, keys=WELL, row: str = ROW):
    if window > WIDE:
        return apply_moving(df, keys, [moving_slopes(y, x, window - 1, 0, out)], row)
    return apply_frames(df, keys, slope_frame(y, x, window, out), row=row)


def diff_frame(value: str | Column, periods: Sequence[int], *, prefix: str = "diff_", second: str | None = None) -> Frame:
    """k-step differences (0 where there is no earlier row) and, if named, the second difference."""
    v = as_col(value)

    def columns(rows: Rows) -> dict[str, Column]:
        out = {f"{prefix}{p}": F.coalesce(v - F.lag(v, p).over(rows.order), F.lit(0.0)) for p in periods}
        if second:
            twice = v - 2 * F.lag(v, 1).over(rows.order) + F.lag(v, 2).over(rows.order)
            out[second] = F.coalesce(twice, F.lit(0.0))
        return out

    return Frame(max([*periods, 2]), 0, columns)


def diff(df: DataFrame, col: str, periods: Sequence[int], *, second: str | None = "diff2", keys=WELL, row: str = ROW):
    return apply_frames(df, keys, diff_frame(col, periods, second=second), row=row)


def lag_lead(df: DataFrame, col: str, lags: Sequence[int], *, keys=WELL, row: str = ROW) -> DataFrame:
    """Values k rows back and ahead; missing ones are filled from the next (lag) or previous (lead) shifted value."""

    def columns(rows: Rows) -> dict[str, Column]:
        v = F.col(col)
        return {f"lag_{k}": F.lag(v, k).over(rows.order) for k in lags} | {
            f"lead_{k}": F.lead(v, k).over(rows.order) for k in lags
        }

    shifted = apply_frames(df, keys, Frame(max(lags), max(lags), columns), row=row)
    filled = carried(
        shifted,
        keys,
        following={f"_lag_{k}": F.col(f"lag_{k}") for k in lags},
        last={f"_lead_{k}": F.col(f"lead_{k}") for k in lags},
        row=row,
    )
    names = [f"{side}_{k}" for k in lags for side in ("lag", "lead")]
    return filled.withColumns({n: F.col(f"_{n}") for n in names}).drop(*[f"_{n}" for n in names])


def entity_stats(df: DataFrame, col: str, *, prefix: str = "well_", keys=WELL, row: str = ROW) -> DataFrame:
    """Mean, std (ddof 1), min, max and unbiased skew of the whole series on each row."""
    stats = with_key_stats(
        df,
        keys,
        {
            f"{prefix}mean": F.avg(col),
            f"{prefix}std": F.stddev_samp(col),
            f"{prefix}min": F.min(col),
            f"{prefix}max": F.max(col),
            "_skew": F.skewness(col),
            "_n": F.count(col),
        },
        row,
    )
    n = F.col("_n").cast("double")
    skew = F.when(F.col("_n") > 2, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2))
    return stats.withColumn(f"{prefix}skew", skew).drop("_skew", "_n")


def depth_position(df: DataFrame, md: str = "md", *, keys=WELL, row: str = ROW) -> DataFrame:
    """Depth below the first depth, and as a fraction of the span (0 for no span)."""
    span = with_key_stats(df, keys, {"_lo": F.min(md), "_hi": F.max(md)}, row)
    from_top = F.col(md) - F.col("_lo")
    width = F.col("_hi") - F.col("_lo")
    return span.withColumns(
        {
            "depth_from_start": from_top,
            "depth_fraction": F.when(width != 0, from_top / width).otherwise(0.0),
        }
    ).drop("_lo", "_hi")


def envelope_frame(col: str, window: int) -> Frame:
    before, after = _bounds(window, True, False)
    v = F.col(col)
    return Frame(
        before,
        after,
        lambda rows: {
            "envelope": F.max(v).over(rows(-before, after)),
            "energy": F.sqrt(F.avg(v * v).over(rows(-before, after))),
        },
    )


def envelope_energy(df: DataFrame, col: str, window: int = 21, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Rolling maximum and root mean square of a centred window."""
    return apply_frames(df, keys, envelope_frame(col, window), row=row)


def signature_frames(col: str, half: int) -> list[Frame]:
    """Two stages: the step, then mean, std, range, mean step and centre of a window with enough rows."""
    window = max(3, 2 * half + 1)
    needed = max(3, window // 3)
    v = F.col(col)

    def step(rows: Rows) -> dict[str, Column]:
        return {"_step": v - F.lag(v, 1).over(rows.order)}

    def columns(rows: Rows) -> dict[str, Column]:
        w = rows(-half, half)
        enough = F.count(v).over(w) >= needed
        steps = F.count("_step").over(w) >= needed
        zero = F.lit(0.0)
        return {
            "sig_mean": F.when(enough, F.avg(v).over(w)),
            "sig_std": F.coalesce(F.when(enough, F.stddev_samp(v).over(w)), zero),
            "sig_range": F.coalesce(F.when(enough, F.max(v).over(w) - F.min(v).over(w)), zero),
            "sig_grad": F.coalesce(F.when(steps, F.avg("_step").over(w)), zero),
            "sig_center": v,
        }

    return [Frame(1, 0, step), Frame(half, half, columns)]


def window_signature(df: DataFrame, col: str, half: int = 15, *, keys=WELL, row: str = ROW) -> DataFrame:
    return apply_frames(df, keys, *signature_frames(col, half), row=row).drop("_step")


def normalized_cumsum(df: DataFrame, col: str, out: str = "norm_cumsum", *, keys=WELL, row: str = ROW) -> DataFrame:
    """Running sum divided by the root of the number of rows so far; rows count from the first of the table."""
    summed = carried(df, keys, sums={"_sum": F.col(col)}, row=row)
    first = with_key_stats(summed, keys, {"_first": F.min(row)}, row)
    return first.withColumn(out, F.col("_sum") / F.sqrt(F.col(row) - F.col("_first") + 1)).drop("_sum", "_first")


def residual_stats(df: DataFrame, col: str = "residual", window: int = 5, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Trailing mean of a residual, its normalised running sum and the 95th percentile of its size."""
    rolled = rolling_stats(df, col, [window], keys=keys, row=row, stats=["mean"], prefix="residual_")
    summed = normalized_cumsum(rolled, col, "residual_cumsum", keys=keys, row=row)
    return with_key_percentiles(summed, keys, {"residual_p95": (F.abs(F.col(col)), 0.95)}, row)


def neighbor_augment(
    df: DataFrame, cols: Sequence[str], n: int = 1, md: str = "md", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Values of the rows −n…+n (0 outside) and the gradient to the next row per unit of depth (0 on the last row)."""

    def columns(rows: Rows) -> dict[str, Column]:
        out = {}
        for c in cols:
            for k in range(1, n + 1):
                out[f"{c}_m{k}"] = F.coalesce(F.lag(c, k).over(rows.order), F.lit(0.0))
                out[f"{c}_p{k}"] = F.coalesce(F.lead(c, k).over(rows.order), F.lit(0.0))
            run = F.lead(md, 1).over(rows.order) - F.col(md)
            rise = F.lead(c, 1).over(rows.order) - F.col(c)
            out[f"{c}_grad"] = F.coalesce(F.when(run != 0, rise / run), F.lit(0.0))
        return out

    return apply_frames(df, keys, Frame(n, max(n, 1), columns), row=row)


def median_mean_smooth(
    df: DataFrame, col: str, median: int = 5, mean: int = 5, out: str = "smooth", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Centred rolling median, then centred rolling mean of it."""
    before, after = _bounds(mean, True, False)
    second = Frame(before, after, lambda rows: {out: F.avg("_median").over(rows(-before, after))})
    return apply_frames(df, keys, median_frame(col, median, "_median"), second, row=row).drop("_median")


def band_energy(
    df: DataFrame, col: str, levels: int = 3, window: int = 21, *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Energy of the differences between successive dyadic means, and the scale that holds most of it."""
    half = 2 ** (levels - 1)

    def means(rows: Rows) -> dict[str, Column]:
        level = {"_a0": F.col(col).cast("double")}
        for j in range(1, levels + 1):
            level[f"_a{j}"] = F.avg(col).over(rows(-(2 ** (j - 1)), 2 ** (j - 1) - 1))
        return {f"_d{j}": level[f"_a{j - 1}"] - level[f"_a{j}"] for j in range(1, levels + 1)}

    before, after = _bounds(window, True, False)

    def energies(rows: Rows) -> dict[str, Column]:
        return {
            f"energy_{j}": F.avg(F.col(f"_d{j}") * F.col(f"_d{j}")).over(rows(-before, after))
            for j in range(1, levels + 1)
        }

    found = apply_frames(df, keys, Frame(half, half, means), Frame(before, after, energies), row=row)
    every = F.array(*[F.col(f"energy_{j}") for j in range(1, levels + 1)])
    return found.withColumn("dominant_scale", F.array_position(every, F.array_max(every))).drop(
        *[f"_d{j}" for j in range(1, levels + 1)]
    )


def distinct_in_range(
    df: DataFrame,
    ref: DataFrame,
    radius: float,
    x: str,
    ref_x: str = "tvt",
    label: str = "geology",
    out: str = "distinct_labels",
    *,
    keys: Sequence[str] = WELL,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """Number of different labels of the reference within ``radius`` of ``x``.

    Chunks of the series meet their curve as arrays, and each label is looked for by bisection. For curves
    that do not fit a task the last place of each label at or before ``x + radius`` is joined to the rows.
    """
    ids = list(ids or [*keys, ROW])
    reach = float(radius)
    if curve_fits(ref, keys):
        known = ref.where(F.col(ref_x).isNotNull() & F.col(label).isNotNull())
        coded = known.withColumn("_code", F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)))

        def count(values, _, curve_x, codes):
            found = np.zeros(len(values), np.int64)
            for code in np.unique(codes):
                at = curve_x[codes == code]
                found += np.searchsorted(at, values + reach, "right") > np.searchsorted(at, values - reach, "left")
            return {out: np.where(np.isnan(values), 0, found)}

        counts = scan_chunks(df, coded, ids[:-1], keys, (x, x, ref_x, "_code"), 0, per_part(count), f"`{out}` long", ids[-1], Part.known_points)
    else:
        labels = ref.select(*keys, label).distinct()
        places = df.select(*dict.fromkeys([*ids, *keys]), F.col(x).alias("_x"))
        probes = spread_join(places, labels, keys, ids).withColumn("_end", F.col("_x") + F.lit(reach))
        found = bracket(probes, ref.select(*keys, label, ref_x), [*keys, label], "_end", ref_x, [])
        counts = found.groupBy(*ids).agg(
            F.sum(F.coalesce(F.col("_low._x") >= F.col("_x") - F.lit(reach), F.lit(False)).cast("long")).alias(out)
        )
    return df.join(counts, ids, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))
