"""Post-processing of predictions along each series."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.columns import clip
from strataline.functions.quantiles import add_overall, overall, with_key_percentiles
from strataline.functions.savgol import centre_row, gaussian_kernel, projection
from strataline.functions.series import (
    CHUNK,
    ROW,
    Frame,
    Rows,
    apply_frames,
    attach,
    is_long,
    with_key_stats,
    with_place,
)
from strataline.operators.windows import rolling_median
from strataline.operators.zones import last_known
from strataline.settings import checkpoint, group_rows

WELL = ("well_id",)


def _dot(array: Column, weights: Sequence[float]) -> Column:
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(array, fixed, lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v)


def _edge_fit(order: int):
    def fit(values: pd.Series, place: pd.Series) -> pd.Series:
        out = []
        for v, p in zip(values, place):
            known = None if v is None or len(v) <= order else np.asarray(v, dtype=float)
            if known is None or np.isnan(known).any():
                out.append(None)
            else:
                out.append(float(projection(len(known), order)[int(p)] @ known))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(fit, "double")


def savgol(
    df: DataFrame, col: str, window: int, order: int, out: str = "smooth", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Polynomial smoothing per series; the window is made odd and no longer than the series.

    Interior rows are one fixed kernel over a row frame. Rows within half a window of an end take
    the polynomial fitted to the first or last window; only they carry values for the fit. Series
    with at most ``order + 2`` rows stay as they are. Positions are those of the rows in the table, so a tail
    is smoothed as a series of its own; where a window holds an unknown value the result is unknown.
    """
    half = window // 2
    width = 2 * half + 1 if window % 2 else window - 1
    half = width // 2
    v, at = F.struct(F.col(col).cast("double").alias("v")), F.col("_at")
    sized = with_key_stats(with_place(df, keys, "_at", row), keys, {"_n": F.count(F.lit(1))}, row)
    odd = F.col("_n") - (F.col("_n") + 1) % 2
    w = F.least(F.lit(width), odd).cast("int")
    near = (at < width) | (at >= F.col("_n") - width)
    sized = sized.withColumns({"_w": w, "_near": F.when(near, v)})

    def lists(rows: Rows) -> dict[str, Column]:
        return {
            "_mid": F.collect_list(v).over(rows(-half, half)),
            "_ends": F.collect_list("_near").over(rows(-(width - 1), width - 1)),
        }

    found = apply_frames(sized, keys, Frame(width - 1, width - 1, lists), row=row)
    h = F.floor(F.col("_w") / 2)
    from_end = F.col("_n") - 1 - at
    first, last = at < h, from_end < h
    short = F.col("_n") < width
    edge_values = (
        F.when(first, F.slice("_ends", F.lit(1), F.col("_w")))
        .when(last, F.slice("_ends", -F.col("_w"), F.col("_w")))
        .when(short, F.slice("_ends", (at - h + 1).cast("int"), F.col("_w")))
    )
    place = F.when(first, at).when(last, F.col("_w") - 1 - from_end).otherwise(h)
    fitted = _edge_fit(order)(F.transform(edge_values, lambda x: x["v"]), place.cast("int"))
    usable = (F.col("_n") > order + 2) & (F.col("_w") > order) & (F.col("_w") >= 3)
    inner = ~first & ~last & ~short
    value = F.when(~usable, F.col(col).cast("double")).when(inner, _dot(F.col("_mid.v"), centre_row(width, order))).otherwise(
        F.col("_edge")
    )
    return found.withColumn("_edge", fitted).withColumn(out, value).drop("_n", "_w", "_at", "_near", "_mid", "_ends", "_edge")


def kernel_smooth(
    df: DataFrame,
    col: str,
    kind: str = "gaussian",
    size: float = 2.0,
    out: str = "smooth",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Gaussian (``size`` = sigma) or uniform (``size`` = rows) smoothing; beyond the ends the edge value counts on.

    Where a window holds an unknown value the result is unknown.
    """
    v = F.col(col).cast("double")
    kept = F.struct(v.alias("v"))
    if kind == "gaussian":
        weights = gaussian_kernel(size)
        radius = len(weights) // 2

        def lists(rows: Rows) -> dict[str, Column]:
            return {"_v": F.collect_list(kept).over(rows(-radius, radius)), "_back": F.count(F.lit(1)).over(rows(-radius, 0)) - 1}

        found = apply_frames(df, keys, Frame(radius, radius, lists), row=row)
        left = F.lit(radius) - F.col("_back")
        right = F.lit(2 * radius + 1) - F.size("_v") - left
        padded = F.concat(
            F.array_repeat(F.get("_v", F.lit(0)), left.cast("int")),
            F.col("_v"),
            F.array_repeat(F.try_element_at("_v", F.lit(-1)), right.cast("int")),
        )
        return found.withColumn(out, _dot(F.transform(padded, lambda x: x["v"]), weights)).drop("_v", "_back")
    if kind != "uniform":
        raise ValueError(kind)
    size = int(size)
    sized = with_key_stats(
        with_place(df, keys, "_at", row), keys, {"_n": F.count(F.lit(1)), "_head": F.min_by(v, row), "_tail": F.max_by(v, row)}, row
    )
    # Series shorter than the window use a window of their own length: at most size rows.
    sized = sized.withColumn("_few", F.when(F.col("_n") < size, kept))
    back, ahead = size // 2, size - 1 - size // 2

    def sums(rows: Rows) -> dict[str, Column]:
        return {
            "_sum": F.when(F.count(v).over(rows(-back, ahead)) == F.count(F.lit(1)).over(rows(-back, ahead)), F.sum(v).over(rows(-back, ahead))),
            "_list": F.collect_list("_few").over(rows(-(size - 1), size - 1)),
        }

    found = apply_frames(sized, keys, Frame(size - 1, size - 1, sums), row=row)
    m = F.least(F.col("_n"), F.lit(size))
    lo = F.floor(m / 2)
    hi = m - 1 - lo
    miss_low = F.greatest(lo - F.col("_at"), F.lit(0))
    miss_high = F.greatest(hi - (F.col("_n") - 1 - F.col("_at")), F.lit(0))
    start = F.greatest(F.col("_at") - lo, F.lit(0))
    own = F.aggregate(
        F.slice("_list.v", (start + 1).cast("int"), (m - miss_low - miss_high).cast("int")), F.lit(0.0), lambda a, x: a + x
    )
    inside = F.when(F.col("_n") < size, own).otherwise(F.col("_sum"))
    before = F.when(miss_low > 0, miss_low * F.col("_head")).otherwise(0.0)
    beyond = F.when(miss_high > 0, miss_high * F.col("_tail")).otherwise(0.0)
    return found.withColumn(out, (inside + before + beyond) / m).drop("_n", "_at", "_head", "_tail", "_few", "_sum", "_list")


def median_cascade(
    df: DataFrame,
    col: str,
    median: int,
    window: int | None = None,
    order: int = 2,
    out: str = "smooth",
    *,
    pad: str = "shrink",
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Centred median filter, followed by polynomial smoothing if a window is given.

    ``pad="shrink"`` lets the window shrink at the ends and leaves out unknown values; ``pad="zero"`` counts
    rows beyond the ends as 0 and is unknown where the window holds an unknown value.
    """
    half = median // 2
    if pad == "shrink":
        filtered = rolling_median(df, col, median, "_median", keys=keys, row=row)
    else:
        kept = F.struct(F.col(col).cast("double").alias("v"))
        lists = Frame(half, half, lambda rows: {"_v": F.collect_list(kept).over(rows(-half, half))})
        filtered = apply_frames(df, keys, lists, row=row)
        full = F.array_sort(F.concat("_v.v", F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size("_v"))))
        known = ~F.exists("_v", lambda x: x["v"].isNull())
        filtered = filtered.withColumn("_median", F.when(known, F.get(full, F.lit(half)))).drop("_v")
    if window is None:
        return filtered.withColumnRenamed("_median", out)
    return savgol(filtered, "_median", window, order, out, keys=keys, row=row).drop("_median")


def shrink_to_smooth(df: DataFrame, value: str, smooth: str, share: float, out: str = "shrunk") -> DataFrame:
    return df.withColumn(out, F.col(value) + share * (F.col(smooth) - F.col(value)))


def clip_percentile(
    df: DataFrame, col: str, low: float = 0.01, high: float = 0.99, out: str = "clipped", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Clip to two percentiles of the series."""
    bounds = with_key_percentiles(df, keys, {"_lo": (col, low), "_hi": (col, high)}, row)
    return bounds.withColumn(out, clip(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def postprocess(
    df: DataFrame, col: str, window: int = 11, order: int = 3, out: str = "processed", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Smooth series of more than 11 rows, then clip every series to its 1st and 99th percentile."""
    smooth = savgol(df, col, window, order, "_smooth", keys=keys, row=row)
    sized = with_key_stats(smooth, keys, {"_rows": F.count(F.lit(1))}, row)
    chosen = sized.withColumn("_value", F.when(F.col("_rows") > 11, F.col("_smooth")).otherwise(F.col(col)))
    return clip_percentile(chosen, "_value", out=out, keys=keys, row=row).drop("_smooth", "_rows", "_value")


def fade(md_since: str | Column, tau: float | None) -> Column:
    """``1 − exp(−md/τ)``: 0 at the anchor, 1 far from it; no fade without τ."""
    if tau is None:
        return F.lit(1.0)
    since = F.col(md_since) if isinstance(md_since, str) else md_since
    return 1 - F.exp(-F.greatest(since, F.lit(0.0)) / tau)


def apply_policy(
    df: DataFrame, model: str, tracker: str, md_since: str, alpha: float, tau: float | None, weight: float, out: str = "policy_delta"
) -> DataFrame:
    """``α·(1 − exp(−md/τ))·((1 − w)·model + w·tracker)`` on deltas."""
    mixed = (1 - weight) * F.col(model) + weight * F.col(tracker)
    return df.withColumn(out, alpha * fade(md_since, tau) * mixed)


def clip_delta(
    df: DataFrame,
    train: DataFrame,
    delta: str,
    train_delta: str,
    low: float = 0.005,
    high: float = 0.995,
    alpha: float = 1.0,
    out: str = "clipped_delta",
) -> DataFrame:
    """Clip deltas to two quantiles of the training deltas, then shrink by α."""
    bounds = overall(train, {"_lo": (train_delta, low), "_hi": (train_delta, high)})
    return add_overall(df, bounds).withColumn(out, alpha * clip(F.col(delta), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def _limit(rows: DataFrame, max_slope: float, col: str, md: str, row: str, group: Sequence[str]) -> DataFrame:
    """Carry the limited value through the sorted rows of each group, starting from its entry value.

    Rows stream through in order; only the last value is kept between batches, never a whole group.
    """
    group = list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, value, depth = None, 0.0, 0.0
        for pdf in batches:
            owners = list(zip(*[pdf[g] for g in group]))
            columns = [pdf[c].to_numpy(float) for c in (col, md, "_entry", "_entry_md")]
            out = np.empty(len(pdf))
            for i, (owner, v, d, entry, entry_md) in enumerate(zip(owners, *columns)):
                if owner != current:
                    current, value, depth = owner, entry, entry_md
                if v != v:
                    out[i] = np.nan
                    continue
                reach = max_slope * max(abs(d - depth), 1e-6)
                value = min(max(v, value - reach), value + reach)
                depth = d
                out[i] = value
            yield pdf[[*group, row]].assign(_limited=out)

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in [*group, row]], "_limited double"])
    return rows.repartition(*group).sortWithinPartitions(*group, row).mapInPandas(run, schema)


class Transfer:
    """What a stretch of rows makes of the value it is entered with: monotone, with slopes 0 and 1, as its corners (x, y).

    One row leaves the values within its reach at its own value and moves the others by the reach towards it.
    """

    def __init__(self) -> None:
        self.x: list[float] = []
        self.y: list[float] = []

    def _source(self, y: float, after: int) -> float:
        """The entry value that gives ``y``, which lies between the corners ``after - 1`` and ``after``."""
        if not self.x:
            return y
        near = after - 1 if after else 0
        return self.x[near] + (y - self.y[near])

    def add(self, value: float, reach: float) -> None:
        low, high = value - reach, value + reach
        i, j = bisect_left(self.y, low), bisect_right(self.y, high)
        x = [self._source(low, i), self._source(high, j)]
        self.x[i:j] = x
        self.y = [y + reach for y in self.y[:i]] + [value, value] + [y - reach for y in self.y[j:]]


def carry_through(x: Sequence[float], y: Sequence[float], entry: float) -> float:
    """The exit value of a stretch with the given corners."""
    at = bisect_left(x, entry)
    if at < len(x) and (at == 0 or y[at - 1] != y[at]):
        return y[at] - (x[at] - entry)
    return y[at - 1] if at < len(x) else y[-1] + (entry - x[-1]) if len(x) else entry


def _transfers(rows: DataFrame, max_slope: float, col: str, md: str, row: str, group: Sequence[str]) -> DataFrame:
    """(group, corners) of each group's transfer; rows stream through in order."""
    group = list(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, transfer, depth = None, Transfer(), 0.0
        done: list[tuple] = []
        names = [*group, "_x", "_y"]
        for pdf in batches:
            owners = list(zip(*[pdf[g] for g in group]))
            for owner, v, d, entry_md in zip(owners, *[pdf[c].to_numpy(float).tolist() for c in (col, md, "_entry_md")]):
                if owner != current:
                    if current is not None:
                        done.append((*current, transfer.x, transfer.y))
                    current, transfer, depth = owner, Transfer(), entry_md
                if v == v:
                    transfer.add(v, max_slope * max(abs(d - depth), 1e-6))
                    depth = d
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if current is not None:
            yield pd.DataFrame([(*current, transfer.x, transfer.y)], columns=names)

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in group], "_x array<double>, _y array<double>"])
    return rows.repartition(*group).sortWithinPartitions(*group, row).mapInPandas(run, schema)


def slope_limit(
    df: DataFrame,
    col: str,
    max_slope: float,
    start: str,
    start_md: str,
    md: str = "md",
    out: str = "limited",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Forward limiter: each value stays within ``max_slope`` per unit of depth of the one before; no later row is read.

    ``start`` and ``start_md`` are the last known value and its depth. A row without value stays without one and is passed
    over. A long series goes by chunks in two passes, whatever
    its values: what each chunk makes of any entry value (``Transfer``), from which the entries follow chunk by
    chunk, and then the limiter within each chunk.
    """
    keys = list(keys)
    if not is_long(df, row):
        rows = df.select(*keys, row, col, md, F.col(start).alias("_entry"), F.col(start_md).alias("_entry_md"))
        limited = _limit(rows, max_slope, col, md, row, keys)
        return df.join(limited.withColumnRenamed("_limited", out), [*keys, row])
    group = [*keys, CHUNK]
    size = F.lit(group_rows(df.sparkSession))
    rows = checkpoint(
        df.select(*keys, row, col, md, F.col(start).alias("_start"), F.col(start_md).alias("_start_md")).withColumn(
            CHUNK, F.floor(F.col(row) / size)
        )
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    known_row = F.when(F.col(col).isNotNull(), F.col(row))
    ends = rows.groupBy(*group).agg(F.max_by(md, known_row).alias("_last_md"), F.max("_start").alias("_s"), F.max("_start_md").alias("_m"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    borders = checkpoint(ends.select(*group, "_s", F.coalesce(F.last("_last_md", ignorenulls=True).over(earlier), "_m").alias("_entry_md")))
    corners = _transfers(rows.join(borders.drop("_s"), group), max_slope, col, md, row, group)

    def enter(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values(CHUNK)
        entries, value = [], float(chunks["_s"].iloc[0])
        for x, y in zip(chunks["_x"], chunks["_y"]):
            entries.append(value)
            value = carry_through(x, y, value)
        return chunks[[*group, "_entry_md"]].assign(_entry=entries)

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in group], "_entry_md double", "_entry double"])
    entries = checkpoint(borders.withColumn("_entry_md", F.col("_entry_md").cast("double")).join(corners, group).groupBy(*keys).applyInPandas(enter, schema))
    limited = _limit(rows.join(entries, group), max_slope, col, md, row, group)
    done = limited.select(*group, row, F.col("_limited").alias(out))
    return df.withColumn(CHUNK, F.floor(F.col(row) / size)).join(done, [*group, row]).drop(CHUNK)


def slope_quantiles(
    df: DataFrame, qs: Sequence[float], col: str = "tvt", md: str = "md", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Quantiles of the absolute slope between neighbouring rows over all series: one row per quantile."""

    def slope(rows: Rows) -> dict[str, Column]:
        run = F.col(md) - F.lag(md, 1).over(rows.order)
        rise = F.col(col) - F.lag(col, 1).over(rows.order)
        return {"_slope": F.when(F.abs(run) > 1e-9, F.abs(rise / run))}

    slopes = apply_frames(df, keys, Frame(1, 0, slope), row=row).select("_slope")
    wide = overall(slopes, {f"q{i}": ("_slope", float(q)) for i, q in enumerate(qs)})
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("max_abs_slope")) for i, q in enumerate(qs)])
    return wide.select(F.explode(pairs).alias("_q")).select("_q.*")


def _residual_rank(df: DataFrame, pred: str, probe: str, keys: Sequence[str], row: str) -> DataFrame:
    """Known residuals with ``_back``: 1 for the last known row; known rows are counted, not row numbers."""
    known = F.col(probe).isNotNull()
    counted = with_key_stats(df, keys, {"_known": F.count(probe), "_end": F.max(F.when(known, F.col(row)))}, row)
    return counted.withColumns(
        {
            "_res": F.when(known, F.col(probe) - F.col(pred)),
            "_back": F.when(known, F.col("_end") - F.col(row) + 1),
        }
    )


def anchor_bias(
    df: DataFrame,
    mode: str = "late_mean",
    n: int = 50,
    decay: float = 500.0,
    shrink: float = 1.0,
    pred: str = "pred",
    probe: str = "tvt_input",
    md: str = "md",
    out: str = "corrected",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Add the prediction's error on the last known rows, fading with distance from the last of them.

    Modes: ``last``, ``late_mean``, ``late_median``, ``exp`` (weights exp(linspace(−2, 0))). The
    known rows are a prefix. Series without known rows stay as they are.
    """
    rows = _residual_rank(df, pred, probe, keys, row)
    recent = F.col("_back") <= n
    late = F.when(recent, F.col("_res"))
    m = F.least(F.col("_known"), F.lit(n))
    if mode == "late_median":
        rows = with_key_percentiles(rows.withColumn("_late", late), keys, {"_bias": ("_late", 0.5)}, row).drop("_late")
    elif mode == "exp":
        place = F.when(m > 1, -2.0 * (F.col("_back") - 1) / (m - 1)).otherwise(-2.0)
        rows = rows.withColumn("_wt", F.when(recent, F.exp(place)))
        rows = with_key_stats(rows, keys, {"_wr": F.sum(F.col("_wt") * F.col("_res")), "_ww": F.sum("_wt")}, row)
        rows = rows.withColumn("_bias", F.col("_wr") / F.col("_ww")).drop("_wt", "_wr", "_ww")
    elif mode in ("last", "late_mean"):
        pick = late if mode == "late_mean" else F.when(F.col("_back") == 1, F.col("_res"))
        rows = with_key_stats(rows, keys, {"_bias": F.avg(pick)}, row)
    else:
        raise ValueError(mode)
    rows = with_key_stats(rows, keys, {"_md": F.max(F.when(F.col(row) == F.col("_end"), F.col(md)))}, row)
    away = F.greatest(F.col(md) - F.col("_md"), F.lit(0.0))
    scale = F.exp(-away / decay) if decay > 0 else F.lit(1.0)
    change = F.coalesce(shrink * F.col("_bias") * scale, F.lit(0.0))
    return rows.withColumn(out, F.col(pred) + change).select(*df.columns, out)


def anchor_trend(
    df: DataFrame,
    n: int = 50,
    bias_mode: str = "mean",
    slope_mode: str = "linear",
    bias_shrink: float = 1.0,
    slope_shrink: float = 1.0,
    limit: float = 0.0,
    pred: str = "pred",
    probe: str = "tvt_input",
    md: str = "md",
    out: str = "corrected",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Bias of the last known rows plus the residual's slope times the distance, optionally clipped.

    Bias: ``mean``, ``median``, ``last``. Slope: ``linear``, ``last_first``, ``none``.
    """
    rows = _residual_rank(df, pred, probe, keys, row)
    recent = F.col("_back") <= n
    rows = rows.withColumns({"_late": F.when(recent, F.col("_res")), "_x": F.when(recent, F.col(md))})
    first_row = F.when(recent, F.col(row))
    stats = {
        "_mean": F.avg("_late"),
        "_last": F.max_by("_late", first_row),
        "_first": F.min_by("_late", first_row),
        "_md1": F.max_by("_x", first_row),
        "_md0": F.min_by("_x", first_row),
        "_count": F.count("_late"),
        "_fit": F.regr_slope("_late", "_x"),
        "_spread": F.var_pop("_x"),
    }
    rows = with_key_stats(rows, keys, stats, row)
    if bias_mode == "median":
        rows = with_key_percentiles(rows, keys, {"_median": ("_late", 0.5)}, row)
    bias = {"mean": "_mean", "median": "_median", "last": "_last"}[bias_mode]
    run = F.col("_md1") - F.col("_md0")
    slope = {
        "none": F.lit(0.0),
        "last_first": F.when(F.abs(run) < 1e-6, 0.0).otherwise((F.col("_last") - F.col("_first")) / run),
        "linear": F.when(F.col("_spread") * F.col("_count") < 1e-9, 0.0).otherwise(F.coalesce("_fit", F.lit(0.0))),
    }[slope_mode]
    trend = F.when(F.col("_count") >= 2, slope).otherwise(0.0) * F.greatest(F.col(md) - F.col("_md1"), F.lit(0.0))
    if limit > 0:
        trend = clip(trend, -limit, limit)
    change = F.coalesce(bias_shrink * F.col(bias) + slope_shrink * trend, F.lit(0.0))
    return rows.withColumn(out, F.col(pred) + change).select(*df.columns, out)


def _solve(degree: int):
    """Polynomial coefficients from one row of power sums per key."""

    def solve(powers: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(powers, targets):
            a = np.array([[p[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            out.append(np.linalg.lstsq(a, np.asarray(t, float), rcond=None)[0].tolist())
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")


def poly_project(
    df: DataFrame,
    degree: int = 5,
    blend: float = 1.0,
    iterations: int = 4,
    sharpness: float = 2.0,
    pred: str = "pred",
    probe: str = "tvt_input",
    md: str = "md",
    z: str = "z",
    out: str = "projected",
    *,
    min_known: int = 5,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Replace ``pred + z`` of each tail by a robust polynomial in relative depth, blended with the prediction.

    Each pass sums powers per series on Spark, solves one small system per series and reweights
    residuals by 1/(1 + (r/(c·scale))²), scale = 1.4826·median + 1e-6. Series with too few known or
    tail rows stay as they are.
    """
    keys = list(keys)
    anchored = last_known(df, {"_v": probe, "_z": z, "_md": md}, probe, keys, row)
    anchored = with_key_stats(anchored, keys, {"_known": F.count(probe), "_deepest": F.max_by(md, row)}, row)
    tail = anchored.where(F.col(probe).isNull())
    tail = with_key_stats(tail, keys, {"_rows": F.count(F.lit(1))}, row)
    span = F.greatest(F.col("_deepest") - F.col("_md"), F.lit(1e-6))
    base = checkpoint(
        tail.where((F.col("_known") >= min_known) & (F.col("_rows") >= degree + 2)).select(
            *keys,
            row,
            (2 * (F.col(md) - F.col("_md")) / span - 1).alias("_s"),
            (F.col(pred) + F.col(z) - F.col("_v") - F.col("_z")).alias("_u"),
        )
    )

    def power(i: int) -> Column:
        return reduce(lambda a, b: a * b, [F.col("_s")] * i, F.lit(1.0))

    def fit(rows: DataFrame, weight: Column) -> DataFrame:
        square = weight * weight
        sums = rows.groupBy(*keys).agg(
            F.array(*[F.sum(square * power(i)) for i in range(2 * degree + 1)]).alias("_p"),
            F.array(*[F.sum(square * power(i) * F.col("_u")) for i in range(degree + 1)]).alias("_t"),
        )
        return checkpoint(sums.select(*keys, _solve(degree)("_p", "_t").alias("_coef")))

    def value() -> Column:
        terms = [F.get("_coef", F.lit(i)) * power(i) for i in range(degree + 1)]
        return reduce(lambda a, b: a + b, terms)

    coefficients = fit(base, F.lit(1.0))
    for _ in range(iterations):
        rows = attach(base, coefficients, keys, row).withColumn("_r", F.col("_u") - value())
        rows = with_key_percentiles(rows, keys, {"_mad": (F.abs("_r"), 0.5)}, row)
        scale = F.col("_mad") * 1.4826 + 1e-6
        coefficients = fit(rows, 1 / (1 + F.pow(F.col("_r") / (sharpness * scale), 2)))
    fitted = attach(base, coefficients, keys, row).select(*keys, row, (value() - F.col("_u")).alias("_move"))
    return (
        df.join(fitted, [*keys, row], "left")
        .withColumn(out, F.col(pred) + blend * F.coalesce("_move", F.lit(0.0)))
        .drop("_move")
    )


def offset_round(df: DataFrame, col: str, offset: float, step: float, out: str = "rounded") -> DataFrame:
    """Shift, then round to a grid; halves go to the even multiple."""
    return df.withColumn(out, F.bround((F.col(col) + offset) / step) * step)


def pin_known(df: DataFrame, pred: str, probe: str = "tvt_input", out: str = "pinned") -> DataFrame:
    """Known values win over predictions."""
    return df.withColumn(out, F.coalesce(probe, pred))


def trend_baseline(
    df: DataFrame,
    mode: str = "linear",
    n: int = 30,
    max_rate: float = 0.12,
    probe: str = "tvt_input",
    md: str = "md",
    z: str = "z",
    out: str = "baseline",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Constant last value, linear in depth, or linear in ``value + z``; the rate is the median step slope of
    the last n known rows, clipped to ±max_rate, and 0 with fewer than three rows or two steps."""
    rows = last_known(df, {"_v": probe, "_z": z, "_md": md}, probe, keys, row)
    if mode == "constant":
        return rows.withColumn(out, F.col("_v")).drop("_v", "_z", "_md")
    if mode not in ("linear", "position"):
        raise ValueError(mode)
    level = F.col(probe) if mode == "linear" else F.col(probe) + F.col(z)

    def steps(r: Rows) -> dict[str, Column]:
        run = F.col(md) - F.lag(md, 1).over(r.order)
        return {"_slope": F.when(run > 0, (level - F.lag(level, 1).over(r.order)) / run)}

    rows = apply_frames(rows, keys, Frame(1, 0, steps), row=row)
    rows = with_key_stats(rows, keys, {"_end": F.max(F.when(F.col(probe).isNotNull(), F.col(row))), "_known": F.count(probe)}, row)
    recent = (F.col(row) <= F.col("_end")) & (F.col(row) > F.col("_end") - (n - 1))
    rows = rows.withColumn("_recent", F.when(recent, F.col("_slope")))
    rows = with_key_percentiles(rows, keys, {"_median": ("_recent", 0.5)}, row)
    rows = with_key_stats(rows, keys, {"_steps": F.count("_recent")}, row)
    enough = (F.col("_known") >= 3) & (F.col("_steps") >= 2)
    rate = F.when(enough, clip(F.col("_median"), -max_rate, max_rate)).otherwise(0.0)
    moved = rate * (F.col(md) - F.col("_md"))
    value = F.col("_v") + moved if mode == "linear" else F.col("_v") + F.col("_z") + moved - F.col(z)
    return rows.withColumn(out, value).select(*df.columns, out)
