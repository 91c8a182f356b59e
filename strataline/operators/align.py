"""Alignment of a series with its reference curve, and of its tail with its own prefix.

``keys`` identify the series, ``ref_keys`` the reference curve (the same column unless a
curve serves several series). Offsets, lags and candidate paths are small lists: rows are
multiplied by them once, looked up by one sort, and reduced per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.asof import curve_at_offsets, interp_join, nearest_join
from strataline.functions.columns import array_mean, array_median, array_std, clip, correlation, ratio, total
from strataline.functions.moving import apply_moving, moving_stats
from strataline.functions.nearest import nearest_points
from strataline.functions.quantiles import key_percentiles, with_key_percentiles
from strataline.functions.scan import (
    BLOCK,
    SCAN_ROWS,
    Block,
    Part,
    curve_fits,
    field,
    lists,
    one_chunk,
    per_part,
    robust_scores,
    rolling_correlations,
    scan_chunks,
)
from strataline.functions.series import (
    ROW,
    Frame,
    Rows,
    apply_frames,
    attach,
    carried,
    index_series,
    is_long,
    longest,
    spread_join,
    with_bound,
    with_key_stats,
    with_place,
)
from strataline.functions.windows_match import best_windows
from strataline.operators.gaps import interpolate_gaps, robust_zscore
from strataline.operators.windows import signature_frames
from strataline.operators.zones import last_known, split_zone
from strataline.settings import checkpoint

WELL = ("well_id",)


def prepare_reference(
    ref: DataFrame, x: str = "tvt", y: str = "gr", label: str | None = None, *, keys: Sequence[str] = WELL
) -> DataFrame:
    """Usable reference: finite positions, equal positions averaged, gaps interpolated, rows numbered."""
    merged = (
        ref.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
        .groupBy(*keys, x)
        .agg(F.avg(y).alias(y), *([F.min(label).alias(label)] if label else []))
    )
    indexed = index_series(merged, keys, [x])
    return interpolate_gaps(indexed, y, "_y", keys=keys).withColumn(y, F.col("_y")).drop("_y")


def regrid_reference(
    ref: DataFrame, step: float, x: str = "tvt", y: str = "gr", *, keys: Sequence[str] = WELL, block: int = 4096
) -> DataFrame:
    """Reference on a uniform grid from its first position to just past its last; the end value is held."""
    span = ref.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    size = F.lit(float(step))
    count = F.ceil((F.col("_hi") + size - F.col("_lo")) / size)
    blocks = span.withColumn("_n", count).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block)))
    )
    cells = blocks.withColumn(
        "cell", F.explode(F.sequence(F.col("_block") * block, F.least(F.col("_block") * block + block, F.col("_n")) - 1))
    )
    places = cells.select(*keys, "cell", (F.col("_lo") + F.col("cell") * size).alias("grid_x"))
    return interp_join(places, ref, keys, "grid_x", x, y, "grid_y")


def nearest_reference(
    df: DataFrame, ref: DataFrame, x: str, ref_x: str, values: dict[str, str], tie: str = "lower", *, keys=WELL
) -> DataFrame:
    """Values of the nearest reference row."""
    return nearest_join(df, ref, keys, x, ref_x, values, tie)


def _label(offset: float) -> str:
    sign = "m" if offset < 0 else "p"
    return f"{sign}{abs(offset):g}".replace(".", "_")


def offset_family(
    df: DataFrame,
    ref: DataFrame,
    anchor: str,
    offsets: Sequence[float],
    log: str = "gr",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    prefix: str = "resid",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
    edge: str = "null",
) -> DataFrame:
    """One residual ``log − ref(anchor + offset)`` per offset and row; all offsets of a row are looked up at once in its curve."""
    names = [f"{prefix}_{_label(o)}" for o in offsets]
    if curve_fits(ref, keys):
        shifts = np.array([float(o) for o in offsets])

        def reduce(block: Block) -> dict[str, np.ndarray]:
            return dict(zip(names, (block.x[:, None] - block.curve_at(block.shifted(shifts), edge)).T, strict=True))

        result = ", ".join(f"{n} double" for n in names)
        return scan_chunks(df, ref, ids[:-1], keys, (log, anchor, ref_x, ref_y), 0, reduce, result, ids[-1], Part.known_points)
    looked = curve_at_offsets(df, ref, keys, ids, anchor, ref_x, ref_y, offsets, [log], edge)
    return looked.groupBy(*ids).agg(
        *[
            F.max(F.when(F.col("offset") == float(o), F.col(log) - F.col("ref_at"))).alias(name)
            for o, name in zip(offsets, names, strict=True)
        ]
    )


def _spread(df: DataFrame, keys: Sequence[str], multiplied: DataFrame) -> DataFrame:
    """Bring the multiplied rows of a short series together once, so that windows and per-row reductions share it."""
    return multiplied if is_long(df) else multiplied.repartition(*keys)


def _signals(
    df: DataFrame, ref: DataFrame, log: str, prior: str, ref_x: str, keys: Sequence[str], ref_keys: Sequence[str], row: str
) -> DataFrame:
    """``_x`` and ``_p``: log and prior with gaps filled by the series' median; without any value 0 and the curve's median."""
    filled = with_key_percentiles(df, keys, {"_log_median": (log, 0.5), "_prior_median": (prior, 0.5)}, row)
    middle = key_percentiles(ref, ref_keys, {"_curve_median": (ref_x, 0.5)})
    bound = longest(df, row)
    joined = spread_join(filled, middle, ref_keys, [*keys, row], "left", size=bound)
    joined = with_bound(joined, bound, row) if bound else joined
    return joined.withColumns(
        {"_x": F.coalesce(log, "_log_median", F.lit(0.0)), "_p": F.coalesce(prior, "_prior_median", "_curve_median")}
    ).drop("_log_median", "_prior_median", "_curve_median")


def _scannable(
    df: DataFrame, ref: DataFrame, log: str, prior: str, ref_x: str, keys: Sequence[str], ref_keys: Sequence[str], row: str
) -> tuple[DataFrame, str, str]:
    """Series of one chunk as they are: the scan fills their gaps. Longer ones with gaps filled."""
    if one_chunk(df, row):
        return df, log, prior
    return _signals(df, ref, log, prior, ref_x, keys, ref_keys, row), "_x", "_p"


def _best_of(corr: np.ndarray) -> np.ndarray:
    """Column of the best correlation, the lowest lag at equal ones to nine decimals."""
    return np.argmax(np.round(corr, 9), axis=1)


def _log_sums(log: str, window: int) -> Frame:
    """Window sums of the log itself: the same for every lag, so taken before rows are multiplied by lags."""
    half, x = window // 2, F.col(log)

    def columns(rows: Rows) -> dict[str, Column]:
        w = rows(-half, half)
        return {
            f"_n_{window}": F.count(F.lit(1)).over(w),
            f"_sx_{window}": F.sum(x).over(w),
            f"_sxx_{window}": F.sum(x * x).over(w),
        }

    return Frame(half, half, columns)


def _row_lags(df: DataFrame, ref: DataFrame, ref_keys, keys, row, log, prior, ref_x, ref_y, lags, windows) -> DataFrame:
    ids = [*keys, row]
    bound = longest(df, row)
    summed = apply_frames(df, keys, [_log_sums(log, w) for w in windows], row=row)
    sums = [f"{s}_{w}" for w in windows for s in ("_n", "_sx", "_sxx")]
    looked = curve_at_offsets(summed, ref, ref_keys, ids, prior, ref_x, ref_y, lags, [log, *sums], "clamp")
    looked = looked.select(*ids, *sums, F.col(log).alias("_x"), F.col("ref_at").alias("_y"), F.col("offset").alias("lag"))
    return _spread(df, keys, with_bound(looked, bound, row) if bound else looked)


def _correlation_frame(window: int, out: str, epsilon: float | None) -> Frame:
    """Rolling Pearson correlation of ``_x`` and ``_y``; a window covers ``window // 2`` rows on each side.

    Fewer than three rows, or a side without spread beyond rounding, give 0.
    """
    half = window // 2
    x, y = F.col("_x"), F.col("_y")

    def columns(rows: Rows) -> dict[str, Column]:
        w = rows(-half, half)
        n, sx, sxx = F.col(f"_n_{window}"), F.col(f"_sx_{window}"), F.col(f"_sxx_{window}")
        sy, syy, sxy = F.sum(y).over(w), F.sum(y * y).over(w), F.sum(x * y).over(w)
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        varied = (vx > 1e-9 * sxx) & (vy > 1e-9 * syy)
        cov, scale = sxy - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
        if epsilon is not None:
            value = F.when((n >= 3) & varied, cov / (scale + epsilon))
        else:
            value = F.when((n >= 3) & varied & (scale > 1e-8), cov / scale)
        return {out: F.coalesce(value, F.lit(0.0))}

    return Frame(half, half, columns)


def lag_scan(
    df: DataFrame,
    ref: DataFrame,
    max_lag: float = 80,
    window: int = 51,
    step: float = 1.0,
    log: str = "gr",
    prior: str = "prior",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Rolling correlation of the log with the reference at ``prior + lag`` for all lags, reduced per row.

    Best lag (the lowest at equal correlation, to nine decimals), best correlation, correlation at lag 0, best
    minus mean, peakiness, the reference at the best lag and its residual. Gaps of log and prior count as the
    series' median. Curves that do not fit a task take the way over Spark windows.
    """
    lags = [float(v) for v in np.arange(-max_lag, max_lag + step / 2, step)]
    ids, ref_keys = [*keys, row], list(ref_keys or keys)
    if curve_fits(ref, ref_keys):
        half, shifts = window // 2, np.array(lags)

        def reduce(block: Block) -> dict[str, np.ndarray]:
            values = block.curve_at(block.shifted(shifts))
            (corr,) = rolling_correlations(block, values, [half], 1e-6)
            best = _best_of(corr)
            at = np.arange(len(block))
            top, there = corr[at, best], values[at, best]
            zero = np.flatnonzero(shifts == 0)
            return {
                "best_lag": shifts[best],
                "best_corr": top,
                "corr_at_0": corr[:, zero[0]] if len(zero) else np.full(len(block), np.nan),
                "corr_max_minus_mean": top - corr.mean(axis=1),
                "peakiness": (top - np.median(corr, axis=1)) / (corr.std(axis=1) + 1e-6),
                "ref_at_best": there,
                "ref_minus_log": there - block.x,
            }

        result = "best_lag double, best_corr double, corr_at_0 double, corr_max_minus_mean double, peakiness double, ref_at_best double, ref_minus_log double"
        own, value, place = _scannable(df, ref, log, prior, ref_x, keys, ref_keys, row)
        return scan_chunks(own, ref, keys, ref_keys, (value, place, ref_x, ref_y), half, reduce, result, row)
    df = _signals(df, ref, log, prior, ref_x, keys, ref_keys, row)
    log, prior = "_x", "_p"
    rows = _row_lags(df, ref, ref_keys, keys, row, log, prior, ref_x, ref_y, lags, [window])
    scored = apply_frames(rows, [*keys, "lag"], _correlation_frame(window, "corr", 1e-6), row=row)
    best = F.max_by(F.struct("lag", "corr", "_y", "_x"), F.struct(F.round("corr", 9), -F.col("lag")))
    reduced = scored.groupBy(*ids).agg(
        best.alias("_b"),
        F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("corr_at_0"),
        F.avg("corr").alias("_mean"),
        F.percentile("corr", F.lit(0.5)).alias("_median"),
        F.stddev_pop("corr").alias("_std"),
    )
    return reduced.select(
        *ids,
        F.col("_b.lag").alias("best_lag"),
        F.col("_b.corr").alias("best_corr"),
        "corr_at_0",
        (F.col("_b.corr") - F.col("_mean")).alias("corr_max_minus_mean"),
        ((F.col("_b.corr") - F.col("_median")) / (F.col("_std") + 1e-6)).alias("peakiness"),
        F.col("_b._y").alias("ref_at_best"),
        (F.col("_b._y") - F.col("_b._x")).alias("ref_minus_log"),
    )


# Rows on each side over which the median lag is averaged.
CONSENSUS = 25


def lag_scan_multiscale(
    df: DataFrame,
    ref: DataFrame,
    max_lag: float = 80,
    windows: Sequence[int] = (21, 51, 101),
    step: float = 1.0,
    log: str = "gr",
    prior: str = "prior",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Lag scan on robust z-scores at several window lengths from one look-up.

    Best lag and correlation per window, their agreement (std), the smoothed median lag, and
    the normalised reference and residual at the median lag.
    """
    ref_keys = list(ref_keys or keys)
    ids = [*keys, row]
    lags = [float(v) for v in np.arange(-max_lag, max_lag + step / 2, step)]
    usable = ref.where(F.col(ref_x).isNotNull())
    if curve_fits(ref, ref_keys):
        halves, shifts = [w // 2 for w in windows], np.array(lags)

        def prepare(part: Part) -> None:
            scores = robust_scores(part.x) if part.whole else part.x
            part.curve_y = robust_scores(part.curve_y)
            part.fill()
            part.x = scores

        def reduce(block: Block) -> dict[str, np.ndarray]:
            corrs = rolling_correlations(block, block.curve_at(block.shifted(shifts)), halves, None)
            best = [_best_of(c) for c in corrs]
            at = np.arange(len(block))
            found = np.stack([shifts[b] for b in best])
            middle = np.median(found, axis=0)
            low, high = block.around(CONSENSUS)
            upto = np.concatenate([[0.0], np.cumsum(middle)])
            there = block.curve_at(block.place + middle)
            return (
                {f"best_lag_{w}": lag for w, lag in zip(windows, found, strict=True)}
                | {f"best_corr_{w}": c[at, b] for w, c, b in zip(windows, corrs, best, strict=True)}
                | {
                    "lag_agreement": found.std(axis=0),
                    "median_lag": middle,
                    "lag_consensus": (upto[high] - upto[low]) / (high - low),
                    "ref_z_at_median": there,
                    "residual_z": block.x - there,
                }
            )

        names = [*(f"best_lag_{w}" for w in windows), *(f"best_corr_{w}" for w in windows)]
        result = ", ".join(f"{c} double" for c in [*names, "lag_agreement", "median_lag", "lag_consensus", "ref_z_at_median", "residual_z"])
        own, value, place = _scannable(df, ref, log, prior, ref_x, keys, ref_keys, row)
        if value != log:
            own, value = robust_zscore(own, log, "_z", keys=keys, row=row), "_z"
        halo = max(halves) + CONSENSUS
        return scan_chunks(own, usable, keys, ref_keys, (value, place, ref_x, ref_y), halo, reduce, result, row, prepare)
    df = _signals(df, ref, log, prior, ref_x, keys, ref_keys, row)
    own = robust_zscore(df, log, "_z", keys=keys, row=row)
    curve = robust_zscore(usable, ref_y, "_rz", keys=ref_keys)
    rows = _row_lags(own, curve, ref_keys, keys, row, "_z", "_p", ref_x, "_rz", lags, windows)
    scored = apply_frames(rows, [*keys, "lag"], [_correlation_frame(w, f"corr_{w}", None) for w in windows], row=row)
    reduced = scored.groupBy(*ids).agg(
        *[
            F.max_by(F.struct("lag", F.col(f"corr_{w}").alias("corr")), F.struct(F.round(f"corr_{w}", 9), -F.col("lag"))).alias(f"_b{w}")
            for w in windows
        ],
        F.max("_x").alias("_z"),
    )
    found = reduced.select(
        *ids,
        "_z",
        *[F.col(f"_b{w}.lag").alias(f"best_lag_{w}") for w in windows],
        *[F.col(f"_b{w}.corr").alias(f"best_corr_{w}") for w in windows],
    )
    every = F.array(*[F.col(f"best_lag_{w}") for w in windows])
    found = found.withColumns({"lag_agreement": array_std(every), "median_lag": array_median(every)})
    bound = longest(df, row)
    found = with_bound(found, bound, row) if bound else found
    smooth = Frame(CONSENSUS, CONSENSUS, lambda r: {"lag_consensus": F.avg("median_lag").over(r(-CONSENSUS, CONSENSUS))})
    found = apply_frames(found, keys, smooth, row=row)
    places = found.join(df.select(*dict.fromkeys([*ids, *ref_keys]), F.col("_p").alias("_prior")), ids).withColumn(
        "_at", F.col("_prior") + F.col("median_lag")
    )
    looked = interp_join(places, curve, ref_keys, "_at", ref_x, "_rz", "ref_z_at_median")
    return looked.withColumn("residual_z", F.col("_z") - F.col("ref_z_at_median")).drop("_prior", "_at", "_z")


def smooth_lag(
    df: DataFrame, lag: str = "best_lag", mean: int = 50, median: int = 75, *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Best lag smoothed by a centred mean and by a centred median."""
    sides = [(w // 2, (w - 1) // 2) for w in (mean, median)]
    steps = [moving_stats(lag, *sides[0], {"mean": f"lag_mean_{mean}"}), moving_stats(lag, *sides[1], {"median": f"lag_median_{median}"})]
    return apply_moving(df, keys, steps, row)


def best_shift(
    df: DataFrame,
    ref: DataFrame,
    shifts: Sequence[float],
    tails: Sequence[int | None] = (30, 100, None),
    min_rows: int = 10,
    log: str = "gr",
    probe: str = "tvt_input",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Per series, the shift of the reference with the least squared misfit on the last known rows.

    One pass for several prefix lengths (None: all of it): shift, misfit, confidence, and the
    spread of the shifts. Fewer than ``min_rows`` usable rows give shift 0, misfit 1e6, confidence 0.
    """
    ref_keys = list(ref_keys or keys)
    zoned = split_zone(df, probe, keys=keys, row=row).where(F.col("in_prefix") & F.col(log).isNotNull())
    known = zoned.withColumn("from_end", F.col("eval_start") - F.col(row))

    def name(t: int | None) -> str:
        return "all" if t is None else str(t)

    if curve_fits(ref, ref_keys):
        moves = np.array([float(v) for v in shifts])

        def reduce(block: Block) -> dict[str, pa.Array]:
            """Per part of a series the sums and counts of squared misfits by shift, at its first row."""
            at = block.curve_at(block.shifted(moves))
            there, miss = ~np.isnan(at), (block.x[:, None] - at) ** 2
            out = {}
            for t in tails:
                inside = there if t is None else there & (block.others["from_end"] <= t)[:, None]
                sums, counts = (np.add.reduceat(v, block.start, axis=0) for v in (np.where(inside, miss, 0.0), inside.astype(float)))
                for kind, found in (("s", sums), ("n", counts)):
                    lines: list = [None] * len(block)
                    for i, line in zip(block.start, found, strict=True):
                        lines[i] = line
                    out[f"_{kind}{name(t)}"] = pa.array(lines, pa.list_(pa.float64()))
            return out

        names = [f"_{kind}{name(t)}" for t in tails for kind in "sn"]
        result = ", ".join(f"{n} array<double>" for n in names)
        parts = scan_chunks(known, ref, keys, ref_keys, (log, probe, ref_x, ref_y), 0, reduce, result, row, lambda part: None, ["from_end"], null_keys=True)
        lines = parts.where(F.col(names[0]).isNotNull()).select(*keys, F.posexplode(F.arrays_zip(*names)).alias("_i", "_v"))
        moved = F.get(F.array(*[F.lit(float(v)) for v in shifts]), F.col("_i")).alias("offset")
        sums = lines.groupBy(*keys, moved).agg(*[F.sum(F.col("_v")[n]).alias(n) for n in names])
        per_shift = sums.select(
            *keys, "offset",
            *[F.when(F.col(f"_n{name(t)}") > 0, F.col(f"_s{name(t)}") / F.col(f"_n{name(t)}")).alias(f"_m{name(t)}") for t in tails],
            *[F.col(f"_n{name(t)}").cast("long").alias(f"_n{name(t)}") for t in tails],
        )
    else:
        looked = curve_at_offsets(
            known, ref, ref_keys, [*keys, row], probe, ref_x, ref_y, shifts, [log, "from_end"], "clamp"
        )
        miss = F.pow(F.col(log) - F.col("ref_at"), 2)

        def inside(t: int | None) -> Column:
            return F.lit(True) if t is None else F.col("from_end") <= t

        per_shift = looked.groupBy(*keys, "offset").agg(
            *[F.avg(F.when(inside(t), miss)).alias(f"_m{name(t)}") for t in tails],
            *[F.count(F.when(inside(t), miss)).alias(f"_n{name(t)}") for t in tails],
        )
    best = per_shift.groupBy(*keys).agg(
        *[F.min_by(F.struct("offset", F.col(f"_m{name(t)}").alias("m")), F.struct(f"_m{name(t)}", "offset")).alias(f"_b{name(t)}") for t in tails],
        *[F.avg(f"_m{name(t)}").alias(f"_a{name(t)}") for t in tails],
        *[F.max(f"_n{name(t)}").alias(f"_n{name(t)}") for t in tails],
    )
    picks = []
    for t in map(name, tails):
        enough = F.col(f"_n{t}") >= min_rows
        picks += [
            F.when(enough, F.col(f"_b{t}.offset")).otherwise(0.0).alias(f"shift_{t}"),
            F.when(enough, F.col(f"_b{t}.m")).otherwise(1e6).alias(f"misfit_{t}"),
            F.when(enough, 1 - F.col(f"_b{t}.m") / (F.col(f"_a{t}") + 1e-9)).otherwise(0.0).alias(f"confidence_{t}"),
        ]
    result = best.select(*keys, *picks)
    return result.withColumn("shift_spread", array_std(F.array(*[F.col(f"shift_{name(t)}") for t in tails])))


def _reduce_candidates(looked: DataFrame, ids: Sequence[str], log: str, scale: float) -> list[Column]:
    """Best candidate, its misfit, gap to the second and soft mean, from misfits per row and offset."""
    miss = F.abs(F.col(log) - F.col("ref_at"))
    weight = F.exp(-miss / scale)
    ordered = F.array_sort(F.collect_list(miss))
    return [
        F.min_by("offset", F.when(miss.isNotNull(), F.struct(miss, F.col("offset")))).alias("best"),
        F.min(miss).alias("best_miss"),
        F.when(F.size(ordered) >= 2, F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))).alias("top2_gap"),
        ratio(F.sum(weight * F.col("offset")), F.sum(weight)).alias("soft"),
        F.min_by("ref_at", F.when(miss.isNotNull(), F.struct(miss, F.col("offset")))).alias("best_ref"),
    ]


def _best_offsets(miss: np.ndarray, at: np.ndarray, offsets: np.ndarray, scale: float) -> dict[str, np.ndarray]:
    """As ``_reduce_candidates``, from misfits and curve values rows × offsets (ascending)."""
    known = ~np.isnan(miss)
    some = known.any(axis=1)
    filled = np.where(known, miss, np.inf)
    rows, best = np.arange(len(miss)), np.argmin(filled, axis=1)
    two = np.partition(filled, 1, axis=1)[:, :2] if miss.shape[1] > 1 else np.column_stack([filled, np.full(len(miss), np.inf)])
    weight = np.where(known, np.exp(-np.where(known, miss, 0.0) / scale), 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        soft, gap = (weight * offsets).sum(axis=1) / weight.sum(axis=1), two[:, 1] - two[:, 0]
    found = {"best": offsets[best], "best_miss": filled[rows, best], "soft": soft, "best_ref": at[rows, best]}
    return {n: np.where(some, v, np.nan) for n, v in found.items()} | {"top2_gap": np.where(known.sum(axis=1) >= 2, gap, np.nan)}


def local_offset_search(
    df: DataFrame,
    ref: DataFrame,
    offsets: Sequence[float],
    base: str = "prior",
    log: str = "gr",
    scale: float = 20.0,
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Offset around ``base`` with the smallest log misfit: offset, misfit, misfit at 0, top-2 gap, soft mean."""
    zero = float(min(offsets, key=abs))
    if curve_fits(ref, keys):
        shifts = np.array(sorted({float(o) for o in offsets}))

        def reduce(block: Block) -> dict[str, np.ndarray]:
            at = block.curve_at(block.shifted(shifts), "null")
            miss = np.abs(block.x[:, None] - at)
            found = _best_offsets(miss, at, shifts, scale)
            return {
                "best_offset": found["best"],
                "best_abs_resid": found["best_miss"],
                "zero_abs_resid": miss[:, np.flatnonzero(shifts == zero)[0]],
                "top2_gap": found["top2_gap"],
                "soft_offset": found["soft"],
                "best_ref": found["best_ref"],
            }

        names = ["best_offset", "best_abs_resid", "zero_abs_resid", "top2_gap", "soft_offset", "best_ref"]
        result = ", ".join(f"{n} double" for n in names)
        return scan_chunks(df, ref, ids[:-1], keys, (log, base, ref_x, ref_y), 0, reduce, result, ids[-1], Part.known_points)
    looked = curve_at_offsets(df, ref, keys, ids, base, ref_x, ref_y, offsets, [log])
    at_zero = F.max(F.when(F.col("offset") == zero, F.abs(F.col(log) - F.col("ref_at"))))
    found = looked.groupBy(*ids).agg(*_reduce_candidates(looked, ids, log, scale), at_zero.alias("zero_abs_resid"))
    return found.select(
        *ids,
        F.col("best").alias("best_offset"),
        F.col("best_miss").alias("best_abs_resid"),
        "zero_abs_resid",
        "top2_gap",
        F.col("soft").alias("soft_offset"),
        F.col("best_ref").alias("best_ref"),
    )


def candidate_paths(
    df: DataFrame,
    ref: DataFrame,
    endpoints: Sequence[float],
    start: str = "anchor_value",
    frac: str = "frac",
    log: str = "gr",
    scale: float = 20.0,
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Straight paths ``start + frac·endpoint``: residual per endpoint, best and soft endpoint, top-2 gap."""
    widest = max(abs(float(e)) for e in endpoints)
    if curve_fits(ref, keys):
        ends = np.array(sorted({float(e) for e in endpoints}))

        def reduce(block: Block) -> dict[str, np.ndarray]:
            at = block.curve_at(block.place[:, None] + block.others[frac][:, None] * ends, "null")
            resid = block.x[:, None] - at
            found = _best_offsets(np.abs(resid), at, ends, scale)
            return {f"path_resid_{_label(e)}": r for e, r in zip(ends, resid.T, strict=True)} | {
                "min_abs_resid": found["best_miss"],
                "best_endpoint": found["best"],
                "best_endpoint_centered": found["best"] / widest,
                "top2_gap": found["top2_gap"],
                "soft_endpoint": found["soft"],
                "best_resid": block.x - found["best_ref"],
            }

        rest = ["min_abs_resid", "best_endpoint", "best_endpoint_centered", "top2_gap", "soft_endpoint", "best_resid"]
        result = ", ".join(f"{n} double" for n in [*(f"path_resid_{_label(e)}" for e in endpoints), *rest])
        return scan_chunks(df, ref, ids[:-1], keys, (log, start, ref_x, ref_y), 0, reduce, result, ids[-1], Part.known_points, [frac])
    rows = df.select(
        *dict.fromkeys([*ids, *keys]),
        log,
        F.col(start).alias("_s"),
        F.col(frac).alias("_f"),
        F.explode(F.array(*[F.lit(float(e)) for e in endpoints])).alias("offset"),
    ).withColumn("at", F.col("_s") + F.col("_f") * F.col("offset"))
    looked = interp_join(rows, ref, keys, "at", ref_x, ref_y, "ref_at", "null")
    found = looked.groupBy(*ids).agg(
        *_reduce_candidates(looked, ids, log, scale),
        F.max(log).alias("_log"),
        *[
            F.max(F.when(F.col("offset") == float(e), F.col(log) - F.col("ref_at"))).alias(f"path_resid_{_label(e)}")
            for e in endpoints
        ],
    )
    return found.select(
        *ids,
        *[f"path_resid_{_label(e)}" for e in endpoints],
        F.col("best_miss").alias("min_abs_resid"),
        F.col("best").alias("best_endpoint"),
        (F.col("best") / widest).alias("best_endpoint_centered"),
        "top2_gap",
        F.col("soft").alias("soft_endpoint"),
        (F.col("_log") - F.col("best_ref")).alias("best_resid"),
    )


def _known_pairs(df, ref, log, probe, ref_x, ref_y, ref_keys, edge) -> DataFrame:
    """Known rows with ``_y`` (log) and ``_x`` (reference at the known position)."""
    known = df.where(F.col(probe).isNotNull())
    return interp_join(known, ref, ref_keys, probe, ref_x, ref_y, "_x", edge).withColumn("_y", F.col(log))


def affine_calibration(
    df: DataFrame,
    ref: DataFrame,
    min_rows: int = 20,
    log: str = "gr",
    probe: str = "tvt_input",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
) -> DataFrame:
    """``log ≈ a·ref + b`` on the prefix; too few rows or a flat reference give a = 1 and the mean difference."""
    pairs = _known_pairs(df, ref, log, probe, ref_x, ref_y, list(ref_keys or keys), "clamp")
    x, y = F.when(F.col("_y").isNotNull(), F.col("_x")), F.when(F.col("_x").isNotNull(), F.col("_y"))
    sums = pairs.groupBy(*keys).agg(
        F.count(x).alias("cal_rows"),
        F.stddev_pop(x).alias("_sd"),
        F.regr_slope(y, x).alias("_a"),
        F.regr_intercept(y, x).alias("_b"),
        (F.avg("_y") - F.avg("_x")).alias("_d"),
    )
    fits = (F.col("cal_rows") >= min_rows) & (F.col("_sd") >= 1e-6)
    flat = F.when(F.col("cal_rows") > 0, F.coalesce("_d", F.lit(0.0))).otherwise(0.0)
    return sums.select(
        *keys,
        "cal_rows",
        F.when(fits, F.col("_a")).otherwise(1.0).alias("cal_slope"),
        F.when(fits, F.col("_b")).otherwise(flat).alias("cal_intercept"),
    )


def _with_robust_scale(rows: DataFrame, keys: Sequence[str], value: str, out: str, row: str) -> DataFrame:
    """Add the median of a column per key and 1.4826·MAD, or the standard deviation, or NULL."""
    rows = with_key_percentiles(rows, keys, {f"{out}_median": (value, 0.5)}, row)
    rows = rows.withColumn("_dev", F.abs(F.col(value) - F.col(f"{out}_median")))
    rows = with_key_percentiles(rows, keys, {"_mad": ("_dev", 0.5)}, row)
    rows = with_key_stats(rows, keys, {"_sd": F.stddev_pop(value)}, row)
    scale = F.coalesce(F.when(F.col("_mad") > 1e-12, F.col("_mad") * 1.4826), F.when(F.col("_sd") > 1e-12, F.col("_sd")))
    return rows.withColumn(out, scale).drop("_dev", "_mad", "_sd")


def robust_calibration(
    df: DataFrame,
    ref: DataFrame,
    min_rows: int = 12,
    log: str = "gr",
    probe: str = "tvt_input",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Line refitted after dropping residuals beyond 3.5 robust deviations; slope clipped to 0.35–2.25,
    median intercept, noise clipped to 7.5–60, quality = absolute correlation.

    Few rows or a flat reference give slope 1, the median difference, noise 28 (8–60) and quality 0.1 at most.
    """
    keys = list(keys)
    x, y, keep = F.col("_x"), F.col("_y"), F.col("_keep")
    pairs = _known_pairs(df, ref, log, probe, ref_x, ref_y, list(ref_keys or keys), "clamp")
    pairs = pairs.where(x.isNotNull() & y.isNotNull()).select(*keys, row, "_x", "_y")
    if is_long(pairs, row):
        pairs = checkpoint(pairs)
    rows = with_key_stats(
        pairs,
        keys,
        {
            "_n": F.count(F.lit(1)),
            "_a0": F.regr_slope(y, x),
            "_b0": F.regr_intercept(y, x),
            "_sx": F.stddev_pop(x),
            "_sy": F.stddev_pop(y),
            "_cov": F.covar_pop(x, y),
        },
        row,
    )
    rows = rows.withColumn("_corr", ratio(F.col("_cov"), F.col("_sx") * F.col("_sy")))
    rows = rows.withColumn("_r0", y - F.col("_a0") * x - F.col("_b0"))
    rows = _with_robust_scale(rows, keys, "_r0", "_s0", row)
    limit = 3.5 * F.greatest(F.coalesce("_s0", F.lit(20.0)), F.lit(1.0))
    rows = rows.withColumn("_keep", F.abs(F.col("_r0") - F.col("_s0_median")) <= limit)
    rows = with_key_stats(
        rows, keys, {"_kept": F.sum(keep.cast("long")), "_a1": F.regr_slope(F.when(keep, y), F.when(keep, x))}, row
    )
    usable = (F.col("_n") >= min_rows) & (F.col("_sx") >= 1e-6)
    refit = (F.col("_kept") >= min_rows) & (F.col("_kept") < F.col("_n"))
    slope = F.when(usable, clip(F.when(refit, F.col("_a1")).otherwise(F.col("_a0")), 0.35, 2.25)).otherwise(1.0)
    rows = rows.withColumn("cal_slope", slope).withColumn("_d", y - F.col("cal_slope") * x)
    rows = with_key_percentiles(rows, keys, {"cal_intercept": ("_d", 0.5)}, row)
    rows = rows.withColumn("_res", F.col("_d") - F.col("cal_intercept"))
    rows = _with_robust_scale(rows, keys, "_res", "_sigma", row)
    names = ["cal_slope", "cal_intercept", "_n", "_sx", "_sy", "_corr", "_sigma"]
    per_key = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])
    corr = F.when((F.col("_n") >= 3) & (F.col("_sy") > 1e-6), F.abs("_corr")).otherwise(0.0)
    few = F.col("_n") < min_rows
    return per_key.select(
        *keys,
        F.col("_n").alias("cal_rows"),
        "cal_slope",
        "cal_intercept",
        F.when(usable, clip(F.coalesce("_sigma", F.lit(20.0)), 7.5, 60.0))
        .when(few, 28.0)
        .otherwise(clip(F.coalesce("_sigma", F.lit(28.0)), 8.0, 60.0))
        .alias("cal_sigma"),
        F.when(usable, clip(corr, 0.0, 1.0)).when(few, 0.0).otherwise(0.1).alias("cal_quality"),
    )


def residual_sigma(
    df: DataFrame,
    ref: DataFrame,
    min_rows: int = 20,
    low: float = 10.0,
    high: float = 60.0,
    default: float = 30.0,
    log: str = "gr",
    probe: str = "tvt_input",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Clipped standard deviation of ``log − ref`` on the prefix, or the default with few rows."""
    pairs = _known_pairs(df, ref, log, probe, ref_x, ref_y, list(ref_keys or keys), "clamp")
    miss = F.col("_y") - F.col("_x")
    enough = F.count(miss) >= min_rows
    return pairs.groupBy(*keys).agg(
        F.when(enough, clip(F.stddev_pop(miss), low, high)).otherwise(default).alias("residual_sigma")
    )


def prefix_alignment(
    df: DataFrame,
    ref: DataFrame,
    min_rows: int = 30,
    log: str = "gr",
    probe: str = "tvt_input",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
) -> DataFrame:
    """How well log and reference agree on the prefix: usable points, correlation, RMSE, residual std.

    Positions outside the curve do not count; correlation needs ``min_rows`` points and spread on both sides.
    """
    pairs = _known_pairs(df, ref, log, probe, ref_x, ref_y, list(ref_keys or keys), "null")
    x, y = F.when(F.col("_y").isNotNull(), F.col("_x")), F.when(F.col("_x").isNotNull(), F.col("_y"))
    miss = F.col("_y") - F.col("_x")
    enough = (F.count(miss) >= min_rows) & (F.stddev_pop(x) >= 1e-9) & (F.stddev_pop(y) >= 1e-9)
    return pairs.groupBy(*keys).agg(
        F.count(miss).alias("valid_points"),
        F.when(enough, correlation(x, y)).alias("prefix_corr"),
        F.sqrt(F.avg(miss * miss)).alias("prefix_rmse"),
        F.stddev_pop(miss).alias("prefix_resid_std"),
    )


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Mean of the values at most two places away."""
    at = np.arange(len(values))
    low, high = np.maximum(at - 2, 0), np.minimum(at + 3, len(values))
    shift = values.mean() if len(values) else 0.0
    upto = np.concatenate([[0.0], np.cumsum(values - shift)])
    return (upto[high] - upto[low]) / (high - low) + shift


def _best_centers(tail: np.ndarray, own: slice, prefix: np.ndarray, centers: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """For the tail's own places the best of the prefix's centres and its score; values around the tail's ends repeat."""
    smooth = _smoothed(tail)
    left, right = max(half - own.start, 0), max(own.stop + half - len(tail), 0)
    inner = smooth[max(own.start - half, 0) : own.stop + half]
    padded = np.concatenate([np.full(left, smooth[0]), inner, np.full(right, smooth[-1])])
    return best_windows(padded, _smoothed(prefix), 2 * half + 1, centers - half)


def _match_series(row: np.ndarray, x: np.ndarray, known: np.ndarray, half: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A whole series: places of the rows to match, their values and scores."""
    missing = np.isnan(known)
    start = row[missing.argmax()] if missing.any() else len(row)
    gaps = np.isnan(x)
    x = np.where(gaps, np.median(x[~gaps]) if not gaps.all() else 0.0, x)
    split = int(np.searchsorted(row, start))
    wanted = np.flatnonzero(missing)
    before = known[:split][~np.isnan(known[:split])]
    value = np.full(len(wanted), before[-1] if len(before) else np.nan)
    score = np.zeros(len(wanted))
    centers = np.arange(half, split - half)
    centers = centers[(row[centers] - half) % stride == 0]
    if start >= 2 * half + 2 and len(centers) and len(wanted):
        best, found = _best_centers(x[split:], slice(0, len(x) - split), x[:split], centers, half)
        at = wanted - split
        value, score = known[centers[best[at]]], found[at]
        value = np.where(np.isnan(value), before[-1] if len(before) else np.nan, value)
    return wanted, value, score


def self_match(
    df: DataFrame,
    half: int = 15,
    stride: int = 3,
    log: str = "gr",
    probe: str = "tvt_input",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """For each tail row, the known value at the prefix window most correlated with the window around the row.

    Every tail window is compared with every prefix window, as the definition asks, by running sums along
    diagonals: one product per pair of positions. A series of one chunk travels once, as one array of its values.
    A longer one is cut into tiles, each pair of a tail tile and a prefix tile is one piece of work, and the
    best of its tiles is kept per row. Gaps of the log count as the series' median.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, row])
    if one_chunk(df, row):
        entry = F.struct(F.col(row).alias("row"), F.col(log).cast("double").alias("x"), F.col(probe).cast("double").alias("v"))
        whole = df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))

        def run(batches):
            for batch in batches:
                ends, entries = lists(batch.column("_rows"))
                place, x, known = (field(entries, f) for f in ("row", "x", "v"))
                found = [_match_series(place[a:b], x[a:b], known[a:b], half, stride) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                own = pa.array(np.repeat(np.arange(len(found)), [len(w) for w, _, _ in found]))
                at = np.concatenate([a + w for a, (w, _, _) in zip(ends[:-1], found, strict=True)])
                columns = [batch.column(k).take(own) for k in keys] + [entries.field("row").take(pa.array(at))]
                columns += [pa.array(np.concatenate([f[i] for f in found]), from_pandas=True) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, row, "match_value", "match_score"])

        return whole.mapInArrow(run, f"{named}, match_value double, match_score double")
    filled = with_key_percentiles(df, keys, {"_log_median": (log, 0.5)}, row).withColumn("_log", F.coalesce(log, "_log_median", F.lit(0.0)))
    zoned = checkpoint(split_zone(filled, probe, keys=keys, row=row).select(*keys, row, "_log", probe, "eval_start", "in_prefix", "is_eval"))
    placed = with_place(zoned, [*keys, "in_prefix"], "_at", row)
    halo, size = half + 2, F.lit(SCAN_ROWS)
    reach = F.sequence(F.greatest(F.floor((F.col("_at") - halo) / size), F.lit(0)), F.floor((F.col("_at") + halo) / size))
    entry = F.struct(F.col("_at").alias("at"), F.col(row).alias("row"), F.col("_log").alias("x"), F.col(probe).cast("double").alias("v"), "is_eval")
    tiles = placed.withColumn("_tile", F.explode(reach)).groupBy(*keys, "in_prefix", "_tile")
    tiles = tiles.agg(F.sort_array(F.collect_list(entry)).alias("_rows"), F.max("eval_start").alias("_start"))  # at most SCAN_ROWS and two halos
    tiles = checkpoint(tiles)
    prefix = tiles.where(F.col("in_prefix") & (F.col("_start") >= 2 * half + 2)).select(*keys, F.col("_tile").alias("_other"), F.col("_rows").alias("_prefix"))
    others = prefix.groupBy(*keys).agg(F.collect_list("_other").alias("_others"))
    tails = tiles.where(~F.col("in_prefix")).select(*keys, "_tile", "_rows").join(others, keys).withColumn("_other", F.explode("_others")).drop("_others")
    pairs = tails.join(prefix, [*keys, "_other"])

    def run_pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.slice(i, 1)
                tail, known = (lists(piece.column(c))[1] for c in ("_rows", "_prefix"))
                at, there = tail.field("at").to_numpy(), known.field("at").to_numpy()
                mine = np.flatnonzero(at // SCAN_ROWS == piece.column("_tile")[0].as_py())
                numbers = known.field("row").to_numpy()
                centers = np.flatnonzero((there // SCAN_ROWS == piece.column("_other")[0].as_py()) & ((numbers - half) % stride == 0))
                centers = centers[(centers >= half) & (centers + half < len(there))]
                if not len(mine) or not len(centers):
                    continue
                best, score = _best_centers(field(tail, "x"), slice(mine[0], mine[-1] + 1), field(known, "x"), centers, half)
                wanted = np.flatnonzero(tail.field("is_eval").to_numpy(zero_copy_only=False)[mine])
                chosen = centers[best[wanted]]
                none = pa.array(np.zeros(len(wanted), np.int64))
                columns = [piece.column(k).take(none) for k in keys] + [tail.field("row").take(pa.array(mine[wanted]))]
                columns += [pa.array(field(known, "v")[chosen], from_pandas=True), pa.array(score[wanted]), pa.array(numbers[chosen])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, row, "_value", "_score", "_center"])

    blocks = pairs.mapInArrow(run_pairs, f"{named}, _value double, _score double, _center {kinds[row]}")
    found = blocks.groupBy(*keys, row).agg(F.max_by(F.struct("_value", "_score"), F.struct(F.round("_score", 9), -F.col("_center"))).alias("_b"))
    anchored = last_known(zoned.where(F.col(row) < F.col("eval_start")), {"_last": probe}, probe, keys, row)
    lasts = anchored.groupBy(*keys).agg(F.max("_last").alias("_last"))
    joined = attach(zoned.where("is_eval").select(*keys, row), lasts, keys, row).join(found, [*keys, row], "left")
    return joined.select(
        *keys,
        row,
        F.coalesce("_b._value", F.col("_last").cast("double")).alias("match_value"),
        F.coalesce("_b._score", F.lit(0.0)).alias("match_score"),
    )


def combine_scales(df: DataFrame, values: Sequence[str], scores: Sequence[str], base: str | None = None) -> DataFrame:
    """Scales weighted by softmax(3·score), their plain mean, and the score-weighted change from ``base``."""
    weights = [F.exp(3.0 * F.col(s)) for s in scores]
    whole = total(weights) + 1e-9
    soft = total([F.col(v) * w for v, w in zip(values, weights)]) / whole
    out = {"scale_softmax": soft, "scale_mean": total([F.col(v) for v in values]) / float(len(values))}
    if base is not None:
        plain = total([F.greatest(F.col(s), F.lit(0.0)) for s in scores])
        change = total([F.greatest(F.col(s), F.lit(0.0)) * (F.col(v) - F.col(base)) for v, s in zip(values, scores)])
        out["scale_delta"] = F.when(plain > 0, change / plain).otherwise(0.0)
    return df.withColumns(out)


SIGNATURE = ["sig_mean", "sig_std", "sig_range", "sig_grad", "sig_center"]


def _match_signatures(values: dict[str, np.ndarray], half: int, stride: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A whole series: places of the tail's rows, and value, change, score, trust and gap of each."""
    row, probe, inside, wanted = values["row"], values["v"], values["in_prefix"] > 0, np.flatnonzero(values["is_eval"] > 0)
    points = np.stack([values[c] for c in SIGNATURE], axis=1)
    usable = inside & (values["logged"] > 0) & ~np.isnan(probe)
    known = usable.sum()
    cands = np.flatnonzero(usable & (row % stride == 0) & ~np.isnan(points).any(axis=1))
    out = [np.full(len(wanted), np.nan) for _ in range(5)]
    if known < max(30, 2 * half) or len(cands) < 5:
        return wanted, out
    deviation = points[cands].std(axis=0)
    scaled = (points - np.median(points[cands], axis=0)) / np.where(deviation >= 1e-6, deviation, 1.0)
    asked = np.flatnonzero(~np.isnan(points[wanted]).any(axis=1))
    anchor = probe[~np.isnan(probe)][-1]
    for first in range(0, len(asked), 512):
        some = asked[first : first + 512]
        square = np.zeros((len(some), len(cands)))
        for i in range(len(SIGNATURE)):
            square += (scaled[wanted[some], i][:, None] - scaled[cands, i]) ** 2
        distance = np.sqrt(square)
        best = probe[cands[np.argmin(np.round(distance, 9), axis=1)]]
        two = np.partition(distance, 1, axis=1)
        score = np.exp(-np.clip(two[:, 0], 0.0, 20.0) / 2.5)
        trust = np.clip(score * min(known / 250.0, 1.0), 0.0, 1.0)
        for column, found in zip(out, (best, best - anchor, score, trust, two[:, 1] - two[:, 0]), strict=True):
            column[some] = found
    return wanted, out


def signature_match(
    df: DataFrame,
    half: int = 15,
    stride: int = 3,
    log: str = "gr",
    probe: str = "tvt_input",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Known value at the prefix row whose window signature is nearest to that of each tail row.

    Signatures of prefix and tail are computed apart and scaled by the prefix (median, population
    std). Score ``exp(−d/2.5)``, trust = score × prefix length / 250 (at most 1), gap to the second. A series of one
    chunk is matched as arrays, a longer one by the nearest points of its prefix.
    """
    keys = list(keys)
    zoned = split_zone(df, probe, keys=keys, row=row).withColumn("_part", F.col("in_prefix"))
    signed = apply_frames(zoned, [*keys, "_part"], *signature_frames(log, half), row=row).drop("_step")
    if one_chunk(df, row):
        kinds = dict(df.dtypes)
        flags = {"in_prefix": F.col("in_prefix"), "is_eval": F.col("is_eval"), "logged": F.col(log).isNotNull(), "v": F.col(probe)}
        entry = F.struct(F.col(row).alias("row"), *[c.cast("double").alias(n) for n, c in flags.items()], *[F.col(c).cast("double").alias(c) for c in SIGNATURE])
        whole = signed.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
        names, fields = ["match_value", "match_delta", "match_score", "match_trust", "match_gap"], ["row", *flags, *SIGNATURE]

        def run(batches):
            for batch in batches:
                ends, entries = lists(batch.column("_rows"))
                columns = {n: field(entries, n) for n in fields}
                found = [_match_signatures({n: c[a:b] for n, c in columns.items()}, half, stride) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                own = pa.array(np.repeat(np.arange(len(found)), [len(w) for w, _ in found]))
                at = np.concatenate([a + w for a, (w, _) in zip(ends[:-1], found, strict=True)])
                out = [batch.column(k).take(own) for k in keys] + [entries.field("row").take(pa.array(at))]
                out += [pa.array(np.concatenate([f[i] for _, f in found]), from_pandas=True) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, row, *names])

        schema = [*(f"`{c}` {kinds[c]}" for c in [*keys, row]), *(f"{n} double" for n in names)]
        return whole.mapInArrow(run, ", ".join(schema))
    usable = signed.where(F.col("in_prefix") & F.col(log).isNotNull() & F.col(probe).isNotNull())
    counted = with_key_stats(usable, keys, {"_known": F.count(F.lit(1))}, row)
    candidates = counted.where((F.col("_known") >= max(30, 2 * half)) & (F.col(row) % stride == 0))
    for c in SIGNATURE:
        candidates = candidates.where(F.col(c).isNotNull())
    middles = key_percentiles(candidates, keys, {f"_m_{c}": (c, 0.5) for c in SIGNATURE}, row)
    spreads = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cands"),
        F.max("_known").alias("_known"),
        F.max_by(probe, row).alias("_last_cand"),
        *[F.when(F.stddev_pop(c) >= 1e-6, F.stddev_pop(c)).otherwise(1.0).alias(f"_s_{c}") for c in SIGNATURE],
    )
    scales = middles.join(spreads, keys).where(F.col("_cands") >= 5)

    def scaled(rows: DataFrame, extra: Sequence[Column]) -> DataFrame:
        own = scales.drop("_known") if "_known" in rows.columns else scales
        return attach(rows, own, keys, row, "inner").select(
            *keys, *extra, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"z_{c}") for c in SIGNATURE]
        )

    points = scaled(candidates, [F.col(row).alias("_center"), F.col(probe).cast("double").alias("_value")])
    tail = signed.where(F.col("is_eval"))
    probes = scaled(tail.where(F.col("sig_mean").isNotNull() & F.col("sig_center").isNotNull()), [F.col(row)])
    nearest = nearest_points(
        probes, points, [f"z_{c}" for c in SIGNATURE], 2, ids=[*keys, row], by=keys, payload=["_value", "_center"], tie="_center"
    )
    best = nearest.groupBy(*keys, row).agg(
        F.min_by("_value", "rank").alias("match_value"),
        F.min("distance").alias("_d1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("_d2"),
    )
    known = scales.select(*keys, F.col("_known"))
    anchors = last_known(df.where(F.col(probe).isNotNull()), {"_anchor": probe}, probe, keys, row)
    anchors = anchors.groupBy(*keys).agg(F.max("_anchor").alias("_anchor"))
    score = F.exp(-clip(F.col("_d1"), 0.0, 20.0) / 2.5)
    per_key = anchors.join(known, keys, "left")
    joined = attach(tail.select(*keys, row), per_key, keys, row).join(best, [*keys, row], "left")
    return joined.select(
        *keys,
        row,
        "match_value",
        (F.col("match_value") - F.col("_anchor")).alias("match_delta"),
        score.alias("match_score"),
        clip(score * clip(F.col("_known") / 250.0, 0.0, 1.0), 0.0, 1.0).alias("match_trust"),
        (F.col("_d2") - F.col("_d1")).alias("match_gap"),
    )


def _warped(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Banded time-warping distances of windows along the first axis, one numpy step per cell of the band for all pairs."""
    n = len(x)
    before = [np.inf] * (n + 1)
    before[0] = 0.0
    for i in range(1, n + 1):
        now = [np.inf] * (n + 1)
        for j in range(max(1, i - radius), min(n, i + radius) + 1):
            cheapest = np.minimum(np.minimum(before[j], now[j - 1]), before[j - 1])
            now[j] = (x[i - 1] - y[j - 1]) ** 2 + cheapest
        before = now
    return np.sqrt(before[n] / n)


def dtw_distance(a: str | Column, b: str | Column, radius: int) -> Column:
    """Banded time-warping distance of two equally long arrays: ``sqrt(D / length)`` with squared cost."""

    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        lengths = a.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            out[at] = _warped(np.stack(a.to_numpy()[at], axis=1), np.stack(b.to_numpy()[at], axis=1), radius)
        return pd.Series(out)

    return F.pandas_udf(distance, "double")(a, b)


WARPED = ["dtw_best_lag", "dtw_min_distance", "dtw_distance_at_0", "dtw_spread", "dtw_confidence"]


def _warp_block(block: Block, shifts: np.ndarray, half: int, radius: int, sample_step: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the sampled rows of a block (every k-th row number, and the last of a part) and their features."""
    ends = np.cumsum([high - low for low, high in block.spans]) - 1
    last = np.zeros(len(block), bool)
    last[ends] = [high == len(p.x) for p, (_, high) in zip(block.parts, block.spans, strict=True)]
    sampled = np.flatnonzero((block.row % sample_step == 0) | last)
    values = block.curve_at(block.shifted(shifts))
    low, high = (bound[sampled] for bound in block.around(half))
    distance = np.full((len(sampled), len(shifts)), np.nan)
    for n in np.unique(high - low):
        same = np.flatnonzero(high - low == n)
        for first in range(0, len(same), 256):
            some = same[first : first + 256]
            at = low[some] + np.arange(n)[:, None]
            distance[some] = _warped(block.x[at][:, :, None], values[at], radius)
    best = np.argmin(distance, axis=1)
    least = distance[np.arange(len(sampled)), best]
    zero = np.flatnonzero(shifts == 0)
    second = np.partition(distance, 1, axis=1)[:, 1] if len(shifts) > 1 else np.full(len(sampled), np.nan)
    lag = np.where(np.isnan(least), np.nan, shifts[best])
    at_zero = distance[:, zero[0]] if len(zero) else np.full(len(sampled), np.nan)
    return sampled, [lag, least, at_zero, distance.max(axis=1) - least, (second - least) / (least + 1e-6)]


def dtw_lag_features(
    df: DataFrame,
    ref: DataFrame,
    max_lag: float = 40,
    lag_step: float = 2,
    window: int = 41,
    radius: int = 5,
    sample_step: int = 5,
    log: str = "gr",
    prior: str = "prior",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Warping distance of the log window to the reference window at each lag, for every k-th row, filled in between.

    Best lag (the lowest at equal distance), least distance, distance at lag 0, spread, and confidence
    (second − best)/(best + 1e-6). Gaps of log and prior count as the series' median. Windows are cut where the series
    meets its curve, for the sampled rows only. The spread needs the distance at every lag, so that no lag can be
    left out by a lower bound. Curves that do not fit a task take the way over Spark windows.
    """
    lags = [float(v) for v in np.arange(-max_lag, max_lag + lag_step / 2, lag_step)]
    ids, ref_keys = [*keys, row], list(ref_keys or keys)
    half = window // 2
    given = df
    if curve_fits(ref, ref_keys):
        own, value, place = _scannable(df, ref, log, prior, ref_x, keys, ref_keys, row)
        # Series that are never cut are filled in between where they are scanned.
        whole, shifts = one_chunk(own, row) and longest(own, row) <= BLOCK, np.array(lags)

        def reduce(block: Block) -> dict[str, np.ndarray]:
            sampled, found = _warp_block(block, shifts, half, radius, sample_step)
            out = [np.full(len(block), np.nan) for _ in WARPED]
            for column, values in zip(out, found, strict=True):
                column[sampled] = values
                if whole:
                    for a, (low, high) in zip(block.start, block.spans, strict=True):
                        own = slice(a, a + high - low)
                        known = np.flatnonzero(~np.isnan(column[own]))
                        if len(known):
                            column[own] = np.interp(block.row[own], block.row[own][known], column[own][known])
            return dict(zip(WARPED, out, strict=True))

        result = ", ".join(f"{c} double" for c in WARPED)
        anchors = scan_chunks(own, ref, keys, ref_keys, (value, place, ref_x, ref_y), half, reduce, result, row)
        rows = given.join(anchors, ids, "left")
        return rows if whole else interpolate_columns(rows, WARPED, keys=keys, row=row)
    df = _signals(df, ref, log, prior, ref_x, keys, ref_keys, row)
    log, prior = "_x", "_p"
    ends = with_key_stats(df, keys, {"_last": F.max(row)}, row)
    ends = ends.withColumn("_sampled", (F.col(row) % sample_step == 0) | (F.col(row) == F.col("_last")))
    looked = curve_at_offsets(
        ends, ref, ref_keys, ids, prior, ref_x, ref_y, lags, [log, "_sampled"], "clamp"
    ).select(*ids, "_sampled", F.col(log).alias("_x"), F.col("ref_at").alias("_y"), F.col("offset").alias("lag"))
    bound = longest(df, row)
    looked = _spread(df, keys, with_bound(looked, bound, row) if bound else looked)

    def arrays(r: Rows) -> dict[str, Column]:
        w = r(-half, half)
        return {
            "_a": F.when(F.col("_sampled"), F.collect_list("_x").over(w)),
            "_b": F.when(F.col("_sampled"), F.collect_list("_y").over(w)),
        }

    pairs = apply_frames(looked, [*keys, "lag"], Frame(half, half, arrays), row=row).where(F.col("_sampled"))
    scored = pairs.select(*ids, "lag", dtw_distance("_a", "_b", radius).alias("d"))
    ordered = F.array_sort(F.collect_list("d"))
    anchors = scored.groupBy(*ids).agg(
        F.min_by("lag", F.struct("d", "lag")).alias("dtw_best_lag"),
        F.min("d").alias("dtw_min_distance"),
        F.max(F.when(F.col("lag") == 0, F.col("d"))).alias("dtw_distance_at_0"),
        (F.max("d") - F.min("d")).alias("dtw_spread"),
        ((F.get(ordered, F.lit(1)) - F.min("d")) / (F.min("d") + 1e-6)).alias("dtw_confidence"),
    )
    rows = given.join(anchors, ids, "left")
    return interpolate_columns(rows, WARPED, keys=keys, row=row)


def interpolate_columns(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Fill the gaps of several columns that are known on the same rows, by one pass along the series."""
    point = F.when(
        F.col(cols[0]).isNotNull(), F.struct(F.col(row).alias("r"), *[F.col(c).cast("double").alias(c) for c in cols])
    )
    both = carried(df, keys, last={"_a": point}, following={"_b": point}, row=row)
    share = (F.col(row) - F.col("_a.r")) / F.nullif(F.col("_b.r") - F.col("_a.r"), F.lit(0))
    return both.withColumns(
        {
            c: F.coalesce(
                F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * share, F.col(f"_a.{c}"), F.col(f"_b.{c}")
            )
            for c in cols
        }
    ).drop("_a", "_b")


def sample_and_interpolate(
    df: DataFrame, k: int, cols: Sequence[str], *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Keep the columns at every k-th row and the last one, and interpolate between."""
    ends = with_key_stats(df, keys, {"_last": F.max(row)}, row)
    keep = (F.col(row) % k == 0) | (F.col(row) == F.col("_last"))
    thinned = ends.withColumns({c: F.when(keep, F.col(c)) for c in cols}).drop("_last")
    return interpolate_columns(thinned, cols, keys=keys, row=row)


def alignment_interactions(
    df: DataFrame, lag_a: str = "best_lag", lag_b: str = "dtw_best_lag", corr: str = "best_corr", confidence: str = "dtw_confidence"
) -> DataFrame:
    """Difference of two aligners' lags and the product of their strengths; NULL gives 0."""
    return df.withColumns(
        {
            "lag_difference": F.coalesce(F.col(lag_a) - F.col(lag_b), F.lit(0.0)),
            "lag_strength": F.coalesce(F.col(corr) * F.col(confidence), F.lit(0.0)),
        }
    )


def fuse_candidates(
    df: DataFrame,
    ref: DataFrame,
    candidates: Sequence[str],
    log: str = "gr",
    z: str = "z",
    surface: str | None = None,
    anchor: str | None = None,
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Weighted mean of candidate columns; weight = exp(−log misfit/20) × (0.2 + 0.8·exp(−surface misfit/35)).

    Penalties are capped at 6; an unknown misfit counts as 60 (log) and 120 (surface). Without weight the
    median of the candidates stands in. Also the weighted std, weight sum, count and least log misfit.
    """
    if curve_fits(ref, keys):

        def reduce(block: Block) -> dict[str, np.ndarray]:
            v = np.column_stack([block.others[c] for c in candidates])
            there = ~np.isnan(v)
            miss = np.abs(block.x[:, None] - block.curve_at(v, "null"))
            weight = np.exp(-np.clip(np.where(np.isnan(miss), 60.0, miss) / 20.0, 0.0, 6.0))
            if surface:
                level = block.others[surface][:, None]
                off = np.abs(v + block.others[z][:, None] - level)
                factor = 0.20 + 0.80 * np.exp(-np.clip(np.where(np.isnan(off), 120.0, off) / 35.0, 0.0, 6.0))
                weight = weight * np.where(np.isnan(level), 1.0, factor)
            weight, count = np.where(there, weight, 0.0), there.sum(axis=1)
            held, total_weight = np.where(there, v, 0.0), weight.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                fused = (weight * held).sum(axis=1) / total_weight
                std = np.sqrt((weight * (held - fused[:, None]) ** 2).sum(axis=1) / total_weight)
            for i in np.flatnonzero((total_weight <= 1e-8) & (count > 0)):
                fused[i], std[i] = np.median(v[i][there[i]]), v[i][there[i]].std()
            least = np.min(np.where(there & ~np.isnan(miss), miss, np.inf), axis=1)
            out = {"fused": fused, "fused_std": std, "weight_sum": total_weight, "candidate_count": count}
            out["best_log_misfit"] = np.where(np.isinf(least), np.nan, least)
            return out | ({"fused_delta": fused - block.others[anchor]} if anchor else {})

        names = ["fused", *(["fused_delta"] if anchor else []), "fused_std", "weight_sum", "candidate_count", "best_log_misfit"]
        result = ", ".join(f"{n} {'long' if n == 'candidate_count' else 'double'}" for n in names)
        others = list(dict.fromkeys([*candidates, *([surface, z] if surface else []), *([anchor] if anchor else [])]))
        found = scan_chunks(df, ref, ids[:-1], keys, (log, candidates[0], ref_x, ref_y), 0, reduce, result, ids[-1], Part.known_points, others)
        return found.where("candidate_count > 0")
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(candidates)])
    carry = [log, z, *([surface] if surface else []), *([anchor] if anchor else [])]
    rows = df.select(*dict.fromkeys([*ids, *keys, *carry]), F.explode(values).alias("_c")).select("*", "_c.i", "_c.v").drop("_c")
    looked = interp_join(rows, ref, keys, "v", ref_x, ref_y, "_ref", "null").where(F.col("v").isNotNull())
    miss = F.abs(F.col(log) - F.col("_ref"))
    weight = F.exp(-clip(F.coalesce(miss, F.lit(60.0)) / 20.0, 0.0, 6.0))
    if surface:
        off = F.coalesce(F.abs(F.col("v") + F.col(z) - F.col(surface)), F.lit(120.0))
        factor = 0.20 + 0.80 * F.exp(-clip(off / 35.0, 0.0, 6.0))
        weight = weight * F.when(F.col(surface).isNotNull(), factor).otherwise(1.0)
    found = (
        looked.withColumns({"_w": weight, "_miss": miss})
        .groupBy(*ids)
        .agg(
            F.sum("_w").alias("weight_sum"),
            F.sum(F.col("_w") * F.col("v")).alias("_wv"),
            F.array_sort(F.collect_list(F.struct("i", "v", "_w"))).alias("_all"),
            F.count("v").alias("candidate_count"),
            F.min("_miss").alias("best_log_misfit"),
            *([F.max(anchor).alias("_anchor")] if anchor else []),
        )
    )
    plain = F.transform("_all", lambda c: c["v"])
    light = F.col("weight_sum") <= 1e-8
    fused = F.when(light, array_median(plain)).otherwise(ratio(F.col("_wv"), F.col("weight_sum")))
    found = found.withColumn("fused", fused)
    squares = F.aggregate(
        "_all", F.lit(0.0), lambda acc, c: acc + c["_w"] * (c["v"] - F.col("fused")) * (c["v"] - F.col("fused"))
    )
    return found.withColumn(
        "fused_std", F.when(light, array_std(plain)).otherwise(F.sqrt(ratio(squares, F.col("weight_sum"))))
    ).select(
        *ids,
        "fused",
        *([(F.col("fused") - F.col("_anchor")).alias("fused_delta")] if anchor else []),
        "fused_std",
        "weight_sum",
        "candidate_count",
        "best_log_misfit",
    )


def signal_consensus(df: DataFrame, cols: Sequence[str], *, prefix: str = "sig") -> DataFrame:
    """Mean, population std, median, range and pairwise differences of several signal columns."""
    every = F.array(*[F.col(c).cast("double") for c in cols])
    pairs = {
        f"{a}_minus_{b}": F.col(a) - F.col(b) for i, a in enumerate(cols) for b in cols[i + 1:]
    }
    return df.withColumns(
        {
            f"{prefix}_mean": array_mean(every),
            f"{prefix}_std": array_std(every),
            f"{prefix}_median": array_median(every),
            f"{prefix}_range": F.array_max(every) - F.array_min(every),
            **pairs,
        }
    )


def posterior_match(
    df: DataFrame,
    ref: DataFrame,
    sigma_log: float = 8.0,
    sigma_pos: float = 25.0,
    prior: str = "prior",
    log: str = "gr",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Mean reference position under Gaussian log misfit × Gaussian prior, and the largest weight, over all reference rows.

    One row per row of ``df``; NULL without log, prior or reference. ``ids`` are the series' keys and its row
    number, ``keys`` the reference's. Weights are taken relative to the largest, so that small ones do not vanish.
    Curves that do not fit a task are met by a join on their key, with sums per band of the exponent.
    """
    near_log, near_pos = 0.5 / sigma_log**2, 0.5 / sigma_pos**2
    if curve_fits(ref, keys):

        def match(x, place, curve_x, curve_y):
            position, peak = np.full(len(x), np.nan), np.full(len(x), np.nan)
            known = np.flatnonzero(~np.isnan(x) & ~np.isnan(place)) if len(curve_x) else np.zeros(0, int)
            rows = max(1, 2_000_000 // max(len(curve_x), 1))
            for start in range(0, len(known), rows):
                part = known[start : start + rows]
                power = -((curve_y - x[part, None]) ** 2) * near_log - (curve_x - place[part, None]) ** 2 * near_pos
                weight = np.exp(power - power.max(axis=1, keepdims=True))
                total = weight.sum(axis=1)
                position[part], peak[part] = weight @ curve_x / total, 1 / total
            return {"posterior_position": position, "posterior_peak": peak}

        result = "posterior_position double, posterior_peak double"
        return scan_chunks(df, ref, ids[:-1], keys, (log, prior, ref_x, ref_y), 0, per_part(match), result, ids[-1], Part.known_points)
    probes = df.where(F.col(log).isNotNull() & F.col(prior).isNotNull()).select(
        *dict.fromkeys([*ids, *keys]), F.col(prior).alias("_t0"), F.col(log).alias("_g")
    )
    points = ref.where(F.col(ref_y).isNotNull()).select(*keys, F.col(ref_x).alias("_t"), F.col(ref_y).alias("_r"))
    near = spread_join(probes, points, keys, ids)
    power = -F.pow(F.col("_r") - F.col("_g"), 2) * near_log - F.pow(F.col("_t") - F.col("_t0"), 2) * near_pos
    band = F.floor(power / 50.0)
    part = F.exp(power - band * 50.0)
    bands = near.groupBy(*ids, band.alias("_band")).agg(
        F.sum(part).alias("_w"), F.sum(part * F.col("_t")).alias("_wt"), F.max(power).alias("_top")
    )
    ordered = F.collect_list(F.struct("_band", "_w", "_wt"))
    found = bands.groupBy(*ids).agg(ordered.alias("_b"), F.max("_band").alias("_m"), F.max("_top").alias("_top"))

    def summed(field: str) -> Column:
        return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + b[field] * F.exp((b["_band"] - F.col("_m")) * 50.0))

    found = found.withColumns({"_sw": summed("_w"), "_st": summed("_wt")})
    found = found.select(
        *ids,
        (F.col("_st") / F.col("_sw")).alias("posterior_position"),
        (F.exp(F.col("_top") - F.col("_m") * 50.0) / F.col("_sw")).alias("posterior_peak"),
    )
    return df.select(*ids).join(found, list(ids), "left")
