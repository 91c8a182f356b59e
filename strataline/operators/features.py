"""Named feature sets, composed of the other operators, over one table per series.

All window columns of the chosen sets are one chain over one partitioning of the series. Sets that look at
the reference curve are computed from the same filled table and joined by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.quantiles import add_overall, overall, with_key_percentiles
from strataline.functions.series import ROW, Frame, apply_frames, with_key_stats
from strataline.operators.align import dtw_lag_features, lag_scan, lag_scan_multiscale, self_match, signature_match
from strataline.operators.layers import layer_context
from strataline.operators.windows import diff_frame, rolling_frame, slope_frame
from strataline.sources.tables import sanitize_features

WELL = ("well_id",)


def _log_frames(log: str, md: str) -> list[Frame]:
    filled = f"{log}_filled"
    return [
        *rolling_frame(filled, [10, 30, 100], ["mean"], prefix="log_", center=True),
        *rolling_frame(filled, [10], ["std"], prefix="log_", center=True),
        slope_frame(filled, md, 30, "log_slope_30"),
        diff_frame(filled, [1, 5], prefix="log_diff_"),
    ]


def _shift_frame(log: str, steps: Sequence[int]) -> Frame:
    filled = F.col(f"{log}_filled")

    def columns(rows) -> dict[str, Column]:
        back = {f"log_lag_{k}": F.coalesce(F.lag(filled, k).over(rows.order), filled) for k in steps}
        return back | {f"log_lead_{k}": F.coalesce(F.lead(filled, k).over(rows.order), filled) for k in steps}

    return Frame(max(steps), max(steps), columns)


# Window columns per set, from the names of the log and the depth.
WINDOW_SETS: dict[str, Callable[[str, str], list[Frame]]] = {
    "basic": _log_frames,
    "lags": lambda log, md: [_shift_frame(log, [1, 2, 5, 10])],
}
REFERENCE_SETS = ("scan", "scales", "warp", "layers")
# Sets of the tail that compare it with the series' own prefix.
OWN_SETS = ("self", "signature")


def build_features(
    df: DataFrame,
    ref: DataFrame | None = None,
    sets: Sequence[str] = ("basic",),
    *,
    log: str = "gr",
    probe: str = "tvt_input",
    md: str = "md",
    xyz: tuple[str, str, str] = ("x", "y", "z"),
    prior: str = "prior",
    label: str = "geology",
    options: dict[str, dict] | None = None,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> tuple[DataFrame, list[str]]:
    """The table with the columns of the named sets, gaps as 0, and the names of the feature columns.

    ``basic``: depth from the start and as a share, filled log with rolling statistics, slope and steps, filled
    target, steps and length of the path. ``lags``: the log some rows away. ``scan``, ``warp`` and ``layers``
    need the reference: lag scan, warping distance, and layers around the prior (``options`` by set name), as does ``scales``:
    lag scans of the scaled log at several windows. ``self`` and ``signature`` match the tail with the prefix. Series and curves of
    all these sets are gathered once per set, as arrays, and come back by row.
    """
    unknown = set(sets) - {*WINDOW_SETS, *REFERENCE_SETS, *OWN_SETS}
    if unknown:
        raise ValueError(f"unknown feature sets {sorted(unknown)}")
    options = options or {}
    given = df.columns
    middle = {"_log_median": (log, 0.5), "_probe_median": (probe, 0.5)}
    stats = with_key_stats(df, keys, {"_first": F.min(md), "_last": F.max(md)}, row)
    stats = with_key_percentiles(stats, keys, middle, row)
    stats = add_overall(stats, overall(df, {"_all_log": (log, 0.5), "_all_probe": (probe, 0.5)}))
    depth = F.col(md) - F.col("_first")
    rows = stats.withColumns(
        {
            "depth_from_start": depth,
            "depth_fraction": F.coalesce(F.try_divide(depth, F.col("_last") - F.col("_first")), F.lit(0.0)),
            f"{log}_filled": F.coalesce(log, "_log_median", "_all_log", F.lit(0.0)),
            f"{probe}_filled": F.coalesce(probe, "_probe_median", "_all_probe", F.lit(0.0)),
        }
    ).drop("_first", "_last", *middle, "_all_log", "_all_probe")
    frames = [diff_frame(c, [1], prefix=f"{c}_step_") for c in xyz]
    for name in sets:
        frames += WINDOW_SETS[name](log, md) if name in WINDOW_SETS else []
    rows = apply_frames(rows, keys, frames, row=row)
    length = sum((F.pow(F.col(f"{c}_step_1"), 2) for c in xyz), F.lit(0.0))
    rows = rows.withColumn("path_step", F.sqrt(length))
    ids = [*keys, row]
    for name in sets:
        if name in REFERENCE_SETS and ref is None:
            raise ValueError(f"{name} needs a reference")
        own = options.get(name, {})
        if name == "scan":
            found = lag_scan(df, ref, log=log, prior=prior, keys=keys, ref_keys=ref_keys, row=row, **own)
        elif name == "warp":
            found = dtw_lag_features(df, ref, log=log, prior=prior, keys=keys, ref_keys=ref_keys, row=row, **own).drop(
                *[c for c in given if c not in ids]
            )
        elif name == "scales":
            found = lag_scan_multiscale(df, ref, log=log, prior=prior, keys=keys, ref_keys=ref_keys, row=row, **own)
        elif name in OWN_SETS:
            match = self_match if name == "self" else signature_match
            found = match(df, **({"log": log, "probe": probe} | own), keys=keys, row=row)
            found = found.withColumnsRenamed({c: c.replace("match", name) for c in found.columns if c not in ids})
        elif name == "layers":
            found = layer_context(df, ref, prior, log, label=label, ids=ids, keys=list(ref_keys or keys), **own)
        else:
            continue
        rows = rows.join(found.select(*ids, *[c for c in found.columns if c not in rows.columns]), ids, "left")
    numbers = {"double", "float", "int", "bigint"}
    names = [c for c, kind in rows.dtypes if c not in given and kind in numbers]
    return sanitize_features(rows, names), names
