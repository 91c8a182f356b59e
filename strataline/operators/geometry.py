"""Trajectory geometry from depth and three coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.columns import clip
from strataline.functions.quantiles import key_percentiles, with_key_percentiles
from strataline.functions.series import ROW, Frame, Rows, apply_frames, carried, with_key_stats
from strataline.operators.windows import rolling_frame

WELL = ("well_id",)
XYZ = ("x", "y", "z")


def _norm(*parts: Column) -> Column:
    square = parts[0] * parts[0]
    for p in parts[1:]:
        square = square + p * p
    return F.sqrt(square)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def step_frame(md: str = "md", xyz: Sequence[str] = XYZ) -> list[Frame]:
    """Two stages: differences to the previous row (0 on the first), then the step length."""

    def steps(rows: Rows) -> dict[str, Column]:
        return {
            f"{out}_step": _zero(F.col(c) - F.lag(c, 1).over(rows.order))
            for c, out in zip([md, *xyz], ["md", "x", "y", "z"])
        }

    def lengths(rows: Rows) -> dict[str, Column]:
        return {
            "xy_step": _norm(F.col("x_step"), F.col("y_step")),
            "step_length": _norm(F.col("x_step"), F.col("y_step"), F.col("z_step")),
        }

    return [Frame(1, 0, steps), Frame(0, 0, lengths)]


def step_features(df: DataFrame, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW) -> DataFrame:
    return apply_frames(df, keys, *step_frame(md, xyz), row=row)


def dls_ratio(
    df: DataFrame, window: int = 30, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Step length per depth step, its trailing mean, and the trailing mean of the vertical gradient."""
    run = F.when(F.col("md_step") != 0, F.abs("md_step"))

    def ratios(rows: Rows) -> dict[str, Column]:
        return {"step_ratio": _zero(F.col("step_length") / run), "_grad": _zero(F.col("z_step") / run)}

    def means(rows: Rows) -> dict[str, Column]:
        w = rows(-(window - 1), 0)
        return {"step_ratio_mean": F.avg("step_ratio").over(w), "z_gradient_mean": F.avg("_grad").over(w)}

    stages = [*step_frame(md, xyz), Frame(0, 0, ratios), Frame(window - 1, 0, means)]
    return apply_frames(df, keys, *stages, row=row).drop("_grad")


def lateral_distance(df: DataFrame, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Path length on the map, straight distance from the first row, and height below the first row."""
    x, y, z = xyz
    stepped = step_features(df, md, xyz, keys=keys, row=row)
    summed = carried(stepped, keys, sums={"lateral_distance": F.col("xy_step")}, row=row)
    first = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    start = with_key_stats(summed, keys, {"_start": F.min_by(first, row)}, row)
    return start.withColumns(
        {
            "straight_distance": _norm(F.col(x) - F.col("_start.x"), F.col(y) - F.col("_start.y")),
            "below_start": F.col("_start.z") - F.col(z),
        }
    ).drop("_start")


def z_curvature(df: DataFrame, z: str = "z", window: int = 30, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Second difference of the centred rolling mean of z; 0 on the first two rows."""
    smooth = rolling_frame(z, [window], ["mean"], center=True, prefix="_z_")

    def curve(rows: Rows) -> dict[str, Column]:
        m = F.col(f"_z_mean_{window}")
        return {"z_curvature": _zero(m - 2 * F.lag(m, 1).over(rows.order) + F.lag(m, 2).over(rows.order))}

    return apply_frames(df, keys, smooth, Frame(2, 0, curve), row=row).drop(f"_z_mean_{window}")


def incl_azimuth(df: DataFrame, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Angles of each step: against the vertical and on the map."""
    stepped = step_features(df, md, xyz, keys=keys, row=row)
    return stepped.withColumns(
        {
            "inclination": F.atan2(F.col("xy_step"), F.col("z_step")),
            "azimuth": F.atan2(F.col("y_step"), F.col("x_step")),
        }
    )


def dogleg_simple(
    df: DataFrame, incl: str = "inclination", azim: str = "azimuth", tvd: str = "z", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Root of squared changes of two angle columns, and the change of the vertical depth."""

    def columns(rows: Rows) -> dict[str, Column]:
        change = [_zero(F.col(c) - F.lag(c, 1).over(rows.order)) for c in (incl, azim, tvd)]
        return {"dls": _norm(change[0], change[1]), "tvd_gradient": change[2]}

    return apply_frames(df, keys, Frame(1, 0, columns), row=row)


def dogleg_angle(
    df: DataFrame,
    probe: str = "tvt_input",
    context: int = 100,
    xyz: Sequence[str] = XYZ,
    *,
    keys=WELL,
    row: str = ROW,
) -> DataFrame:
    """Angle in degrees between successive steps, and its 95th percentile over the last prefix rows."""
    x, y, z = xyz

    def units(rows: Rows) -> dict[str, Column]:
        d = [F.col(c) - F.lag(c, 1).over(rows.order) for c in (x, y, z)]
        size = _norm(*d) + 1e-9
        return {f"_u{i}": p / size for i, p in enumerate(d)}

    def angles(rows: Rows) -> dict[str, Column]:
        dot = sum((F.col(f"_u{i}") * F.lag(f"_u{i}", 1).over(rows.order) for i in range(1, 3)),
                  F.col("_u0") * F.lag("_u0", 1).over(rows.order))
        return {"dogleg": _zero(F.degrees(F.acos(clip(dot, -1.0, 1.0))))}

    found = apply_frames(df, keys, Frame(1, 0, units), Frame(1, 0, angles), row=row).drop("_u0", "_u1", "_u2")
    start = with_key_stats(
        found, keys, {"_first": F.min(F.when(F.col(probe).isNull(), F.col(row))), "_n": F.count(F.lit(1))}, row
    ).withColumn("_end", F.coalesce("_first", "_n"))
    recent = F.when((F.col(row) < F.col("_end")) & (F.col(row) >= F.col("_end") - context), F.col("dogleg"))
    return with_key_percentiles(start.withColumn("_recent", recent), keys, {"dogleg_p95": ("_recent", 0.95)}, row).drop(
        "_first", "_n", "_end", "_recent"
    )


def local_slope(df: DataFrame, y: str = "z", x: str = "md", half: int = 5, *, keys=WELL, row: str = ROW) -> DataFrame:
    """Regression slope over ±half rows; rows without a full window get 0."""

    def columns(rows: Rows) -> dict[str, Column]:
        w = rows(-half, half)
        full = F.count(F.lit(1)).over(w) == 2 * half + 1
        return {"local_slope": _zero(F.when(full, F.regr_slope(F.col(y), F.col(x)).over(w)))}

    return apply_frames(df, keys, Frame(half, half, columns), row=row)


def jerk(df: DataFrame, z: str = "z", md: str = "md", *, keys=WELL, row: str = ROW) -> DataFrame:
    """Change of the depth gradient per unit of depth, and its centred 5-row mean."""

    def run(rows: Rows) -> Column:
        return F.greatest(F.col(md) - F.lag(md, 1).over(rows.order), F.lit(1e-9))

    def gradient(rows: Rows) -> dict[str, Column]:
        first = F.lag(md, 1).over(rows.order).isNull()
        return {
            "_run": F.when(~first, run(rows)),
            "_g": F.when(first, 0.0).otherwise((F.col(z) - F.lag(z, 1).over(rows.order)) / run(rows)),
        }

    def change(rows: Rows) -> dict[str, Column]:
        return {"jerk": _zero((F.col("_g") - F.lag("_g", 1).over(rows.order)) / F.col("_run"))}

    def mean(rows: Rows) -> dict[str, Column]:
        return {"jerk_mean": F.avg("jerk").over(rows(-2, 2))}

    stages = [Frame(1, 0, gradient), Frame(1, 0, change), Frame(2, 2, mean)]
    return apply_frames(df, keys, *stages, row=row).drop("_run", "_g")


def tortuosity(
    df: DataFrame,
    windows: Sequence[int] = (25, 75),
    smooth: int = 31,
    md: str = "md",
    xyz: Sequence[str] = XYZ,
    *,
    keys=WELL,
    row: str = ROW,
) -> DataFrame:
    """Arc over chord − 1 of the last ``w`` steps, and the smoothed change of the first of them."""
    x, y, z = xyz
    widest = max(windows)

    def ratios(rows: Rows) -> dict[str, Column]:
        out = {}
        for w in windows:
            arc = F.sum("step_length").over(rows(-(w - 1), 0))
            chord = _norm(*[F.col(c) - F.first(c).over(rows(-w, 0)) for c in (x, y, z)])
            out[f"tortuosity_{w}"] = F.greatest(arc / (chord + 1e-6) - 1.0, F.lit(0.0))
        return out

    main = f"tortuosity_{windows[0]}"
    half = smooth // 2

    def change(rows: Rows) -> dict[str, Column]:
        return {"_change": F.col(main) - F.lag(main, 1).over(rows.order)}

    def mean(rows: Rows) -> dict[str, Column]:
        return {f"{main}_slope": _zero(F.avg("_change").over(rows(-half, half)))}

    stages = [*step_frame(md, xyz), Frame(widest, 0, ratios), Frame(1, 0, change), Frame(half, half, mean)]
    return apply_frames(df, keys, *stages, row=row).drop("_change")


def direction_change(
    df: DataFrame,
    span: int = 10,
    smooth: int = 31,
    md: str = "md",
    xyz: Sequence[str] = XYZ,
    *,
    keys=WELL,
    row: str = ROW,
) -> DataFrame:
    """Turning angle of the ±span chord per unit of depth, and its centred mean."""

    def chords(rows: Rows) -> dict[str, Column]:
        ahead, back = rows(0, span), rows(-span, 0)
        out = {f"_c{i}": F.last(c).over(ahead) - F.first(c).over(back) for i, c in enumerate(xyz)}
        before, after = F.lag(md, 1).over(rows.order), F.lead(md, 1).over(rows.order)
        inner = (after - before) / 2
        out["_run"] = F.coalesce(inner, after - F.col(md), F.col(md) - before)
        return out

    def turn(rows: Rows) -> dict[str, Column]:
        a = [F.lag(f"_c{i}", 1).over(rows.order) for i in range(3)]
        b = [F.col(f"_c{i}") for i in range(3)]
        dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        cross = _norm(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        return {"direction_change": _zero(F.atan2(cross, dot)) / (F.abs("_run") + 1e-6)}

    half = smooth // 2

    def mean(rows: Rows) -> dict[str, Column]:
        return {"direction_change_mean": F.avg("direction_change").over(rows(-half, half))}

    stages = [Frame(span, span, chords), Frame(1, 0, turn), Frame(half, half, mean)]
    return apply_frames(df, keys, *stages, row=row).drop("_c0", "_c1", "_c2", "_run")


def path_summary(
    df: DataFrame, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Spans, heading, monotonic-depth flag and percentiles of gradient and curvature per series."""
    x, y, z = xyz

    def gradients(rows: Rows) -> dict[str, Column]:
        run = F.col(md) - F.lag(md, 1).over(rows.order)
        safe = F.when(F.abs(run) > 1e-9, run)
        return {"_back": run < 0} | {f"_g{i}": (F.col(c) - F.lag(c, 1).over(rows.order)) / safe for i, c in enumerate(xyz)}

    def curvature(rows: Rows) -> dict[str, Column]:
        return {"_curve": _norm(*[F.col(f"_g{i}") - F.lag(f"_g{i}", 1).over(rows.order) for i in range(3)])}

    steps = apply_frames(df, keys, Frame(1, 0, gradients), Frame(1, 0, curvature), row=row)
    point = F.struct(F.col(md).alias("md"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))
    ends = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by(point, row).alias("a"),
        F.max_by(point, row).alias("b"),
        (~F.coalesce(F.bool_or("_back"), F.lit(False))).alias("md_monotonic"),
    )
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    spans = ends.select(
        *keys,
        "n_rows",
        "md_monotonic",
        (F.col("b.md") - F.col("a.md")).alias("md_span"),
        _norm(dx, dy).alias("xy_span"),
        (F.col("b.z") - F.col("a.z")).alias("z_delta"),
        ((F.degrees(F.atan2(dx, dy)) + 360.0) % 360.0).alias("heading"),
    )
    shares = key_percentiles(
        steps,
        keys,
        {
            "gradient_median": ("_g2", 0.5),
            "gradient_p95": (F.abs("_g2"), 0.95),
            "curvature_median": ("_curve", 0.5),
            "curvature_p95": ("_curve", 0.95),
        },
        row,
    )
    return spans.join(shares, list(keys), "left")


def per_depth_derivatives(
    df: DataFrame, md: str = "md", xyz: Sequence[str] = XYZ, *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Change of each coordinate per depth step (NULL without a step), dip proxy (0 there) and its change."""

    def derivatives(rows: Rows) -> dict[str, Column]:
        run = F.col(md) - F.lag(md, 1).over(rows.order)
        out = {
            f"d{n}_dmd": (F.col(c) - F.lag(c, 1).over(rows.order)) / F.when(run != 0, run)
            for n, c in zip("xyz", xyz)
        }
        return out

    def dip(rows: Rows) -> dict[str, Column]:
        proxy = _zero(F.col("dz_dmd"))
        return {"dip_proxy": proxy, "dip_change": _zero(proxy - F.lag(proxy, 1).over(rows.order))}

    return apply_frames(df, keys, Frame(1, 0, derivatives), Frame(1, 0, dip), row=row)
