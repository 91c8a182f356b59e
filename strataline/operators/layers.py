"""Layers (runs of equal label) of the reference curve, and category encoding."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.asof import bracket, nearest_join
from strataline.functions.quantiles import add_overall, key_percentiles, with_key_percentiles
from strataline.functions.series import (
    ROW,
    Frame,
    Rows,
    apply_frames,
    carried,
    index_series,
    spread_join,
    with_key_stats,
)
from strataline.operators.windows import distinct_in_range

WELL = ("well_id",)
UNKNOWN = "UNKNOWN"


def clean_label(label: str | Column) -> Column:
    """Blank or missing label → ``UNKNOWN``."""
    text = F.col(label) if isinstance(label, str) else label
    return F.when(text.isNull() | (F.trim(text) == ""), UNKNOWN).otherwise(text)


def with_runs(
    ref: DataFrame, x: str = "tvt", label: str = "geology", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Add to each reference row its run: id, top, bottom, thickness, label above and below, number of runs.

    ``ref`` must be numbered in order of ``x`` (see ``prepare_reference``). Thickness is
    bottom − top + median step, at least 0.
    """
    ref = ref.withColumn(label, clean_label(label))
    here = F.col(label)

    def changes(rows: Rows) -> dict[str, Column]:
        before, after = F.lag(label, 1).over(rows.order), F.lead(label, 1).over(rows.order)
        starts = before.isNull() | (before != here)
        return {
            "_starts": starts.cast("long"),
            "_begin": F.when(starts, F.struct(F.col(x).alias("top"), F.coalesce(before, here).alias("above"))),
            "_finish": F.when(
                after.isNull() | (after != here), F.struct(F.col(x).alias("bottom"), F.coalesce(after, here).alias("below"))
            ),
            "_step": F.col(x) - F.lag(x, 1).over(rows.order),
        }

    marked = apply_frames(ref, keys, Frame(1, 1, changes), row=row)
    found = carried(
        marked,
        keys,
        last={"_b": F.col("_begin")},
        following={"_f": F.col("_finish")},
        sums={"_no": F.col("_starts")},
        row=row,
    )
    found = with_key_percentiles(found, keys, {"_median_step": ("_step", 0.5)}, row)
    found = with_key_stats(found, keys, {"n_runs": F.sum("_starts")}, row)
    step = F.greatest(F.coalesce("_median_step", F.lit(0.0)), F.lit(0.0))
    return found.withColumns(
        {
            "run_id": F.col("_no") - 1,
            "top": F.col("_b.top"),
            "bottom": F.col("_f.bottom"),
            "above": F.col("_b.above"),
            "below": F.col("_f.below"),
            "thickness": F.greatest(F.col("_f.bottom") - F.col("_b.top") + step, F.lit(0.0)),
        }
    ).drop("_starts", "_begin", "_finish", "_step", "_b", "_f", "_no", "_median_step")


def label_runs(ref: DataFrame, x: str = "tvt", label: str = "geology", *, keys=WELL, row: str = ROW) -> DataFrame:
    """One row per run of equal labels along the curve."""
    runs = with_runs(ref, x, label, keys=keys, row=row)
    return runs.groupBy(*keys, "run_id").agg(
        F.max(label).alias("label"),
        F.max("top").alias("top"),
        F.max("bottom").alias("bottom"),
        F.max("thickness").alias("thickness"),
        F.count(F.lit(1)).alias("rows"),
    )


def label_boundaries(ref: DataFrame, x: str = "tvt", label: str = "geology", *, keys=WELL, row: str = ROW) -> DataFrame:
    """Positions where the label changes: the first row of the new label, and midway from the row before."""

    def changes(rows: Rows) -> dict[str, Column]:
        before = F.lag(label, 1).over(rows.order)
        return {
            "_change": before.isNotNull() & (before != F.col(label)),
            "midpoint": (F.col(x) + F.lag(x, 1).over(rows.order)) / 2,
        }

    known = ref.withColumn(label, clean_label(label))
    marked = apply_frames(known, keys, Frame(1, 0, changes), row=row).where("_change")
    return marked.select(*keys, F.col(x).alias("boundary"), "midpoint")


def interval_bounds(ref: DataFrame, x: str = "tvt", label: str = "geology", *, keys=WELL, row: str = ROW) -> DataFrame:
    """Intervals between successive bounds: first position, label changes, last position."""
    changes = label_boundaries(ref, x, label, keys=keys, row=row).select(*keys, F.col("boundary").alias("bound"))
    ends = ref.groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    ends = ends.select(*keys, F.explode(F.array("a", "b")).alias("bound"))
    bounds = index_series(changes.unionByName(ends).distinct(), keys, ["bound"])
    lead = Frame(0, 1, lambda rows: {"base": F.lead("bound", 1).over(rows.order)})
    return apply_frames(bounds, keys, lead).where(F.col("base").isNotNull()).select(
        *keys, F.col("bound").alias("top"), "base"
    )


RUN_VALUES = ["label", "above", "below", "top", "bottom", "thickness"]


def layer_lookup(
    df: DataFrame,
    ref: DataFrame,
    x: str,
    ref_x: str = "tvt",
    label: str = "geology",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Layer of the nearest reference row: label, layers above and below, thickness, distances to top and bottom."""
    runs = with_runs(ref, ref_x, label, keys=keys).withColumnRenamed(label, "label")
    values = {f"layer_{v}": v for v in RUN_VALUES}
    found = nearest_join(df, runs, keys, x, ref_x, values, tie="upper")
    return found.withColumns(
        {
            "distance_to_top": F.greatest(F.col(x) - F.col("layer_top"), F.lit(0.0)),
            "distance_to_bottom": F.greatest(F.col("layer_bottom") - F.col(x), F.lit(0.0)),
        }
    )


def layer_context(
    df: DataFrame,
    ref: DataFrame,
    x: str,
    log: str = "gr",
    offsets: Sequence[float] = (5.0, -5.0, 15.0, -15.0),
    radius: float = 25.0,
    ref_x: str = "tvt",
    ref_y: str = "gr",
    label: str = "geology",
    *,
    ids: Sequence[str] = (*WELL, ROW),
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Layer number from both ends, place inside the layer, log statistics of its label, residual and z-score,
    labels at several offsets and number of different labels around."""
    runs = with_runs(ref, ref_x, label, keys=keys)
    runs = with_key_stats(
        runs, [*keys, label], {"label_mean": F.avg(ref_y), "_std": F.stddev_pop(ref_y)}
    ).withColumns(
        {
            "label_std": F.when(F.col("_std") > 1e-6, F.col("_std")).otherwise(1.0),
            "label_mean": F.coalesce("label_mean", F.lit(0.0)),
        }
    )
    ids = list(ids)
    places = df.select(
        *dict.fromkeys([*ids, *keys]),
        F.col(log).alias("_log"),
        F.col(x).alias("_x"),
        F.explode(F.array(F.lit(0.0), *[F.lit(float(o)) for o in offsets])).alias("_o"),
    ).withColumn("_at", F.col("_x") + F.col("_o"))
    names = ["run_id", "n_runs", "top", "bottom", "label_mean", "label_std"]
    looked = nearest_join(places, runs, keys, "_at", ref_x, {n: n for n in names} | {"_label": label}, tie="upper")
    here = F.col("_o") == 0

    def name(o: float) -> str:
        return f"label_{'p' if o > 0 else 'm'}{abs(o):g}"

    found = looked.groupBy(*ids).agg(
        *[F.max(F.when(here, F.col(n))).alias(n) for n in [*names, "_x", "_log"]],
        *[F.max(F.when(F.col("_o") == float(o), F.col("_label"))).alias(name(o)) for o in offsets],
    )
    counted = distinct_in_range(df, ref, radius, x, ref_x, label, "distinct_labels", keys=keys, ids=ids)
    residual = F.col("_log") - F.col("label_mean")
    return found.join(counted.select(*ids, "distinct_labels"), ids, "left").select(
        *ids,
        (F.col("run_id") + 1).alias("layer_index"),
        (F.col("n_runs") - F.col("run_id")).alias("layer_index_from_bottom"),
        F.col("n_runs").alias("n_layers"),
        ((F.col("_x") - F.col("top")) / (F.col("bottom") - F.col("top") + 1e-6)).alias("layer_fraction"),
        F.col("top").alias("layer_top"),
        F.col("bottom").alias("layer_bottom"),
        "label_mean",
        "label_std",
        residual.alias("log_minus_label"),
        (residual / (F.col("label_std") + 1e-6)).alias("log_label_z"),
        *[name(o) for o in offsets],
        "distinct_labels",
    )


def interval_context(
    df: DataFrame,
    ref: DataFrame,
    x: str,
    ref_x: str = "tvt",
    label: str = "geology",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Place of ``x`` in its interval: distances, thickness, phase, its sine and cosine, balance, proximity.

    Positions outside belong to the first or the last interval.
    """
    bounds = interval_bounds(ref, ref_x, label, keys=keys)
    found = bracket(df, bounds, keys, x, "top", ["base"])
    top, base = F.coalesce("_low._x", "_high._x"), F.coalesce("_low.base", "_high.base")
    found = found.withColumns({"_t": top, "_b": base, "interval_thickness": base - top}).drop("_low", "_high")
    thick = F.when(F.abs("interval_thickness") > 1e-9, F.col("interval_thickness"))
    before, after = F.col(x) - F.col("_t"), F.col("_b") - F.col(x)
    phase = before / thick
    return found.withColumns(
        {
            "prev_boundary_dist": F.when(thick.isNotNull(), before),
            "next_boundary_dist": F.when(thick.isNotNull(), after),
            "interval_phase": phase,
            "phase_sin": F.sin(phase * pi),
            "phase_cos": F.cos(phase * pi),
            "boundary_balance": (after - before) / (thick + 1e-6),
            "boundary_proximity": F.least(before, after) / (thick + 1e-6),
        }
    ).drop("_t", "_b")


def boundary_count(
    df: DataFrame,
    ref: DataFrame,
    a: str,
    b: str,
    out: str = "boundaries_crossed",
    ref_x: str = "tvt",
    label: str = "geology",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Boundaries in (min(a, b), max(a, b]]: difference of two ranks, found by one look-up each."""
    changes = label_boundaries(ref, ref_x, label, keys=keys)
    ranked = index_series(changes, keys, ["boundary"], "_rank")
    pair = df.withColumns({"_from": F.least(a, b), "_to": F.greatest(a, b)})
    low = bracket(pair, ranked, keys, "_from", "boundary", ["_rank"], "_l", "_ignored").drop("_ignored")
    both = bracket(low, ranked, keys, "_to", "boundary", ["_rank"], "_h", "_ignored").drop("_ignored")
    count = F.coalesce(F.col("_h._rank") + 1, F.lit(0)) - F.coalesce(F.col("_l._rank") + 1, F.lit(0))
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return both.withColumn(out, F.when(known, count.cast("long"))).drop("_from", "_to", "_l", "_h")


def boundary_distance(
    df: DataFrame,
    ref: DataFrame,
    x: str,
    cap: float = 999.0,
    out: str = "boundary_distance",
    at: str = "midpoint",
    ref_x: str = "tvt",
    label: str = "geology",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Distance to the nearest boundary, at most ``cap`` (also without any boundary)."""
    changes = label_boundaries(ref, ref_x, label, keys=keys)
    near = nearest_join(df, changes.select(*keys, at), keys, x, at, {"_near": at})
    return near.withColumn(out, F.least(F.coalesce(F.abs(F.col(x) - F.col("_near")), F.lit(cap)), F.lit(cap))).drop("_near")


def reference_summary(
    ref: DataFrame, x: str = "tvt", y: str = "gr", label: str = "geology", *, keys=WELL, row: str = ROW
) -> DataFrame:
    """Rows, span, log minimum, median and maximum, number of labels and the most common step (lowest on ties)."""
    step = Frame(1, 0, lambda rows: {"_step": F.round(F.col(x) - F.lag(x, 1).over(rows.order), 6)})
    stepped = apply_frames(ref, keys, step, row=row)
    modes = stepped.where(F.col("_step").isNotNull()).groupBy(*keys, "_step").count()
    modes = modes.groupBy(*keys).agg(F.max_by("_step", F.struct(F.col("count"), -F.col("_step"))).alias("modal_step"))
    spans = ref.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        (F.max(x) - F.min(x)).alias("x_span"),
        F.min(y).alias("log_min"),
        F.max(y).alias("log_max"),
        F.count_distinct(clean_label(label)).alias("n_labels"),
    )
    middle = key_percentiles(ref, keys, {"log_median": (y, 0.5)}, row)
    return spans.join(middle, list(keys), "left").join(modes, list(keys), "left")


def top_frequencies(ref: DataFrame, col: str, n: int) -> DataFrame:
    """The n most common values; equal counts in order of the value."""
    counts = ref.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), F.asc_nulls_first("value")).limit(n)


def target_encode(
    train: DataFrame, test: DataFrame, cat: str, y: str, fold: str, smoothing: float = 20.0, out: str = "encoded"
) -> tuple[DataFrame, DataFrame]:
    """Smoothed category means: training rows from the other folds only, test rows from all folds.

    ``(mean·n + overall·m) / (n + m)``; a category without rows gives the overall mean. Sums are
    taken per fold and category once; what a fold may see is the total minus its own part.
    """
    part = train.groupBy(fold, cat).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    whole = part.groupBy(cat).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    overall = train.agg(F.avg(y).alias("_g"))

    def smooth(s: Column, n: Column) -> Column:
        return F.when(n > 0, (s + F.col("_g") * smoothing) / (n + smoothing)).otherwise(F.col("_g"))

    others = add_overall(part.join(whole, cat), overall).select(
        fold, cat, smooth(F.col("_all_s") - F.col("_s"), F.col("_all_n") - F.col("_n")).alias(out)
    )
    every = add_overall(whole, overall).select(cat, smooth(F.col("_all_s"), F.col("_all_n")).alias(out))
    seen = spread_join(train, others, [fold, cat], train.columns, "left")
    new = spread_join(test, every, [cat], test.columns, "left")
    fill = F.coalesce(out, "_g")
    return (
        add_overall(seen, overall).withColumn(out, fill).drop("_g"),
        add_overall(new, overall).withColumn(out, fill).drop("_g"),
    )


def encode_categories(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Codes from one sorted vocabulary of both tables; missing values count as ``UNKNOWN``."""
    for col in cols:
        train, test = train.withColumn(col, F.coalesce(col, F.lit(UNKNOWN))), test.withColumn(col, F.coalesce(col, F.lit(UNKNOWN)))
        words = train.select(col).distinct().unionByName(test.select(col).distinct()).distinct()
        codes = index_series(words, [], [col], f"{col}_code")
        train = spread_join(train, codes, [col], train.columns, "left")
        test = spread_join(test, codes, [col], test.columns, "left")
    return train, test
