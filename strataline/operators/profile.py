"""Profiles of whole tables and of each series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.columns import correlation
from strataline.functions.quantiles import add_overall, key_percentiles
from strataline.functions.series import ROW, Frame, apply_frames, index_series
from strataline.operators.geometry import path_summary, step_features
from strataline.operators.zones import last_known, longest_null_run, split_zone

WELL = ("well_id",)
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_c")
    ).select("_c.*")


def numeric_summary(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Count, missing, mean, std, min, max and percentiles, one row per column."""
    rows = _long(df, cols)
    stats = rows.groupBy("column").agg(
        F.count("value").alias("count"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    shares = key_percentiles(rows, ["column"], {f"p{round(q * 100):02d}": ("value", q) for q in percentiles})
    return stats.join(shares, "column")


def missing_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values and their share per column; a column the table lacks is missing everywhere."""
    counts = [F.count(F.col(c)) if c in df.columns else F.lit(0).cast("long") for c in cols]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[n.alias(f"c{i}") for i, n in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"c{i}")).alias("missing")) for i, c in enumerate(cols)])
    return wide.select("_n", F.explode(rows).alias("_r")).select(
        "_r.column", "_r.missing", F.when(F.col("_n") > 0, F.col("_r.missing") / F.col("_n")).otherwise(0.0).alias("share")
    )


def entity_summary(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = WELL) -> DataFrame:
    """Rows and min, max, mean, std, range of each column per entity."""
    picks = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        picks += [
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range"),
        ]
    return df.groupBy(*keys).agg(*picks)


def outlier_entities(summary: DataFrame, metrics: Sequence[str], n: int = 10, keys: Sequence[str] = WELL) -> DataFrame:
    """The n entities with the largest absolute z-score over several metrics."""
    known = summary.dropna(subset=list(metrics))
    spread = known.agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_samp(m).alias(f"_s_{m}") for m in metrics])
    scores = [
        F.when(F.coalesce(F.col(f"_s_{m}"), F.lit(0.0)) == 0, 0.0).otherwise(F.abs((F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}")))
        for m in metrics
    ]
    worst = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (
        add_overall(known, spread)
        .select(*keys, *metrics, worst.alias("outlier_score"))
        .orderBy(F.desc("outlier_score"), *keys)
        .limit(n)
    )


def representative_entities(summary: DataFrame, size: str = "rows", keys: Sequence[str] = WELL) -> DataFrame:
    """Shortest, middle and longest entity."""
    placed = index_series(summary.select(*keys, size), [], [size, *keys], "_place")
    ends = add_overall(placed, summary.agg(F.count(F.lit(1)).alias("_n")))
    role = (
        F.when(F.col("_place") == 0, "shortest")
        .when(F.col("_place") == F.floor(F.col("_n") / 2), "median")
        .when(F.col("_place") == F.col("_n") - 1, "longest")
    )
    return ends.withColumn("role", role).where(F.col("role").isNotNull()).select("role", *keys, size)


def drift_report(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and std of shared columns in two tables, and the difference of the means."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return _long(df, cols).groupBy("column").agg(F.avg("value").alias(f"{prefix}_mean"), F.stddev_samp("value").alias(f"{prefix}_std"))

    return side(a, "left").join(side(b, "right"), "column").withColumn("mean_delta", F.col("right_mean") - F.col("left_mean"))


def safe_corr(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation per pair of columns; NULL with fewer than two rows or two different values on a side."""
    picks = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        # Two different values exist exactly if the least is below the largest.
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        picks += [F.count(x).alias(f"n{i}"), F.when(varied & (F.count(x) >= 2), correlation(x, y)).alias(f"r{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"n{i}").alias("rows"), F.col(f"r{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return df.agg(*picks).select(F.explode(rows).alias("_p")).select("_p.*")


def _share(condition: Column, inside: Column) -> Column:
    rows = F.sum(inside.cast("long"))
    return F.when(rows > 0, F.sum((condition & inside).cast("long")) / rows)


def log_quality(df: DataFrame, log: str = "gr", probe: str = "tvt_input", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Missing share and longest gap of the log: all rows, prefix, tail."""
    zoned = split_zone(df, probe, keys=keys, row=row)
    gap, everywhere = F.col(log).isNull(), F.lit(True)
    shares = zoned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("in_prefix").cast("long")).alias("prefix_rows"),
        _share(gap, everywhere).alias("missing_all"),
        _share(gap, F.col("in_prefix")).alias("missing_prefix"),
        _share(gap, ~F.col("in_prefix")).alias("missing_tail"),
    )
    return shares.join(longest_null_run(df, log, probe, keys=keys, row=row), list(keys))


def series_summary(
    df: DataFrame,
    target: str = "tvt",
    log: str = "gr",
    probe: str = "tvt_input",
    md: str = "md",
    xyz: Sequence[str] = ("x", "y", "z"),
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Prefix and tail rows, spans, heading, missing log share, error of the last known value, median target step."""
    keys = list(keys)
    anchored = last_known(split_zone(df, probe, keys=keys, row=row), {"_a": probe}, probe, keys, row)
    miss = F.when(F.col("is_eval"), F.col(target) - F.col("_a"))
    parts = anchored.groupBy(*keys).agg(
        F.count(probe).alias("known_rows"),
        F.sum(F.col("is_eval").cast("long")).alias("tail_rows"),
        F.max("_a").alias("last_known"),
        (1 - F.count(log) / F.count(F.lit(1))).alias("log_missing"),
        F.sqrt(F.avg(miss * miss)).alias("baseline_rmse"),
    )
    step = Frame(1, 0, lambda rows: {"_step": F.abs(F.col(target) - F.lag(target, 1).over(rows.order))})
    steps = key_percentiles(apply_frames(df, keys, step, row=row), keys, {"median_abs_step": ("_step", 0.5)}, row)
    path = path_summary(df, md, xyz, keys=keys, row=row).select(*keys, "n_rows", "md_span", "xy_span", "z_delta", "heading")
    return reduce(lambda a, b: a.join(b, keys), [path, parts, steps])


def step_summary(
    df: DataFrame, md: str = "md", xyz: Sequence[str] = ("x", "y", "z"), *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """Summary of the step length and its ratio to the depth step, without the first row of a series."""
    stepped = step_features(df, md, xyz, keys=keys, row=row)
    inside = stepped.where(F.col(row) > 0)
    ratio = F.col("step_length") / F.when(F.col("md_step") != 0, F.col("md_step"))
    return numeric_summary(inside.withColumn("step_ratio", ratio), ["step_length", "step_ratio"], (0.05, 0.5, 0.95))


def bounded_sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, chosen by a hash of their ids: the same rows however the table is partitioned."""
    text = F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *ids).limit(n)
