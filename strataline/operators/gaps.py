"""Gap filling and normalisation of one column of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.asof import interp_join
from strataline.functions.columns import clip
from strataline.functions.quantiles import add_overall, average_rank, overall, with_key_percentiles
from strataline.functions.series import ROW, carried, with_key_stats

WELL = ("well_id",)


def fill_median(df: DataFrame, col: str, out: str = "filled", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """NULLs become the median of the series, or of all rows where the series has no value."""
    local = with_key_percentiles(df, keys, {"_median": (col, 0.5)}, row)
    both = add_overall(local, overall(df, {"_all": (col, 0.5)}))
    return both.withColumn(out, F.coalesce(col, "_median", "_all")).drop("_median", "_all")


def ffill_bfill(df: DataFrame, col: str, out: str = "filled", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Last known value; before the first known value, the first one."""
    both = carried(df, keys, last={"_last": F.col(col)}, following={"_next": F.col(col)}, row=row)
    return both.withColumn(out, F.coalesce("_last", "_next")).drop("_last", "_next")


def interpolate_gaps(
    df: DataFrame,
    col: str,
    out: str = "filled",
    fallback: float | None = None,
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Linear by row position between known values, constant outside them, ``fallback`` without any."""
    point = F.when(F.col(col).isNotNull(), F.struct(F.col(col).cast("double").alias("v"), F.col(row).alias("r")))
    both = carried(df, keys, last={"_a": point}, following={"_b": point}, row=row)
    share = (F.col(row) - F.col("_a.r")) / (F.col("_b.r") - F.col("_a.r"))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    value = F.coalesce(F.col(col).cast("double"), between, F.col("_a.v"), F.col("_b.v"), F.lit(fallback).cast("double"))
    return both.withColumn(out, value).drop("_a", "_b")


def observation_weight(
    df: DataFrame, col: str, out: str = "weight", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """1 where observed, else 0.30·exp(−d/25) for the distance d in rows to the nearest observed row, 0 without any."""
    at = F.when(F.col(col).isNotNull(), F.col(row))
    both = carried(df, keys, last={"_a": at}, following={"_b": at}, row=row)
    distance = F.least(F.col(row) - F.col("_a"), F.col("_b") - F.col(row))  # least() skips NULL
    weight = F.when(F.col(col).isNotNull(), 1.0).otherwise(F.coalesce(0.30 * F.exp(-distance / 25.0), F.lit(0.0)))
    return both.withColumn(out, weight).drop("_a", "_b")


def winsorize(
    df: DataFrame,
    col: str,
    low: float = 0.005,
    high: float = 0.995,
    out: str = "winsorized",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Clip to two percentiles of the series."""
    bounds = with_key_percentiles(df, keys, {"_lo": (col, low), "_hi": (col, high)}, row)
    return bounds.withColumn(out, clip(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def null_flag(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_isna", F.col(col).isNull().cast("int"))


def fill_from_reference(
    df: DataFrame,
    ref: DataFrame,
    col: str = "gr",
    at: str = "extrapolated",
    ref_x: str = "tvt",
    ref_y: str = "gr",
    out: str = "filled",
    *,
    keys: Sequence[str] = WELL,
) -> DataFrame:
    """Missing log values come from the reference curve at the extrapolated position."""
    looked = interp_join(df, ref, keys, at, ref_x, ref_y, out="_ref")
    return looked.withColumn(out, F.coalesce(col, "_ref")).drop("_ref")


def scale_percentile(
    df: DataFrame,
    col: str,
    known: str | Column | None = None,
    out: str = "scaled",
    *,
    min_rows: int = 10,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """``(v − p5) / max(p95 − p5, 1)`` with percentiles of the known rows; their min and max when there are few."""
    inside = F.lit(True) if known is None else (F.col(known) if isinstance(known, str) else known)
    base = df.withColumn("_v", F.when(inside, F.col(col)))
    base = with_key_percentiles(base, keys, {"_p5": ("_v", 0.05), "_p95": ("_v", 0.95)}, row)
    base = with_key_stats(base, keys, {"_n": F.count("_v"), "_min": F.min("_v"), "_max": F.max("_v")}, row)
    few = F.col("_n") < min_rows
    low, high = F.when(few, F.col("_min")).otherwise(F.col("_p5")), F.when(few, F.col("_max")).otherwise(F.col("_p95"))
    return base.withColumn(out, (F.col(col) - low) / F.greatest(high - low, F.lit(1.0))).drop(
        "_v", "_p5", "_p95", "_n", "_min", "_max"
    )


def zscore(df: DataFrame, col: str, out: str = "zscore", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    stats = with_key_stats(df, keys, {"_mean": F.avg(col), "_std": F.stddev_samp(col)}, row)
    return stats.withColumn(out, (F.col(col) - F.col("_mean")) / (F.col("_std") + 1e-8)).drop("_mean", "_std")


def robust_zscore(
    df: DataFrame, col: str, out: str = "robust_z", *, keys: Sequence[str] = WELL, row: str = ROW
) -> DataFrame:
    """``(v − median) / (1.4826·MAD)``; a tiny scale falls back to the standard deviation, then to 1. NULL gives 0."""
    centred = with_key_percentiles(df, keys, {"_median": (col, 0.5)}, row).withColumn(
        "_dev", F.abs(F.col(col) - F.coalesce("_median", F.lit(0.0)))
    )
    centred = with_key_percentiles(centred, keys, {"_mad": ("_dev", 0.5)}, row)
    centred = with_key_stats(centred, keys, {"_std": F.stddev_pop(col)}, row)

    def usable(scale: Column) -> Column:
        return F.when(scale >= 1e-6, scale)

    scale = F.coalesce(usable(F.col("_mad") * 1.4826), usable(F.col("_std")), F.lit(1.0))
    value = (F.col(col) - F.coalesce("_median", F.lit(0.0))) / scale
    return centred.withColumn(out, F.coalesce(value, F.lit(0.0))).drop("_median", "_dev", "_mad", "_std")


def pct_rank(df: DataFrame, col: str, out: str = "pct_rank", *, keys: Sequence[str] = WELL, row: str = ROW) -> DataFrame:
    """Percentile rank with average ties."""
    return average_rank(df, keys, col, out, row)
