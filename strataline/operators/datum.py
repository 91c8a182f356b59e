"""Datum identities: a series' target is a surface minus its elevation plus a constant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions.quantiles import key_percentiles, overall
from strataline.functions.series import ROW, attach
from strataline.operators.signals import spread_columns
from strataline.operators.zones import split_zone

WELL = ("well_id",)


def _offset(surface: str, probe: str, z: str) -> Column:
    return F.col(probe) + F.col(z) - F.col(surface)


def datum_offsets(
    df: DataFrame,
    surface: str,
    late: int = 50,
    probe: str = "tvt_input",
    z: str = "z",
    prefix: str = "offset",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Offset ``value + z − surface`` on the prefix: median of all, first, middle and late rows, exponential mean."""
    return _offsets(df, {prefix: surface}, late, probe, z, keys=keys, row=row)


def _offsets(
    df: DataFrame, surfaces: dict[str, str], late: int, probe: str, z: str, *, keys: Sequence[str], row: str
) -> DataFrame:
    """Offsets of several surfaces (by prefix) from one pass over the prefix rows."""
    known = split_zone(df, probe, keys=keys, row=row).where(F.col("in_prefix"))
    n, i = F.col("eval_start"), F.col(row)
    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    # Scaled so that it cannot overflow on long prefixes.
    rows, wanted, means = known.withColumn("_w", F.exp(0.02 * (i - (n - 1)))), {}, []
    for prefix, surface in surfaces.items():
        b = _offset(surface, probe, z)
        parts = {
            "full": b,
            "early": F.when((third == 0) | (i < third), b),
            "mid": F.when((two <= third) | ((i >= third) & (i < two)), b),
            "late": F.when((n < 5) | (i >= n - late), b),
        }
        rows = rows.withColumns({f"_in_{prefix}_{kind}": part for kind, part in parts.items()})
        wanted |= {f"{prefix}_{kind}": (f"_in_{prefix}_{kind}", 0.5) for kind in parts}
        full = F.col(f"_in_{prefix}_full")
        means.append((F.sum(F.col("_w") * full) / F.sum(F.when(full.isNotNull(), F.col("_w")))).alias(f"{prefix}_exp"))
    return key_percentiles(rows, keys, wanted, row).join(rows.groupBy(*keys).agg(*means), list(keys))


def datum_predict(
    df: DataFrame,
    surfaces: Sequence[str],
    late: int = 50,
    probe: str = "tvt_input",
    z: str = "z",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Target from each surface with the full, late and exponential offset."""
    offsets = _offsets(df.select(*keys, row, probe, z, *surfaces), {f"_{s}": s for s in surfaces}, late, probe, z, keys=keys, row=row)
    joined = attach(df, offsets, keys, row)
    values = {f"{s}_{kind}": F.col(s) - F.col(z) + F.col(f"_{s}_{kind}") for s in surfaces for kind in ("full", "late", "exp")}
    return joined.withColumns(values).drop(*[f"_{s}_{kind}" for s in surfaces for kind in ("full", "early", "mid", "late", "exp")])


def surface_spread(df: DataFrame, cols: Sequence[str], prefix: str = "surface") -> DataFrame:
    """Mean, population std, min, max and range of the predictions from several surfaces."""
    return df.withColumns(spread_columns(cols, prefix))


def surface_error(
    df: DataFrame,
    surfaces: Sequence[str],
    probe: str = "tvt_input",
    z: str = "z",
    *,
    keys: Sequence[str] = WELL,
    row: str = ROW,
) -> DataFrame:
    """Per series and surface: RMSE of the prefix around the full offset, and mean offset."""
    known = split_zone(df, probe, keys=keys, row=row).where(F.col("in_prefix"))
    long = known.select(
        *keys,
        row,
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("surface"), _offset(s, probe, z).alias("b")) for s in surfaces])
        ).alias("_s"),
    ).select(*keys, row, "_s.surface", "_s.b")
    group = [*keys, "surface"]
    middle = key_percentiles(long, group, {"offset": ("b", 0.5)}, row)
    # Mean squared distance from the median, from moments around the mean: one pass, no join of rows.
    moments = long.groupBy(*group).agg(F.avg("b").alias("bias"), F.var_pop("b").alias("_v"))
    return middle.join(moments, group).select(
        *group, "offset", "bias", F.sqrt(F.col("_v") + F.pow(F.col("bias") - F.col("offset"), 2)).alias("prefix_rmse")
    )


def contact_predict(
    df: DataFrame,
    ref: DataFrame,
    label: str,
    surface: str,
    target: str = "tvt",
    z: str = "z",
    ref_x: str = "tvt",
    ref_label: str = "geology",
    out: str = "contact_value",
    *,
    keys: Sequence[str] = WELL,
    ref_keys: Sequence[str] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Target from the depth at which the reference meets a label (or its first label) and the mean offset."""
    ref_keys = list(ref_keys or keys)
    labelled = ref.where(F.col(ref_label).isNotNull())
    contact = labelled.groupBy(*ref_keys).agg(
        F.coalesce(F.min(F.when(F.col(ref_label) == label, F.col(ref_x))), F.min(ref_x)).alias("_c")
    )
    shape = F.col(surface) - F.col(z)
    mean = df.groupBy(*dict.fromkeys([*keys, *ref_keys])).agg(F.avg(F.col(target) - shape).alias("_m"))
    offsets = mean.join(contact, ref_keys).select(*keys, (F.col("_m") - F.col("_c")).alias("_offset"), "_c")
    return attach(df, offsets, keys, row).withColumn(out, F.col("_c") + shape + F.col("_offset")).drop("_c", "_offset")


def identity_check(
    df: DataFrame, surface: str, target: str = "tvt", z: str = "z", *, keys: Sequence[str] = WELL
) -> DataFrame:
    """Median over the series of the standard deviation of ``target − (surface − z)``; 0 for an exact identity."""
    per_key = df.groupBy(*keys).agg(F.stddev_samp(F.col(target) - (F.col(surface) - F.col(z))).alias("_sd"))
    count = per_key.agg(F.count(F.lit(1)).alias("entities"), F.max("_sd").alias("worst_std"))
    return count.crossJoin(overall(per_key, {"median_std": ("_sd", 0.5)}))  # one row each
