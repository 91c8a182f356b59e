"""Look-ups in a sorted reference curve: neighbours, nearest row, linear interpolation.

Probe rows and reference rows of a key are merged into one order; the reference row
before and after each probe is then a carried value. The work is a sort, never a
product of probes and reference rows. Where many probes share a key, they are dealt into parts that
each get a copy of the key's reference rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.series import carried, index_series, largest_group
from strataline.settings import group_rows

# Rows of one key that a task sorts, where the key's reference rows are no more than that.
SPREAD_ROWS = 100_000
# Types that can tell rows apart by a hash.
_PLAIN = ("int", "bigint", "smallint", "tinyint", "double", "float", "string", "date", "timestamp", "timestamp_ntz", "boolean", "decimal")


def bracket(
    probe: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    x: str,
    ref_x: str,
    values: Sequence[str],
    low: str = "_low",
    high: str = "_high",
    sizes: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Add the last reference row at or before ``x`` and the first one after it, as structs ``(_x, values…)``.

    Reference positions must be unique within the key (see ``prepare_reference``). ``sizes``: the most rows of both kinds
    in a key, rows in all, and the most reference rows in a key.
    """
    point = F.struct(F.col(ref_x).cast("double").alias("_x"), *[F.col(v).alias(v) for v in values])
    refs = ref.where(F.col(ref_x).isNotNull()).select(
        *keys, F.col(ref_x).cast("double").alias("_x"), F.lit(0).alias("_kind"), point.alias("_ref")
    )
    probes = probe.select(
        *keys, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.struct(*probe.columns).alias("_probe")
    )
    merged = refs.unionByName(probes, allowMissingColumns=True)
    if sizes is None:
        counts = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("_kind")).alias("r"))
        sizes = tuple(v or 0 for v in counts.agg(F.max("n"), F.sum("n"), F.max("r")).first())
    held = group_rows(probe.sparkSession)
    most = min(SPREAD_ROWS, held)
    parts = sizes[0] // most + 1 if sizes[2] <= most else 1
    if sizes[0] <= held or parts > 1:
        within = list(keys)
        if parts > 1:
            plain = [c for c, kind in probe.dtypes if kind.split("(")[0] in _PLAIN]
            dealt = probes.withColumn("_deal", F.pmod(F.xxhash64(*[F.col("_probe")[c] for c in plain]), F.lit(parts)))
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
            merged, within = refs.withColumn("_deal", copies).unionByName(dealt, allowMissingColumns=True), [*keys, "_deal"]
        ahead = Window.partitionBy(*within).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy(*within).orderBy(F.desc("_x"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
        found = merged.withColumns(
            {
                low: F.last("_ref", ignorenulls=True).over(ahead),
                high: F.last("_ref", ignorenulls=True).over(back),
            }
        )
    else:
        placed = index_series(merged, keys, ["_x", "_kind"], "_place", sizes[:2])
        found = carried(placed, keys, last={low: F.col("_ref")}, following={high: F.col("_ref")}, row="_place")
    return found.where(F.col("_kind") == 1).select("_probe.*", low, high)


def interpolated(x: Column, y: str, edge: str, low: str = "_low", high: str = "_high") -> Column:
    """Value of the piecewise-linear curve at ``x`` from a bracket; outside: ``clamp`` or ``null``."""
    x0, y0 = F.col(f"{low}._x"), F.col(f"{low}.{y}")
    x1, y1 = F.col(f"{high}._x"), F.col(f"{high}.{y}")
    outside_low = y1 if edge == "clamp" else F.lit(None).cast("double")
    outside_high = y0 if edge == "clamp" else F.when(x == x0, y0)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(F.col(low).isNull(), outside_low)
        .when(F.col(high).isNull(), outside_high)
        .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    )


def interp_join(
    probe: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    x: str,
    ref_x: str,
    ref_y: str | dict[str, str],
    out: str = "ref_at",
    edge: str = "clamp",
    sizes: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Piecewise-linear look-up of one or several reference columns ``{output: column}`` at ``x``."""
    outputs = ref_y if isinstance(ref_y, dict) else {out: ref_y}
    found = bracket(probe, ref, keys, x, ref_x, list(dict.fromkeys(outputs.values())), sizes=sizes)
    return found.withColumns({o: interpolated(F.col(x), y, edge) for o, y in outputs.items()}).drop("_low", "_high")


def nearest_join(
    probe: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    x: str,
    ref_x: str,
    values: dict[str, str],
    tie: str = "lower",
) -> DataFrame:
    """Values ``{output: column}`` of the nearest reference row; ``tie`` picks a side at equal distance."""
    found = bracket(probe, ref, keys, x, ref_x, list(dict.fromkeys(values.values())))
    below, above = F.col(x) - F.col("_low._x"), F.col("_high._x") - F.col(x)
    closer = below <= above if tie == "lower" else below < above
    # An exact hit is always the lower neighbour.
    take_low = F.col("_high").isNull() | (F.col("_low").isNotNull() & (closer | (below == 0)))
    return found.withColumns(
        {
            o: F.when(F.col(x).isNotNull(), F.when(take_low, F.col(f"_low.{v}")).otherwise(F.col(f"_high.{v}")))
            for o, v in values.items()
        }
    ).drop("_low", "_high")


def curve_at_offsets(
    df: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    x: str,
    ref_x: str,
    ref_y: str,
    offsets: Sequence[float],
    carry: Sequence[str] = (),
    edge: str = "null",
) -> DataFrame:
    """Long table ``(ids, carry, offset, at, ref_at)``: the curve at ``x + offset`` for every row and offset.

    Only the columns named in ``carry`` travel with the multiplied rows.
    """
    wanted = list(dict.fromkeys([*ids, *keys, *carry, x]))
    shifted = df.select(*wanted, F.explode(F.array(*[F.lit(float(o)) for o in offsets])).alias("offset")).withColumn(
        "at", F.col(x) + F.col("offset")
    )
    own, curve = largest_group(df, keys), largest_group(ref, keys)
    sizes = (own[0] * len(offsets) + curve[0], own[1] * len(offsets) + curve[1], curve[0])
    return interp_join(shifted, ref, keys, "at", ref_x, ref_y, "ref_at", edge, sizes)
