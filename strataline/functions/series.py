"""Ordered series of any length: positions, row frames, carried values and key statistics.

A *series* is all rows of one key in a total order. ``index_series`` gives every
row its position and records in the column's metadata how many rows the longest
series has. The other functions read that bound when the plan is built:

* short enough for one task: plain windows over the key, one exchange for a chain;
* longer: the series is cut into chunks of ``strataline.group.rows`` positions,
  rows near a border are copied to the neighbouring chunk, and running values
  travel between chunks as one small row per chunk.

Both give the same rows. No step puts a whole long series into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataline.settings import checkpoint, group_rows

ROW = "row_idx"
BOUND = "strataline.longest"
CHUNK = "_chunk"


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and rows in all; the scan reads the key columns only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def longest(df: DataFrame, row: str = ROW) -> int | None:
    """The recorded bound on rows per key, if any."""
    return df.schema[row].metadata.get(BOUND) if row in df.columns else None


def with_bound(df: DataFrame, bound: int, row: str = ROW) -> DataFrame:
    return df.withMetadata(row, {BOUND: int(bound)})


def is_long(df: DataFrame, row: str = ROW) -> bool:
    bound = longest(df, row)
    return bound is None or bound > group_rows(df.sparkSession)


def _chunk_of(df: DataFrame, row: str = ROW) -> Column:
    return F.floor(F.col(row) / F.lit(group_rows(df.sparkSession)))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: Column, total_rows: int
) -> DataFrame:
    """Add ``_upto`` (running sum of weight, this row included) and ``_total`` per key.

    The rows are range-partitioned by key and order, so one key spreads over as
    many tasks as it needs, and written once: partition numbers must not change
    between the pass that sums partitions and the pass that numbers rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total_rows // group_rows(spark) + 1)
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = checkpoint(
        df.withColumn("_weight", weight).repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id())
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum("_weight").alias("_sum"))
        .select(
            *keys,
            "_part",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_sum").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*by[len(keys):]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(spans, [*keys, "_part"])
        .withColumn("_upto", F.col("_before") + F.sum("_weight").over(inside))
        .drop("_part", "_before", "_weight")
    )


def index_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = ROW, sizes: tuple[int, int] | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its series; ``order`` must be total within the key."""
    bound, total = sizes or largest_group(df, keys)
    if bound <= group_rows(df.sparkSession):
        by = Window.partitionBy(*keys).orderBy(*order)
        indexed = df.withColumn(out, F.row_number().over(by).cast("long") - 1)
    else:
        indexed = (
            running_total(df, keys, order, F.lit(1).cast("long"), total)
            .withColumn(out, F.col("_upto") - 1)
            .drop("_upto", "_total")
        )
    return with_bound(indexed, bound, out)


class Rows:
    """Row frames inside one series or one chunk of it."""

    def __init__(self, keys: Sequence[str], row: str):
        self.order: WindowSpec = Window.partitionBy(*keys).orderBy(row)

    def __call__(self, first: int, last: int) -> WindowSpec:
        return self.order.rowsBetween(first, last)


@dataclass(frozen=True)
class Frame:
    """Columns that look at most ``before`` rows back and ``after`` rows ahead."""

    before: int
    after: int
    columns: Callable[[Rows], dict[str, Column]]


def apply_frames(df: DataFrame, keys: Sequence[str], *stages: Frame | Sequence[Frame], row: str = ROW) -> DataFrame:
    """Add the columns of every stage; a later stage may read columns of an earlier one.

    All stages share one partitioning, so a chain of window features costs one exchange.
    """
    steps = [[s] if isinstance(s, Frame) else list(s) for s in stages]

    def add(frame_df: DataFrame, rows: Rows) -> DataFrame:
        for step in steps:
            frame_df = frame_df.withColumns({n: c for f in step for n, c in f.columns(rows).items()})
        return frame_df

    if not is_long(df, row):
        return add(df, Rows(keys, row))
    size = F.lit(group_rows(df.sparkSession))
    before = sum(max(f.before for f in step) for step in steps)
    after = sum(max(f.after for f in step) for step in steps)
    placed = _placed(df, keys, row)
    first = F.greatest(F.floor((F.col(_PLACE) - F.lit(after)) / size), F.lit(0))
    last = F.floor((F.col(_PLACE) + F.lit(before)) / size)
    copies = placed.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    own = F.col(CHUNK) == F.floor(F.col(_PLACE) / size)
    return add(copies, Rows([*keys, CHUNK], row)).where(own).drop(CHUNK, _PLACE)


_PLACE = "_place"


def with_place(df: DataFrame, keys: Sequence[str], out: str, row: str = ROW) -> DataFrame:
    """Add the 0-based position of each row among the rows of its key that are in the table."""
    if not is_long(df, row):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(row)).cast("long") - 1)
    return _placed(df, keys, row).withColumnRenamed(_PLACE, out)


def _placed(df: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Add the position of each row among the rows of its key that are there.

    Row numbers of a filtered table have gaps, and a frame counts rows, not numbers. Each chunk of
    row numbers counts its own rows and adds what the chunks before it hold.
    """
    rows = df.withColumn(CHUNK, _chunk_of(df, row))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    starts = checkpoint(counts.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(row)
    joined = rows.join(starts, [*keys, CHUNK], "left")
    return joined.withColumn(_PLACE, F.col("_before") + F.row_number().over(inside) - 1).drop(CHUNK, "_before")


def carried(
    df: DataFrame,
    keys: Sequence[str],
    last: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    row: str = ROW,
) -> DataFrame:
    """Running values along each series.

    ``last``: latest non-null value up to and including the row. ``following``: first
    non-null value from the row on. ``sums``: running sum, the row included.
    """
    last, following, sums = last or {}, following or {}, sums or {}
    if not is_long(df, row):
        ahead = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
        # A frame that ends "unbounded following" is quadratic; reading backwards is not.
        back = Window.partitionBy(*keys).orderBy(F.desc(row)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {n: F.last(c, ignorenulls=True).over(ahead) for n, c in last.items()}
            | {n: F.sum(c).over(ahead) for n, c in sums.items()}
            | {n: F.last(c, ignorenulls=True).over(back) for n, c in following.items()}
        )
    inputs = {f"_in_{n}": c for n, c in (last | following | sums).items()}
    rows = df.withColumns(inputs | {CHUNK: _chunk_of(df, row)})
    known = {n: F.when(F.col(f"_in_{n}").isNotNull(), F.col(row)) for n in last | following}
    ends = rows.groupBy(*keys, CHUNK).agg(
        *[F.max_by(F.col(f"_in_{n}"), known[n]).alias(n) for n in last],
        *[F.min_by(F.col(f"_in_{n}"), known[n]).alias(n) for n in following],
        *[F.sum(F.col(f"_in_{n}")).alias(n) for n in sums],
        F.count(F.lit(1)).alias("_n"),
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    entry = checkpoint(
        ends.select(
            *keys,
            CHUNK,
            *[F.last(n, ignorenulls=True).over(earlier).alias(f"_from_{n}") for n in last],
            *[F.last(n, ignorenulls=True).over(later).alias(f"_from_{n}") for n in following],
            *[F.sum(n).over(earlier).alias(f"_from_{n}") for n in sums],
        )
    )
    group = [*keys, CHUNK]
    ahead = Window.partitionBy(*group).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*group).orderBy(F.desc(row)).rowsBetween(Window.unboundedPreceding, 0)

    def inside(n: str, window: WindowSpec) -> Column:
        return F.coalesce(F.last(F.col(f"_in_{n}"), ignorenulls=True).over(window), F.col(f"_from_{n}"))

    def total(n: str) -> Column:
        here = F.sum(F.col(f"_in_{n}")).over(ahead)
        return F.when(F.col(f"_from_{n}").isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + F.col(f"_from_{n}"))

    joined = rows.join(entry, group, "left").withColumns(
        {n: inside(n, ahead) for n in last} | {n: total(n) for n in sums} | {n: inside(n, back) for n in following}
    )
    return joined.drop(CHUNK, *inputs, *[f"_from_{n}" for n in last | following | sums])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], row: str = ROW, how: str = "left") -> DataFrame:
    """Join the few statistics rows of each key (usually one) to the rows of that key.

    For long series the statistics are repeated once per chunk and the join runs on
    key and chunk, so the rows of a key never meet in one task.
    """
    if not is_long(df, row):
        return df.join(stats, list(keys), how)
    sizes = df.groupBy(*keys).agg(F.max(_chunk_of(df, row)).alias("_last_chunk"))
    return _attach_sized(df, sizes.join(stats, list(keys)), keys, row, how)


def _attach_sized(df: DataFrame, sized: DataFrame, keys: Sequence[str], row: str, how: str) -> DataFrame:
    """The join of ``attach``, given statistics with ``_last_chunk``.

    The small side is written first: a chain of such joins then reads the rows once per
    statistic instead of doubling its plan each time.
    """
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last_chunk")))
    spread = checkpoint(sized.withColumn(CHUNK, chunks).drop("_last_chunk"))
    return df.withColumn(CHUNK, _chunk_of(df, row)).join(spread, [*keys, CHUNK], how).drop(CHUNK)


def spread_join(
    df: DataFrame, table: DataFrame, keys: Sequence[str], ids: Sequence[str], how: str = "inner", size: int | None = None
) -> DataFrame:
    """Join rows to a smaller table on keys of which one may hold most rows.

    Where the largest key exceeds what a task may hold, its rows spread over salts taken from
    their ids, and the table is repeated once per salt.
    """
    keys = list(keys)
    largest = largest_group(df, keys)[0] if size is None else size
    salts = largest // group_rows(df.sparkSession) + 1
    if salts == 1:
        return df.join(table, keys, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(salts)))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def with_key_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], row: str = ROW) -> DataFrame:
    """Add plain aggregates of the whole series to each of its rows."""
    if not is_long(df, row):
        whole = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(whole) for n, c in stats.items()})
    sized = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()], F.max(_chunk_of(df, row)).alias("_last_chunk"))
    return _attach_sized(df, sized, keys, row, "left")


def with_length(df: DataFrame, keys: Sequence[str], out: str = "n_rows", row: str = ROW) -> DataFrame:
    return with_key_stats(df, keys, {out: F.count(F.lit(1))}, row)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
