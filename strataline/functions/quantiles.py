"""Exact interpolated percentiles, also for a key too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.series import ROW, attach, is_long, largest_group, longest, running_total
from strataline.settings import group_rows

Wanted = dict[str, tuple[str | Column, float]]


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _by_rank(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """Percentiles of one column by rank: equal values are counted first, then ranked by a range sort."""
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counts, keys, ["_v"], F.col("_n"), largest_group(counts, keys)[1])
    start = F.col("_upto") - F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < F.col("_upto")), F.col("_v")))

    picks, results = [], []
    for i, (name, q) in enumerate(wanted.items()):
        position = F.lit(float(q)) * (F.col("_total") - 1)
        picks += [
            at(F.floor(position)).alias(f"_lo{i}"),
            at(F.ceil(position)).alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_w{i}"),
        ]
        low, high, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        results.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *results)


def _by_column(wanted: Wanted) -> list[tuple[Column, dict[str, float]]]:
    """Wanted percentiles grouped by column: one pass over the values of a column gives all of them."""
    grouped: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (column, q) in wanted.items():
        grouped.setdefault(str(column), (_col(column), {}))[1][name] = q
    return list(grouped.values())


def _shares(column: Column, names: dict[str, float]) -> Column:
    return F.percentile(column, F.array(*[F.lit(float(q)) for q in names.values()]))


def key_percentiles(df: DataFrame, keys: Sequence[str], wanted: Wanted, row: str = ROW) -> DataFrame:
    """One row per key with the wanted percentiles ``{name: (column, fraction)}``."""
    bound = longest(df, row) if keys else None
    if bound is None:
        bound = largest_group(df, keys)[0]
    if bound <= group_rows(df.sparkSession):
        columns = _by_column(wanted)
        found = df.groupBy(*keys).agg(*[_shares(c, names).alias(f"_q{i}") for i, (c, names) in enumerate(columns)])
        return found.select(
            *keys, *[F.get(f"_q{i}", F.lit(j)).alias(n) for i, (_, names) in enumerate(columns) for j, n in enumerate(names)]
        )
    base = df.select(*keys).distinct() if keys else None
    parts = [_by_rank(df, keys, column, names) for column, names in _by_column(wanted)]
    if not keys:
        return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts, base)


def with_key_percentiles(df: DataFrame, keys: Sequence[str], wanted: Wanted, row: str = ROW) -> DataFrame:
    """Add percentiles of the whole series to each of its rows."""
    if not is_long(df, row):
        whole = Window.partitionBy(*keys)
        columns = _by_column(wanted)
        found = df.withColumns({f"_q{i}": _shares(c, names).over(whole) for i, (c, names) in enumerate(columns)})
        picks = {n: F.get(f"_q{i}", F.lit(j)) for i, (_, names) in enumerate(columns) for j, n in enumerate(names)}
        return found.withColumns(picks).drop(*[f"_q{i}" for i in range(len(columns))])
    return attach(df, key_percentiles(df, keys, wanted, row), keys, row)


def overall(df: DataFrame, wanted: Wanted) -> DataFrame:
    """One row with percentiles over all rows."""
    return key_percentiles(df, [], wanted)


def add_overall(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table next to every row; the single row is what gets broadcast.

    A table of several rows is an error when the query runs; one without rows gives NULLs.
    """
    kinds = dict(one_row.dtypes)
    rows = one_row.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in one_row.columns])
    several = F.raise_error(F.lit("a table of one row was expected"))
    checked = rows.select(*[F.when(F.col("_rows") > 1, several.cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in one_row.columns])
    return df.crossJoin(F.broadcast(checked))


def average_rank(df: DataFrame, keys: Sequence[str], col: str, out: str, row: str = ROW) -> DataFrame:
    """Rank of each non-null value in its series as a share of the non-null count; ties share their mean rank."""
    if not is_long(df, row):
        same = Window.partitionBy(*keys, col)
        ordered = Window.partitionBy(*keys).orderBy(F.col(col).asc_nulls_last())
        rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2
        return df.withColumn(out, F.when(F.col(col).isNotNull(), rank / F.count(col).over(Window.partitionBy(*keys))))
    # Counts per value and chunk: a value that fills the series still joins back chunk by chunk.
    chunk = F.floor(F.col(row) / F.lit(group_rows(df.sparkSession)))
    rows = df.withColumn("_c", chunk)
    parts = rows.where(F.col(col).isNotNull()).groupBy(*keys, col, "_c").agg(F.count(F.lit(1)).alias("_m"))
    values = parts.groupBy(*keys, col).agg(F.sum("_m").alias("_n"))
    ranked = running_total(values, keys, [col], F.col("_n"), largest_group(values, keys)[1])
    share = (F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_total")
    spread = parts.drop("_m").join(ranked.select(*keys, col, share.alias(out)), [*keys, col])
    return rows.join(spread, [*keys, col, "_c"], "left").drop("_c")
