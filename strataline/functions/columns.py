"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def rounded_to(value: str | Column, digits: int = 6) -> Column:
    """Rounded, with one kind of zero."""
    return F.round(col(value).cast("double"), digits) + F.lit(0.0)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """NULL stays NULL; a NULL bound does not bind."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def mean_of(columns: Sequence[Column]) -> Column:
    return total(columns) / F.lit(float(len(columns)))


def array_mean(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(array), F.lit(0))


def array_std(array: Column) -> Column:
    """Population standard deviation of an array of doubles."""
    mean = array_mean(array)
    squares = F.aggregate(F.transform(array, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(squares / F.nullif(F.size(array), F.lit(0)))


def array_median(array: Column) -> Column:
    ordered, n = F.array_sort(array), F.size(array)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, (F.floor((n + 1) / 2) - 1).cast("int"))
    return (lower + upper) / 2


def resolve_column(df: DataFrame, names: Sequence[str]) -> str:
    """First of ``names`` that the table has, upper or lower case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name in df.columns:
            return name
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise KeyError(f"none of {list(names)} in {df.columns}")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL for a zero denominator (sessions may treat that as an error)."""
    return F.try_divide(a, b)


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation as an aggregate, NULL without spread; a row counts only if both are known."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sa, sb = [p.over(over) for p in parts] if over is not None else parts
    return F.try_divide(cov, sa * sb)
