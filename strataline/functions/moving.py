"""Moving statistics whose time does not depend on the window, over series as arrays.

Sums are differences of running sums over values less their mean, in extended precision, so that they keep their
digits; minima and maxima are taken block by block from both sides; a median moves along in one sorted list. A
series of one chunk is a group of its own; a longer one is cut into chunks with the rows around them that
their windows reach. Spark's own frames add up every row of every window and are left for narrow ones.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.scan import SCAN_ROWS, one_chunk
from strataline.functions.series import CHUNK, ROW, longest, with_bound, with_place

_AT = "_moving_at"


def _limits(n: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    return np.maximum(at - before, 0), np.minimum(at + after + 1, n)


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.longdouble)
    np.cumsum(values, out=out[1:])
    return out


def _centred(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, float]:
    """Known values less their mean, unknown ones as 0."""
    shift = float(values[known].mean()) if known.any() else 0.0
    return np.where(known, values.astype(np.longdouble) - shift, 0.0), shift


def moving_moments(values: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (none without a known value) and standard deviation (ddof 1; 0 with fewer than two) of the known values."""
    known = ~np.isnan(values)
    low, high = _limits(len(values), before, after)
    x, shift = _centred(values, known)
    count, s, ss = ((r := _running(v))[high] - r[low] for v in (known.astype(float), x, x * x))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s / count
        spread = ss - s * mean
        std = np.sqrt(np.where(spread > 1e-15 * ss, spread, 0.0) / (count - 1))
    return np.where(count > 0, mean + shift, np.nan).astype(float), np.where(count > 1, std, 0.0).astype(float)


def moving_slope(y: np.ndarray, x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Regression slope of y on x over rows that know both; 0 with fewer than two rows or without spread of x."""
    known = ~np.isnan(x) & ~np.isnan(y)
    low, high = _limits(len(x), before, after)
    (xc, _), (yc, _) = _centred(x, known), _centred(y, known)
    count, sx, sy, sxx, sxy = ((r := _running(v))[high] - r[low] for v in (known.astype(float), xc, yc, xc * xc, xc * yc))
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = sxx - sx * sx / count
        slope = (sxy - sx * sy / count) / spread
    return np.where((count >= 2) & (spread > 1e-15 * sxx), slope, 0.0).astype(float)


def moving_min(values: np.ndarray, before: int, after: int) -> np.ndarray:
    """Least known value: of a window that spans two blocks of its length, the end of the one and the beginning of the other."""
    n = len(values)
    before, after = min(before, n), min(after, n)
    size = before + after + 1
    padded = np.full(-(-(n + size) // size) * size, np.inf)
    padded[before : before + n] = np.where(np.isnan(values), np.inf, values)
    blocks = padded.reshape(-1, size)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    found = np.minimum(since[:n], upto[size - 1 : size - 1 + n])
    return np.where(np.isinf(found), np.nan, found)


def moving_median(values: np.ndarray, before: int, after: int) -> np.ndarray:
    """Median of the known values: one sorted list that a row enters and a row leaves."""
    out = np.full(len(values), np.nan)
    held: list[float] = []
    rows = values.tolist()
    n = len(rows)
    for row in rows[: min(after, n)]:
        if row == row:
            insort(held, row)
    for i in range(n):
        if i + after < n and (new := rows[i + after]) == new:
            insort(held, new)
        if i > before and (old := rows[i - before - 1]) == old:
            del held[bisect_left(held, old)]
        if held:
            middle = len(held) // 2
            out[i] = held[middle] if len(held) % 2 else (held[middle - 1] + held[middle]) / 2
    return out


@dataclass(frozen=True)
class Moving:
    """Columns from values within ``before`` and ``after`` rows: ``make`` takes the named columns as arrays."""

    inputs: tuple[str, ...]
    before: int
    after: int
    outputs: tuple[str, ...]
    make: Callable[..., Sequence[np.ndarray]]


def moving_stats(value: str, before: int, after: int, stats: dict[str, str]) -> Moving:
    """``stats`` maps mean, std, min, max or median to the name of its column."""

    def make(x: np.ndarray) -> list[np.ndarray]:
        made: dict[str, np.ndarray] = {}
        if {"mean", "std"} & set(stats):
            made["mean"], made["std"] = moving_moments(x, before, after)
        for name, fn in (("min", moving_min), ("max", lambda v, b, a: -moving_min(-v, b, a)), ("median", moving_median)):
            if name in stats:
                made[name] = fn(x, before, after)
        return [made[s] for s in stats]

    return Moving((value,), before, after, tuple(stats.values()), make)


def moving_slopes(y: str, x: str, before: int, after: int, out: str) -> Moving:
    return Moving((y, x), before, after, (out,), lambda b, a: [moving_slope(b, a, before, after)])


def apply_moving(df: DataFrame, keys: Sequence[str], steps: Sequence[Moving], row: str = ROW) -> DataFrame:
    """Add the columns of all steps: one gathering of each series, or of each chunk with its surroundings."""
    keys = list(keys)
    whole, bound = one_chunk(df, row), longest(df, row)
    group, rows = keys, df
    if not whole:
        size = F.lit(SCAN_ROWS)
        before, after = max(s.before for s in steps), max(s.after for s in steps)
        placed = with_place(df, keys, _AT, row)
        first = F.greatest(F.floor((F.col(_AT) - after) / size), F.lit(0))
        rows = placed.withColumn(CHUNK, F.explode(F.sequence(first, F.floor((F.col(_AT) + before) / size))))
        group = [*keys, CHUNK]
    names = [*df.columns]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(row, "ascending")])).combine_chunks()
        out = table.select(names)
        for step in steps:
            given = [table.column(c).to_numpy().astype(float) for c in step.inputs]
            for name, values in zip(step.outputs, step.make(*given), strict=True):
                out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        if not whole:
            own = pc.equal(pc.cast(pc.floor(pc.divide(pc.cast(table.column(_AT), pa.float64()), float(SCAN_ROWS))), pa.int64()), table.column(CHUNK))
            out = out.filter(own)
        return out

    fields = ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes), *(f"`{o}` double" for s in steps for o in s.outputs)])
    found = rows.groupBy(*group).applyInArrow(run, fields)
    return with_bound(found, bound, row) if bound else found
