"""A series next to its reference curve as arrays, chunk by chunk in Arrow batches.

A series meets its curve as one array. The curve comes once for all the series of a task that share it, and they pass by
as plain rows in order, so a task holds one curve, one chunk and a few thousand rows. A series of at most ``SCAN_ROWS`` rows is one chunk and is prepared (gaps,
scales) where it is scanned; a longer one is prepared by Spark and cut into chunks of ``SCAN_ROWS`` rows, each with
the rows within ``halo`` around it. Many short series are worked on together: rows × lags is one matrix, and running
sums down its columns serve all windows and lags at once, so neither a lag nor a series costs calls of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.series import ROW, largest_group, longest, with_place
from strataline.functions.stream import starts, whole_runs
from strataline.settings import group_rows

SCAN_ROWS = 20_000
BLOCK = 2_048
# Lags whose running sums are worked on together: few enough for them to stay in the processor's cache.
LAGS = 24
_AT, _CHUNK, _DEAL, _KIND = "_at", "_scan_chunk", "_deal", "_kind"
# Tasks per partition that the series of all curves are dealt to; each holds one curve.
DEALS = 2


def curve_fits(ref: DataFrame, ref_keys: Sequence[str]) -> bool:
    """Whether the longest curve may be one array in a task."""
    return largest_group(ref, ref_keys)[0] <= group_rows(ref.sparkSession)


def one_chunk(df: DataFrame, row: str = ROW) -> bool:
    """Whether every series is known to be one chunk."""
    bound = longest(df, row)
    return bound is not None and bound <= min(SCAN_ROWS, group_rows(df.sparkSession))


@dataclass
class Part:
    """A series, or a chunk of one, and its curve. Unknown values are NaN."""

    x: np.ndarray
    place: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray
    middle: float  # median of the curve's places
    whole: bool
    others: dict[str, np.ndarray]

    def fill(self) -> None:
        """Gaps of value and place become the series' median (the curve's, then 0 or none), curve points without value go."""
        if self.whole:
            for values in (self.x, self.place):
                gaps = np.isnan(values)
                if gaps.any() and not gaps.all():
                    values[gaps] = np.median(values[~gaps])
        self.x[np.isnan(self.x)] = 0.0
        self.place[np.isnan(self.place)] = self.middle
        known = ~np.isnan(self.curve_y)
        self.curve_x, self.curve_y = self.curve_x[known], self.curve_y[known]


    def known_points(self) -> None:
        """Curve points without value go; nothing is filled."""
        known = ~np.isnan(self.curve_y)
        self.curve_x, self.curve_y = self.curve_x[known], self.curve_y[known]


def robust_scores(values: np.ndarray) -> np.ndarray:
    """``(v − median) / (1.4826·MAD)``; a tiny scale falls back to the standard deviation, then to 1. Unknown gives 0."""
    known = values[~np.isnan(values)]
    if not len(known):
        return np.zeros(len(values))
    middle = np.median(known)
    scales = (1.4826 * np.median(np.abs(known - middle)), known.std(), 1.0)
    return np.nan_to_num((values - middle) / next(s for s in scales if s >= 1e-6), nan=0.0)


def _interpolated(x: np.ndarray, curve_x: np.ndarray, curve_y: np.ndarray) -> np.ndarray:
    """Linear interpolation, ends held, in the order of operations that ``asof.interp_join`` has."""
    low = np.clip(np.searchsorted(curve_x, x, "right") - 1, 0, max(len(curve_x) - 2, 0))
    high = np.minimum(low + 1, len(curve_x) - 1)
    x0, y0 = curve_x[low], curve_y[low]
    with np.errstate(invalid="ignore", divide="ignore"):
        found = y0 + (curve_y[high] - y0) * (x - x0) / (curve_x[high] - x0)
    found = np.where(x <= curve_x[0], curve_y[0], found)
    return np.where(x >= curve_x[-1], curve_y[-1], found)


class Block:
    """Parts one after the other, as many as make a worthwhile matrix."""

    def __init__(self, parts: list[tuple[Part, np.ndarray, int, int]]):
        self.parts = [p for p, _, _, _ in parts]
        self.spans = [(low, high) for _, _, low, high in parts]
        sizes = np.array([high - low for low, high in self.spans])
        self.start = np.cumsum(sizes) - sizes
        self.first = np.repeat(self.start, sizes)
        self.last = np.repeat(self.start + sizes, sizes)
        self.x = np.concatenate([p.x[low:high] for p, _, low, high in parts])
        self.place = np.concatenate([p.place[low:high] for p, _, low, high in parts])
        self.row = np.concatenate([row[low:high] for _, row, low, high in parts])
        names = self.parts[0].others
        self.others = {n: np.concatenate([p.others[n][low:high] for p, _, low, high in parts]) for n in names}

    def __len__(self) -> int:
        return len(self.x)

    def curve_at(self, places: np.ndarray, edge: str = "clamp") -> np.ndarray:
        """The curve's values at one or several places per row; ends held, or unknown beyond them, NaN without a curve."""
        out = np.full(places.shape, np.nan)
        for part, (low, high), at in zip(self.parts, self.spans, self.start, strict=True):
            if len(part.curve_x):
                own = slice(at, at + high - low)
                out[own] = _interpolated(places[own], part.curve_x, part.curve_y)
                if edge == "null":
                    out[own][(places[own] < part.curve_x[0]) | (places[own] > part.curve_x[-1])] = np.nan
        out[np.isnan(places)] = np.nan
        return out

    def shifted(self, shifts: np.ndarray) -> np.ndarray:
        return self.place[:, None] + shifts

    def around(self, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the bounds of the rows at most ``half`` away in its part."""
        at = np.arange(len(self))
        return np.maximum(at - half, self.first), np.minimum(at + half + 1, self.last)

    def centred(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values less their part's mean, and the means, in extended precision: differences of running sums keep their digits."""
        sizes = np.diff(self.start, append=len(self)).astype(float)
        wide = values.astype(np.longdouble)
        means = np.add.reduceat(wide, self.start, axis=0) / (sizes if values.ndim == 1 else sizes[:, None])
        means = np.take(means, np.searchsorted(self.start, self.first), axis=0)
        return wide - means, means.astype(float)


def _running(values: np.ndarray) -> np.ndarray:
    """Running sums in extended precision: a window may vary by a billionth of what its sums hold."""
    out = np.zeros((len(values) + 1, *values.shape[1:]), np.longdouble)
    np.cumsum(values, axis=0, out=out[1:])
    return out


def rolling_correlations(block: Block, values: np.ndarray, halves: Sequence[int], epsilon: float | None) -> list[np.ndarray]:
    """Per window a matrix rows × lags of correlations of the rows' values with ``values``, some lags at a time.

    Fewer than three rows, or a side without spread beyond rounding, give 0.
    """
    values = np.where(np.isnan(values), 0.0, values)  # a part without curve must not reach the sums of the parts after it
    xc, shift = block.centred(block.x)
    sums_x, sums_xx = _running(xc), _running(xc * xc)
    windows = []
    for half in halves:
        low, high = block.around(half)
        count = (high - low).astype(float)
        wide, sxx = sums_x[high] - sums_x[low], sums_xx[high] - sums_xx[low]
        vx, sx = (sxx - wide * wide / count).astype(float), wide.astype(float)
        varied = (count >= 3) & (vx > 1e-9 * (sxx.astype(float) + 2 * shift * sx + count * shift * shift))
        windows.append((low, high, count[:, None], wide[:, None] / count[:, None], np.maximum(vx, 0.0)[:, None], varied[:, None]))
    out = [np.empty(values.shape) for _ in halves]
    for first in range(0, values.shape[1], LAGS):
        own = slice(first, first + LAGS)
        yc, middle = block.centred(values[:, own])
        sums_y, sums_yy, sums_xy = _running(yc), _running(yc * yc), _running(xc[:, None] * yc)
        for result, (low, high, count, mean_x, vx, varied) in zip(out, windows, strict=True):
            sy, syy, sxy = (np.take(v, high, axis=0) - np.take(v, low, axis=0) for v in (sums_y, sums_yy, sums_xy))
            vy, syy = (syy - sy * sy / count).astype(float), syy.astype(float)
            covariance = (sxy - mean_x * sy).astype(float)
            sy = sy.astype(float)
            usable = varied & (vy > 1e-9 * (syy + middle * (2 * sy + count * middle)))
            scale = np.sqrt(vx * np.maximum(vy, 0.0))
            with np.errstate(invalid="ignore", divide="ignore"):
                if epsilon is None:
                    found = np.where(usable & (scale > 1e-8), covariance / scale, 0.0)
                else:
                    found = np.where(usable, covariance / (scale + epsilon), 0.0)
            result[:, own] = np.nan_to_num(found)
    return out


def per_part(
    fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]],
) -> Callable[[Block], dict[str, np.ndarray]]:
    """A reduction of one part at a time: values, places, and the curve's places and values."""

    def run(block: Block) -> dict[str, np.ndarray]:
        found = [fn(p.x[low:high], p.place[low:high], p.curve_x, p.curve_y) for p, (low, high) in zip(block.parts, block.spans, strict=True)]
        return {name: np.concatenate([f[name] for f in found]) for name in found[0]}

    return run


def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the values of a list column; a null list is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def field(values: pa.StructArray, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False).astype(float)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def scan_chunks(
    df: DataFrame,
    ref: DataFrame,
    keys: Sequence[str],
    ref_keys: Sequence[str],
    columns: tuple[str, str, str, str],
    halo: int,
    reduce: Callable[[Block], dict[str, np.ndarray]],
    result: str,
    row: str = ROW,
    prepare: Callable[[Part], None] = Part.fill,
    others: Sequence[str] = (),
    null_keys: bool = False,
) -> DataFrame:
    """Run ``reduce`` on blocks of prepared series or chunks; one result row per row of the series.

    ``columns`` names the value, its place on the curve, and the curve's place and value; ``result`` is the schema
    of what ``reduce`` returns. A series has one curve. ``prepare`` sees whole series where ``one_chunk`` holds; ``others``
    are further columns that the blocks carry. ``reduce`` may return Arrow arrays for results that are no numbers.
    ``null_keys``: series of an unknown curve have the curve without a name, as in the look-ups over Spark windows.
    """
    value, place, ref_x, ref_y = columns
    keys, ref_keys = list(keys), list(ref_keys)
    kinds = dict(df.dtypes)
    every = list(dict.fromkeys([*keys, *ref_keys]))
    rows = df.select(*dict.fromkeys([*every, row, value, place, *others]))
    whole = one_chunk(df, row)
    if whole:
        dealt = rows.withColumns({_AT: F.lit(0).cast("long"), _CHUNK: F.lit(0).cast("long")})
    else:
        size = F.lit(SCAN_ROWS)
        placed = with_place(rows, keys, _AT, row)
        first = F.greatest(F.floor((F.col(_AT) - halo) / size), F.lit(0))
        dealt = placed.withColumn(_CHUNK, F.explode(F.sequence(first, F.floor((F.col(_AT) + halo) / size))))
    more = [F.col(c).cast("double").alias(f"o_{c}") for c in others]
    curves = ref.where(F.col(ref_x).isNotNull())
    curves = curves if null_keys else curves.dropna(subset=ref_keys)
    # The fewer the curves, the more parts their series are dealt to; each part gets a copy of its curve.
    tasks = DEALS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(-(-tasks // max(curves.select(*ref_keys).distinct().count(), 1)), 1)
    every_deal = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))
    points = curves.select(*ref_keys, every_deal.alias(_DEAL), F.lit(0).alias(_KIND), F.col(ref_x).cast("double").alias("_x"), F.col(ref_y).cast("double").alias("_p"))
    entries = dealt.select(
        *every, F.pmod(F.xxhash64(*keys, _CHUNK), F.lit(deals)).alias(_DEAL), F.lit(1).alias(_KIND), _CHUNK, F.col(row).alias("_row"), _AT,
        F.col(value).cast("double").alias("_x"), F.col(place).cast("double").alias("_p"), *more,
    )
    group = [*ref_keys, _DEAL]
    piece = [*group, _KIND, *[k for k in keys if k not in ref_keys], _CHUNK]
    merged = points.unionByName(entries, allowMissingColumns=True).repartition(*group)
    joined = merged.sortWithinPartitions(*piece, "_row", _AT, "_x", "_p", *[f"o_{c}" for c in others])
    names = [c.strip().split(" ")[0].strip("`") for c in result.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        curve_x = curve_y = np.empty(0)
        middle = np.nan
        for batch, begins in whole_runs(batches, piece):
            fresh = starts(batch, group, before)
            before = batch.slice(batch.num_rows - 1)
            numbers = batch.column("_row")
            at, kind, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in (_AT, _KIND, _CHUNK))
            carried = {c: _floats(batch, f"o_{c}") for c in others}
            x, p = _floats(batch, "_x"), _floats(batch, "_p")
            waiting: list[tuple[Part, np.ndarray, int, int]] = []
            inner: list[np.ndarray] = []  # rows of the batch that come out, per waiting part, and where they are in the block
            kept: list[np.ndarray] = []
            held = 0

            def flush() -> pa.RecordBatch:
                found = reduce(Block(waiting))
                where, own = np.concatenate(kept), pa.array(np.concatenate(inner))
                columns = [batch.column(k).take(own) for k in keys] + [numbers.take(own)]
                for n in names:
                    given = found[n]
                    columns.append(given.take(pa.array(where)) if isinstance(given, pa.Array) else pa.array(given[where], from_pandas=True))
                for each in (waiting, inner, kept):
                    each.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*keys, row, *names])

            row_of = numbers.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(begins)
            for a, b in zip(first, [*first[1:], batch.num_rows], strict=True):
                if fresh[a]:
                    curve_x = curve_y = np.empty(0)
                    middle = np.nan
                if kind[a] == 0:
                    curve_x, curve_y = x[a:b].copy(), p[a:b].copy()
                    middle = 0.5 * curve_x[(b - a - 1) // 2] + 0.5 * curve_x[(b - a) // 2]
                    continue
                part = Part(x[a:b].copy(), p[a:b].copy(), curve_x, curve_y, middle, whole, {n: v[a:b] for n, v in carried.items()})
                prepare(part)
                own = np.arange(b - a) if whole else np.flatnonzero(at[a:b] // SCAN_ROWS == chunk[a])
                for start in range(0, len(own), BLOCK):
                    mine = own[start : start + BLOCK]
                    low, high = max(mine[0] - halo, 0), min(mine[-1] + halo + 1, b - a)
                    waiting.append((part, row_of[a:b], low, high))
                    inner.append(a + mine)
                    kept.append(held + mine - low)
                    held += high - low
                    if held >= BLOCK:
                        yield flush()
                        held = 0
            if waiting:
                yield flush()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, row])
    return joined.mapInArrow(run, f"{schema}, {result}")
