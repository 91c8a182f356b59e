"""Sorted rows of two kinds as they stream through a task: a group's shared rows first, then the rows that need them.

A join would repeat what a group shares in every row of the group; here it arrives once per group and stays while the
group's rows pass by, in Arrow batches of few rows each. Nothing but the shared rows of one group is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, names: Sequence[str], before: pa.RecordBatch | None = None) -> np.ndarray:
    """Per row whether one of the columns differs from the row before (``before``: that of the first row)."""
    out = np.zeros(batch.num_rows, bool)
    if not len(out):
        return out
    out[0] = before is None
    first = 1 if before is None else 0
    for name in names:
        column = batch.column(name)
        if before is not None:
            column = pa.concat_arrays([before.column(name), column])
        if pa.types.is_floating(column.type):
            column = column.cast(pa.string())  # not-a-number is one value
        here, prior = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(here, prior), False).to_numpy(zero_copy_only=False)
        nulls = pc.xor(here.is_null(), prior.is_null()).to_numpy(zero_copy_only=False)
        out[first:] |= differ | nulls
    return out


def joined(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    arrays = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=batches[0].schema)


def whole_runs(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut where a run of equal ``names`` ends, and per row whether a run begins there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(starts(batch, names, held[-1].slice(held[-1].num_rows - 1) if held else None))
        if len(begins) and (held or begins[-1]):
            ready = joined([*held, batch.slice(0, begins[-1])]) if begins[-1] else joined(held)
            yield ready, starts(ready, names)
            held = [batch.slice(begins[-1])]
        else:
            held.append(batch)
    if held:
        ready = joined(held)
        yield ready, starts(ready, names)


def by_group(batches: Iterator[pa.RecordBatch], group: Sequence[str], kind: str) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """Shared rows (``kind`` 0) of a group, and a piece of its other rows; a group has as many pieces as batches hold it."""
    shared: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = starts(batch, group, last)
        cut = np.flatnonzero(new | starts(batch, [kind], last))
        ends = [*(cut if len(cut) and cut[0] == 0 else [0, *cut]), batch.num_rows]
        kinds = batch.column(kind).to_numpy(zero_copy_only=False)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if new[a]:
                shared = []
            if kinds[a] == 0:
                shared.append(batch.slice(a, b - a))
            else:
                if len(shared) > 1:
                    shared = [joined(shared)]
                yield shared, batch.slice(a, b - a)
        last = batch.slice(batch.num_rows - 1)
