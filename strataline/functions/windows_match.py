"""The window of one stretch of values that correlates most with each window of another, without arrays of windows.

The product sum of two windows differs from that of their neighbours one step on by two products. Along a diagonal
(both windows moved together) all product sums are therefore differences of one running sum, so the work is one
product per pair of positions, whatever the window's length.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided, sliding_window_view

ROWS, COLUMNS = 128, 4_096


def sliding_products(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Product sums of every window of ``a`` with every window of ``b``: running sums along the diagonals."""
    rows, columns = len(a) - size + 1, len(b) - size + 1
    # Cell (i, d) of the products belongs to a[i] and b[i + d - (rows - 1)]; a column is a diagonal.
    width = columns + rows - 1
    padded = np.concatenate([np.zeros(rows - 1), b, np.zeros(rows - 1)])
    step = padded.strides[0]
    running = np.zeros((len(a) + 1, width))
    np.cumsum(a[:, None] * as_strided(padded, (len(a), width), (step, step)), axis=0, out=running[1:])
    sums = running[size:] - running[:-size]
    down, right = sums.strides
    return as_strided(sums[:, rows - 1 :], (rows, columns), (down - right, right))


def _moments(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    windows = sliding_window_view(values, size)
    return windows.mean(axis=1), windows.std(axis=1)


def best_windows(a: np.ndarray, b: np.ndarray, size: int, starts: np.ndarray, epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Per window of ``a`` the index into ``starts`` (windows of ``b``) of the best correlation, and that correlation.

    Deviations count as ``std + epsilon``; equal correlations, to nine decimals, take the first; windows without spread have 0.
    """
    n = len(a) - size + 1
    best, score = np.zeros(n, np.int64), np.full(n, -np.inf)
    if not len(starts):
        return best, score
    shift = b.mean()
    a, b = a - shift, b - shift
    mean_a, std_a = _moments(a, size)
    mean_b, std_b = (v[starts] for v in _moments(b, size))
    flat = 1e-10 * max(np.abs(a).max(), np.abs(b).max(), 1.0)
    weight_a, weight_b = (np.where(s > flat, 1 / (s + epsilon), 0.0) for s in (std_a, std_b))
    for top in range(0, n, ROWS):
        here = slice(top, min(top + ROWS, n))
        for first in range(0, len(starts), COLUMNS):
            some = slice(first, first + COLUMNS)
            left, right = starts[some][0], starts[some][-1] + size
            sums = sliding_products(a[here.start : here.stop + size - 1], b[left:right], size)[:, starts[some] - left]
            found = (sums / size - np.outer(mean_a[here], mean_b[some])) * np.outer(weight_a[here], weight_b[some])
            at = np.argmax(np.round(found, 9), axis=1)
            value = found[np.arange(len(at)), at]
            better = np.round(value, 9) > np.round(score[here], 9)
            best[here] = np.where(better, first + at, best[here])
            score[here] = np.where(better, value, score[here])
    return best, score
