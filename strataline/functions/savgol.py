"""Coefficients of polynomial smoothing windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=256)
def projection(window: int, order: int) -> np.ndarray:
    """Matrix P so that ``P @ values`` is the fitted polynomial at each place of the window."""
    places = np.arange(window, dtype=float) - (window - 1) / 2
    basis, _ = np.linalg.qr(np.vander(places / max(window / 2, 1.0), order + 1))
    return basis @ basis.T


def centre_row(window: int, order: int) -> list[float]:
    """Weights of the window's middle value: the interior smoothing kernel."""
    return [float(v) for v in projection(window, order)[window // 2]]


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return [float(v) for v in weights / weights.sum()]
