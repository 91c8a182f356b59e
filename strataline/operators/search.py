"""Weight searches on the small matrix of product sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from strataline.functions.gram import Gram


def single_errors(gram: Gram) -> np.ndarray:
    """RMSE of every model alone."""
    square = np.diag(gram.xx) - 2 * gram.xy + gram.sums[-2, -2]
    return np.sqrt(np.maximum(square / gram.rows, 0.0))


def greedy_average(gram: Gram, gain: float = 1e-5) -> tuple[list[float], float]:
    """Start with the best model; keep adding a copy of the first model that lowers the error of the plain average.

    All additions are scored at once from the product sums. Every addition gains at least ``gain``, so it ends.
    """
    alone = single_errors(gram)
    best = float(alone.min())
    counts = gram.single(int(alone.argmin()))
    while True:
        size = counts.sum() + 1
        square = counts @ gram.xx @ counts + 2 * gram.xx @ counts + np.diag(gram.xx)
        mse = square / size**2 - 2 * (counts @ gram.xy + gram.xy) / size + gram.sums[-2, -2]
        better = np.flatnonzero(np.sqrt(np.maximum(mse / gram.rows, 0.0)) < best - gain)
        if not len(better):
            return [float(c) for c in counts / counts.sum()], best
        counts = counts + gram.single(int(better[0]))
        best = gram.rmse(counts / counts.sum())


def transfer_climb(gram: Gram, step: float = 0.01, negative: bool = False) -> tuple[list[float], float]:
    """Move one step of weight from one model to another, the best move each round, while the error falls by 1e-9 or more."""
    m = len(gram.names)
    weights = gram.single(min(range(m), key=lambda i: gram.rmse(gram.single(i)))).copy()
    best = gram.rmse(weights)
    while True:
        moves = []
        for i in range(m):
            if weights[i] < step - 1e-12 and not negative:
                continue
            for j in range(m):
                if i != j and (negative or weights[j] + step <= 1 + 1e-12):
                    trial = weights + step * (gram.single(j) - gram.single(i))
                    moves.append((gram.rmse(trial), i, j))
        if not moves or min(moves)[0] >= best - 1e-9:
            break
        best, i, j = min(moves)
        weights = weights + step * (gram.single(j) - gram.single(i))
    return [float(w) for w in weights], best


def greedy_convex(gram: Gram, grid: Sequence[float], gain: float = 1e-7) -> tuple[list[float], float]:
    """Start with the best model; each round mix in one unused model at the best grid weight."""
    m = len(gram.names)
    start = min(range(m), key=lambda i: gram.rmse(gram.single(i)))
    weights, best, left = gram.single(start).copy(), gram.rmse(gram.single(start)), set(range(m)) - {start}
    while left:
        trials = [(gram.rmse((1 - w) * weights + w * gram.single(i)), i, w) for i in sorted(left) for w in grid]
        score, i, w = min(trials)
        if score >= best - gain:
            break
        weights, best = (1 - w) * weights + w * gram.single(i), score
        left.remove(i)
    return [float(w) for w in weights], best


def best_three(gram: Gram) -> list[int]:
    return sorted(range(len(gram.names)), key=lambda i: gram.rmse(gram.single(i)))[:3]


def simplex_search(gram: Gram, step: float) -> tuple[list[float], float]:
    """Best convex weights of the three best models on a grid."""
    top, count = best_three(gram), round(1 / step)
    best: tuple[float, list[float]] | None = None
    for i in range(count + 1):
        for j in range(count + 1 - i):
            weights = np.zeros(len(gram.names))
            for place, share in zip(top, (i, j, count - i - j)):
                weights[place] += share / count
            score = gram.rmse(weights)
            if best is None or score < best[0]:
                best = (score, [float(w) for w in weights])
    return best[1], best[0]


def projected_descent(a: np.ndarray, b: np.ndarray, project, start: np.ndarray, limit: int = 200_000) -> np.ndarray:
    """Minimise ½ wᵀAw − bᵀw over a convex set, until a projected step no longer moves (accelerated steps).

    An error if that takes more than ``limit`` steps.
    """
    size = float(np.linalg.eigvalsh(a)[-1]) or 1.0
    w = project(start)
    ahead, t = w.copy(), 1.0
    for _ in range(limit):
        new = project(ahead - (a @ ahead - b) / size)
        if float((new - w) @ (ahead - new)) > 0:  # overshooting: restart the acceleration
            t = 1.0
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_next * (new - w)
        residual = np.abs(new - project(new - (a @ new - b) / size)).max()
        w, t = new, t_next
        if residual <= 1e-12 * max(1.0, np.abs(w).max()):
            return w
    raise ArithmeticError(f"no minimum after {limit} steps")


def non_negative(w: np.ndarray) -> np.ndarray:
    return np.maximum(w, 0.0)


def onto_simplex(w: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative entries that sum to 1."""
    ordered = np.sort(w)[::-1]
    shift = (np.cumsum(ordered) - 1) / np.arange(1, len(w) + 1)
    last = np.nonzero(ordered - shift > 0)[0][-1]
    return np.maximum(w - shift[last], 0.0)


def nnls(gram: Gram, intercept: bool = False, ridge: float = 0.0) -> tuple[list[float], float]:
    """Non-negative least squares (the intercept too, if wanted), optionally with a ridge on the weights."""
    m = len(gram.names)
    if intercept:
        keep = [*range(m), m + 1]
        a, b = gram.sums[np.ix_(keep, keep)].copy(), gram.sums[keep, m]
    else:
        a, b = gram.xx.copy(), gram.xy
    a[:m, :m] += ridge * np.eye(m)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    w = projected_descent(a / np.outer(scale, scale), b / scale, non_negative, np.zeros(len(b))) / scale
    return [float(v) for v in w[:m]], float(w[m]) if intercept else 0.0


def ridge_positive(gram: Gram, alpha: float) -> tuple[list[float], float]:
    """Non-negative ridge weights with a free, unpenalised intercept."""
    m, n = len(gram.names), gram.rows
    mean_x, mean_y = gram.sums[:m, m + 1] / n, gram.sums[m, m + 1] / n
    a = gram.xx - n * np.outer(mean_x, mean_x) + alpha * np.eye(m)
    b = gram.xy - n * mean_x * mean_y
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    w = projected_descent(a / np.outer(scale, scale), b / scale, non_negative, np.zeros(m)) / scale
    return [float(v) for v in w], float(mean_y - mean_x @ w)


def convex(gram: Gram, pull: float) -> list[float]:
    """Convex weights minimising MSE + pull·‖w − equal‖²."""
    m = len(gram.names)
    a = 2 * gram.xx / gram.rows + 2 * pull * np.eye(m)
    b = 2 * gram.xy / gram.rows + 2 * pull * np.full(m, 1.0 / m)
    return [float(v) for v in projected_descent(a, b, onto_simplex, np.full(m, 1.0 / m))]
