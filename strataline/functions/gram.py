"""Product sums of prediction columns and target: everything a linear blend's error needs.

The sums are one distributed aggregate; only the (columns + 2)² numbers per group reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values of a fold column; each brings (columns + 2)² numbers to the driver.
MOST_FOLDS = 1_000


def gram_sums(df: DataFrame, cols: Sequence[str], y: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Sums of products of the columns, the target and a constant 1; names ``s_<i>_<j>``, i ≤ j.

    Only rows count of which all columns, the target and the weight are known.
    """
    terms = [*[F.col(c).cast("double") for c in cols], F.col(y).cast("double"), F.lit(1.0)]
    known = reduce(lambda a, b: a & b, [t.isNotNull() for t in terms[:-1]])
    w = F.when(known, F.lit(1.0) if weight is None else weight)
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"s_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    return df.groupBy(*by).agg(*sums) if by else df.agg(*sums)


@dataclass(frozen=True)
class Gram:
    names: tuple[str, ...]
    sums: np.ndarray  # columns, target, constant

    @classmethod
    def of(cls, names: Sequence[str], row) -> Gram:
        size = len(names) + 2
        matrix = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                matrix[i, j] = matrix[j, i] = row[f"s_{i}_{j}"] or 0.0
        return cls(tuple(names), matrix)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.names, self.sums - other.sums)

    @property
    def rows(self) -> float:
        return float(self.sums[-1, -1])

    @property
    def xx(self) -> np.ndarray:
        return self.sums[:-2, :-2]

    @property
    def xy(self) -> np.ndarray:
        return self.sums[:-2, -2]

    def mse(self, weights: Sequence[float], intercept: float = 0.0) -> float:
        v = np.concatenate([np.asarray(weights, float), [-1.0, intercept]])
        return max(float(v @ self.sums @ v) / self.rows, 0.0)

    def rmse(self, weights: Sequence[float], intercept: float = 0.0) -> float:
        return self.mse(weights, intercept) ** 0.5

    def single(self, i: int) -> np.ndarray:
        return np.eye(len(self.names))[i]


def gram(df: DataFrame, cols: Sequence[str], y: str, weight: Column | None = None) -> Gram:
    return Gram.of(cols, gram_sums(df, cols, y, weight=weight).first())


def gram_by(df: DataFrame, cols: Sequence[str], y: str, by: str, weight: Column | None = None) -> dict[object, Gram]:
    """One Gram per value of a fold column; more than ``MOST_FOLDS`` values are an error."""
    rows = gram_sums(df, cols, y, [by], weight).limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"{by} has more than {MOST_FOLDS} values")
    return {row[by]: Gram.of(cols, row) for row in rows}
