"""Row-wise statistics over several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions.columns import array_mean, array_std


def spread_columns(cols: Sequence[str], prefix: str) -> dict[str, Column]:
    """Mean, population std, min, max and range of the columns in each row."""
    every = F.array(*[F.col(c).cast("double") for c in cols])
    return {
        f"{prefix}_mean": array_mean(every),
        f"{prefix}_std": array_std(every),
        f"{prefix}_min": F.array_min(every),
        f"{prefix}_max": F.array_max(every),
        f"{prefix}_range": F.array_max(every) - F.array_min(every),
    }
