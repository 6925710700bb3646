"""Small helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after the row count is checked against ``max_rows``
    (the side is persisted so the count is not recomputed); larger sides go
    through a regular shuffle join, where AQE splits skewed partitions."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= max_rows else df


MAX_CLASSES = 100_000


def require_unique(df: DataFrame, key) -> None:
    """Raises when a key occurs more than once (one aggregate action)."""
    keys = [key] if isinstance(key, str) else list(key)
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"key {keys} is not unique")
