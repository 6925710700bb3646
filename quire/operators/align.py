"""Column alignment to a model's expected input list."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def align_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = (),
                  fill: float = 0.0) -> DataFrame:
    """Keep ``keep``, then exactly ``expected`` in order: present columns cast to
    double, missing ones filled with ``fill``; extra columns dropped."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(float(fill))).alias(c)
                              for c in expected])


def drop_key_label(df: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(X, y): features without key/label, and the label with its key."""
    return df.drop(key, label), df.select(key, label)
