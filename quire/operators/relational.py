"""Lookups, progress skipping and keyed pairing, stated as joins."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .util import require_unique


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def pending(entities: DataFrame, done: DataFrame, key) -> DataFrame:
    """Entities not yet processed (left anti join on the key)."""
    k = _keys(key)
    return entities.join(done.select(*k), k, "left_anti")


def with_articles(entities: DataFrame, articles: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """(entities joined to their article, entities with no article — the skip list)."""
    k = _keys(key)
    return entities.join(articles, k, "inner"), entities.join(articles.select(*k), k, "left_anti")


def lookup_with_default(left: DataFrame, right: DataFrame, key, defaults: Mapping[str, object]) -> DataFrame:
    """Left outer lookup; a missing match reads as the given default per column."""
    k = _keys(key)
    cols = [c for c in right.columns if c not in k]
    joined = left.join(right, k, "left")
    return joined.select(*[c for c in joined.columns if c not in cols],
                         *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                           for c in cols])


def keyed_concat(left: DataFrame, right: DataFrame, key, check_unique: bool = True) -> DataFrame:
    """Column-wise concatenation of two tables by key (what a positional
    ``concat(axis=1)`` means once rows carry explicit keys).  The key must be
    unique on both sides; a key of one side only keeps its row, with nulls."""
    k = _keys(key)
    if check_unique:
        require_unique(left, k)
        require_unique(right, k)
    return left.join(right, k, "full")


def first_per_key(df: DataFrame, key, order_col: str, latest: bool = False) -> DataFrame:
    """First row (smallest ``order_col``; with ``latest`` the largest) of every key.  A ``min`` over a struct
    led by the order column is a plain aggregate, so partial aggregation keeps a
    hot key from landing whole in one task."""
    k = _keys(key)
    rest = [c for c in df.columns if c not in k]
    packed = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in rest])
    return df.groupBy(*k).agg((F.max if latest else F.min)(packed).alias("_r")).select(*k, *[F.col(f"_r.{c}").alias(c) for c in rest])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose foreign key has no parent (referential check)."""
    return child.join(parent.select(F.col(parent_key).alias("_pk")),
                      F.col(child_key) == F.col("_pk"), "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                parent_cols: Sequence[str]) -> DataFrame:
    """Child rows with parent attributes (left join: orphans kept with nulls)."""
    p = parent.select(F.col(parent_key).alias("_pk"), *parent_cols)
    return child.join(p, F.col(child_key) == F.col("_pk"), "left").drop("_pk")
