"""Stratified train/test split and stratified folds, deterministic and skew-safe.

Rows are ordered inside their class by ``md5(key || ':' || seed)`` (then key).
The rank of a row in that order is computed without putting a whole class in one
task: rows are bucketed by the first hex digits of the hash, a per-(class,
bucket) histogram gives the rows before each bucket, and a window over
(class, bucket) ranks rows inside a bucket.  A hot class is thus spread over up
to 16**bucket_chars tasks; the result equals a single window over the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from .util import MAX_CLASSES, broadcast_if_small


def hash_order(key: str, seed: int = C.RANDOM_SEED):
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def join_by_class(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls are equal, so rows with a null class stay."""
    right = table.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [rows[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return rows.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def _ranked(df: DataFrame, label: str, key: str, seed: int, bucket_chars: int, out_col: str):
    h = hash_order(key, seed)
    tagged = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, bucket_chars))
    # (class, bucket) histogram: at most classes × 16**bucket_chars rows, pre-aggregated map-side
    hist = tagged.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n")).persist()
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = hist.select(label, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(label, "_b").orderBy("_h", key)
    ranked = (join_by_class(tagged, before, [label, "_b"])
              .withColumn(out_col, (F.col("_before") + F.row_number().over(inner)).cast("long"))
              .drop("_h", "_b", "_before"))
    counts = hist.groupBy(label).agg(F.sum("_n").alias("n_c"))
    return ranked, counts


def stratified_rank(df: DataFrame, label: str, key: str, seed: int = C.RANDOM_SEED,
                    bucket_chars: int = 3, out_col: str = "class_rank") -> DataFrame:
    """Adds the 1-based rank of each row inside its class (hash order)."""
    return _ranked(df, label, key, seed, bucket_chars, out_col)[0]


def class_quotas(df: DataFrame, label: str, test_size: float = C.TEST_SIZE,
                 counts: DataFrame | None = None) -> DataFrame:
    """Per class: size ``n_c`` and test quota.  Total test = ceil(test_size·N);
    each class gets floor(total·n_c/N), the rest go one each to the largest
    remainders (ties by label).  ``counts`` (label, n_c) may be given."""
    if counts is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()  # over the class table only: one row per class
    n = F.sum("n_c").over(allw)
    n_test = F.ceil(F.lit(test_size) * n)
    q = counts.withColumn("_n", n).withColumn("_t", n_test)
    q = q.withColumn("_cont", F.col("_t") * F.col("n_c") / F.col("_n"))
    q = q.withColumn("_floor", F.floor("_cont")).withColumn("_rem", F.round(F.col("_cont") - F.col("_floor"), 9))
    left = F.col("_t") - F.sum("_floor").over(allw)
    q = q.withColumn("_left", left)
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(label))
    q = q.withColumn("_pos", F.row_number().over(order))
    return q.select(label, "n_c", (F.col("_floor") + (F.col("_pos") <= F.col("_left")).cast("long"))
                    .cast("long").alias("n_test"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = C.TEST_SIZE,
                     seed: int = C.RANDOM_SEED, bucket_chars: int = 3) -> DataFrame:
    """Adds ``split`` ('train' / 'test') and ``class_rank``.  The test rows of a
    class are the first ``n_test`` in hash order."""
    ranked, counts = _ranked(df, label, key, seed, bucket_chars, "class_rank")
    # one row per class: broadcast after its size is checked, so rows are never
    # shuffled by class (a hot class would otherwise land in one task)
    quotas = broadcast_if_small(class_quotas(df, label, test_size, counts).select(label, "n_test"), MAX_CLASSES)
    return (join_by_class(ranked, quotas, [label])
            .withColumn("split", F.when(F.col("class_rank") <= F.col("n_test"), "test").otherwise("train"))
            .drop("n_test"))


def stratified_folds(train: DataFrame, label: str, key: str, k: int = C.N_FOLDS,
                     seed: int = C.RANDOM_SEED, bucket_chars: int = 3) -> DataFrame:
    """Adds ``fold`` in [0, k): position in the class's hash order plus the rows
    of earlier classes (by label), modulo k — folds stay within one row in size
    and every class is spread evenly."""
    ranked, counts = _ranked(train.drop("class_rank") if "class_rank" in train.columns else train,
                             label, key, seed, bucket_chars, "_r")
    w = Window.partitionBy().orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, F.coalesce(F.sum("n_c").over(w), F.lit(0)).alias("_off"))
    offsets = broadcast_if_small(offsets, MAX_CLASSES)
    return (join_by_class(ranked, offsets, [label])
            .withColumn("fold", F.pmod(F.col("_r") - 1 + F.col("_off"), F.lit(k)).cast("int"))
            .drop("_r", "_off"))


def split_and_folds(df: DataFrame, label: str, key: str, test_size: float = C.TEST_SIZE,
                    k: int = C.N_FOLDS, seed: int = C.RANDOM_SEED, bucket_chars: int = 3) -> DataFrame:
    """Split and train folds from one ranking pass.  Test rows are the first
    ``n_test`` of their class in hash order, so a train row's rank among the
    train rows is ``class_rank - n_test``; fold offsets come from the per-class
    table.  Same result as :func:`stratified_split` then :func:`stratified_folds`
    on the train rows.  Adds ``class_rank``, ``split`` and ``fold`` (-1 on test)."""
    ranked, counts = _ranked(df, label, key, seed, bucket_chars, "class_rank")
    q = class_quotas(df, label, test_size, counts)
    w = Window.partitionBy().orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    per_class = q.select(label, "n_test",
                         F.coalesce(F.sum(F.col("n_c") - F.col("n_test")).over(w), F.lit(0)).alias("_off"))
    per_class = broadcast_if_small(per_class, MAX_CLASSES)
    is_test = F.col("class_rank") <= F.col("n_test")
    fold = F.pmod(F.col("class_rank") - F.col("n_test") - 1 + F.col("_off"), F.lit(k)).cast("int")
    return (join_by_class(ranked, per_class, [label])
            .withColumn("split", F.when(is_test, "test").otherwise("train"))
            .withColumn("fold", F.when(is_test, F.lit(-1)).otherwise(fold))
            .drop("n_test", "_off"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights ``n / (k · n_c)`` (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()
    return counts.select(label, "n_c", (F.sum("n_c").over(allw).cast("double")
                                        / (F.count(F.lit(1)).over(allw) * F.col("n_c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Per-row sample weight from the class-weight table (one row per class)."""
    w = broadcast_if_small(class_weights(df, label).select(label, F.col("weight").alias(weight_col)), MAX_CLASSES)
    return join_by_class(df, w, [label], "left")
