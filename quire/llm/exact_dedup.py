"""Exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text
``(digest, keep_id)``.  A batch of new documents is reduced to its own distinct
digests (partial aggregate, so a group of copies of any size moves as one row
per map task), anti-joined with the index by sort-merge on the common buckets
(the index side is not shuffled) and the survivors are appended.

Texts are equal when identical after lower-casing A-Z only; a null text counts
as empty.  Within a batch the row with the largest id stays (null ids come
last; of rows that repeat id and text one stays); a text that an earlier batch
brought keeps the earlier row.  Empty batches and tables give no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of each normalised whole text, 32 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


class DigestIndex:
    """Handle on one index table of the session catalog; ``buckets`` is fixed
    when the table is created (default: the session's shuffle partitions)."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            empty = spark.createDataFrame([], "digest binary, keep_id long")
            self._write(empty, "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        (df.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, hashed: DataFrame) -> None:
        """Adds the digests of ``(doc_id, digest)`` rows that the index lacks."""
        batch = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        # the aggregate's exchange has the index's buckets, so neither side moves again
        batch = batch.repartition(self.buckets, "digest")
        fresh = batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.select("digest", "keep_id"), "append")


def resolve(hashed: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row's decision: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Rows are counted per (digest, id) first; counts per digest meet the index on
    its buckets and are written once.  The join back is between two plain
    exchanges, which adaptive execution splits where one digest is hot."""
    each = cut(hashed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    groups = each.groupBy("digest").agg(F.sum("n").alias("group_size"))
    groups = cut(groups.join(index.read().hint("merge"), "digest")
                 .select(F.col("digest").alias("g_digest"), "keep_id", "group_size"))
    rows = each.join(groups.hint("merge"), F.col("digest") == F.col("g_digest"))
    return (rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def survivors(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay when it is deduplicated as one
    batch against a new index.  Rows meet their decision on id and digest
    together, so a group of copies is spread over the tasks."""
    index = index or DigestIndex(docs.sparkSession)
    index.append_new(cut(digests(docs)))
    names = {c.lower() for c in docs.columns}
    digest, key, nth = (next(f"{c}{'_' * k}" for k in range(len(names) + 1) if f"{c}{'_' * k}" not in names)
                        for c in ("digest", "row_key", "nth_row"))
    kept = index.read().select(F.col("digest").alias(digest), F.xxhash64("keep_id", "digest").alias(key))
    rows = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    rows = rows.withColumn(key, F.xxhash64("doc_id", digest)).join(cut(kept), [key, digest], "left_semi")
    same = Window.partitionBy(key, digest).orderBy(key)          # exact repeats of a row
    rows = rows.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Whole-table result through a fresh index, fed in two batches: the upper
    half of the id range first, so that the row with the largest id stays."""
    hashed = cut(digests(docs))
    index = DigestIndex(docs.sparkSession)
    lo, hi = hashed.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if lo is None else (lo + hi) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.append_new(hashed.filter(upper))
    index.append_new(hashed.filter(~upper))
    return resolve(hashed, index)
