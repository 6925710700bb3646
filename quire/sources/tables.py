"""Readers.  Parquet carries its schema; text formats always get an explicit one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from .. import schemas as S
from ..functions.sections import extract_section
from ..functions.text import head

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def _head(text, chars: int | None):
    return head(text, chars) if chars else text


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table ``<root>/<name>.parquet`` (column pruning and filters push down)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def read_entities(spark: SparkSession, path: str, schema=S.ENTITY_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Labelled entity CSV with header.  ``ord`` orders the rows: by file, then by
    place in the file, so that "the first row of a repeated name wins" is defined.
    Files split into many tasks unless quoted values hold line breaks
    (``multi_line``)."""
    df = (spark.read.schema(schema).option("header", True).option("quote", '"')
          .option("escape", '"').option("multiLine", multi_line).csv(path))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.col(c) for c in schema.fieldNames()], place.alias("ord"))


def read_feature_matrix(spark: SparkSession, path: str, classes=None, regions=None) -> DataFrame:
    """Feature matrix CSV with the schema generated from dictionary and domain."""
    return (spark.read.schema(S.feature_schema(classes, regions)).option("header", True)
            .option("escape", '"').csv(path))


def read_articles(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Articles as JSON lines with their ``cache_key``, the join key to entities;
    missing keys read as ''.  ``one_per_file`` reads one object per file, whose
    name is the key."""
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in S.ARTICLE_SCHEMA.fieldNames()]
    if one_per_file:
        df = spark.read.schema(S.ARTICLE_SCHEMA).option("multiLine", True).json(path)
        return df.select(*fields, F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("cache_key"))
    schema = T.StructType([*S.ARTICLE_SCHEMA.fields, T.StructField("cache_key", T.StringType())])
    return spark.read.schema(schema).json(path).select(*fields, "cache_key")


def cache_key(name, version: str = C.CACHE_VERSION):
    """Content-addressed article key: ``<version>_`` + md5(lower(name)) + ``.json``."""
    n = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit(f"{version}_"), F.md5(F.lower(n)), F.lit(".json"))


def unpack_envelope(df: DataFrame, body_col: str = "body",
                    full_text_chars: int | None = None) -> DataFrame:
    """API envelope → article columns.  No pages or a ``missing`` first page → an
    empty article (``is_empty_article``); otherwise the first revision's main slot
    gives the sections and the ``full_text`` (its head with ``full_text_chars``)."""
    env = F.from_json(F.col(body_col), S.ENVELOPE_SCHEMA)
    first = F.get(env["query"]["pages"], 0)
    content = F.get(first["revisions"], 0)["slots"]["main"]["content"]
    empty = first.isNull() | F.coalesce(first["missing"], F.lit(False))
    text = F.when(empty, F.lit(None).cast("string")).otherwise(F.coalesce(content, F.lit("")))
    keep = [c for c in df.columns if c != body_col]

    def sec(name):
        return F.when(F.col("_wikitext").isNull(), F.lit("")).otherwise(
            extract_section(F.col("_wikitext"), name))

    return df.withColumn("_wikitext", text).select(
        *keep,
        sec("Understand").alias("understand"),
        sec("Do").alias("do"),
        sec("Sleep").alias("sleep"),
        F.coalesce(_head(F.col("_wikitext"), full_text_chars), F.lit("")).alias("full_text"),
        F.col("_wikitext").isNull().alias("is_empty_article"),
    )


def wikitext_to_article(df: DataFrame, text_col: str = "wikitext",
                        full_text_chars: int | None = None) -> DataFrame:
    """Section extraction over a column of raw wiki markup."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        *[c for c in df.columns if c != text_col],
        extract_section(t, "Understand").alias("understand"),
        extract_section(t, "Do").alias("do"),
        extract_section(t, "Sleep").alias("sleep"),
        _head(t, full_text_chars).alias("full_text"),
    )
