"""Keyword features: per-class hit counts, thresholds, ratios, price tier,
one-hot category columns and the rule classifier.

All columns are Spark expressions over one row (no shuffle).  For dictionaries
kept in a table use :func:`keyword_join`.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.matching import class_hits
from ..functions.text import as_col, keyword_hits
from ..schemas import region_column


def _class_key(name: str) -> str:
    return name.lower()


def keyword_features(df: DataFrame, text_col: str,
                     dictionary: Mapping[str, Sequence[str]] = C.CLASS_KEYWORDS,
                     thresholds: Mapping[str, int] = C.CLASS_THRESHOLDS,
                     method: str = "filter", keep_input: bool = True, whole_words: bool = False) -> DataFrame:
    """Adds ``{c}_keyword_count``, ``{c}_keyword_binary`` (count >= threshold) for
    each class and ``{c}_keyword_ratio`` = count / max(total, 1).

    ``method``: "filter" / "sum" (one scan of the text per keyword, expressions only;
    the default) or "scan" (one pass over each text whatever the dictionary size:
    :mod:`..functions.matching`).  ``whole_words`` (with "scan") wants no letter, digit or
    underscore beside an occurrence."""
    if whole_words and method != "scan":
        raise ValueError("whole words are found by method='scan'")
    classes = list(dictionary)
    base = df.columns if keep_input else []
    low = F.lower(F.coalesce(as_col(text_col), F.lit("")))
    # Counts are computed once in their own projection; binaries and ratios read them.
    lowered = df.withColumn("_low", low)
    if method == "scan":
        lowered = lowered.withColumn("_hits", class_hits(F.col("_low"), dictionary, whole_words)).drop("_low")
        counts = {c: F.get("_hits", i) for i, c in enumerate(classes)}
    else:
        counts = {c: keyword_hits(F.col("_low"), dictionary[c], method) for c in classes}
    counted = lowered.select(*base, *[counts[c].alias(f"{_class_key(c)}_keyword_count") for c in classes])
    return _with_shares(counted, classes, thresholds, base)


def features_from_hits(df: DataFrame, hits_col: str, classes: Sequence[str], thresholds: Mapping[str, int], keep: Sequence[str]) -> DataFrame:
    """The columns of :func:`keyword_features` from an array of hits per class."""
    counted = df.select(*keep, *[F.get(hits_col, i).alias(f"{_class_key(c)}_keyword_count") for i, c in enumerate(classes)])
    return _with_shares(counted, classes, thresholds, keep)


def _with_shares(counted: DataFrame, classes: Sequence[str], thresholds: Mapping[str, int], keep: Sequence[str]) -> DataFrame:
    total = None
    for c in classes:
        term = F.col(f"{_class_key(c)}_keyword_count")
        total = term if total is None else total + term
    total = F.greatest(total, F.lit(1))
    out = []
    for c in classes:
        k = _class_key(c)
        out.append(F.col(f"{k}_keyword_count"))
        out.append((F.col(f"{k}_keyword_count") >= F.lit(int(thresholds.get(c, 1)))).cast("int")
                   .alias(f"{k}_keyword_binary"))
    ratios = [(F.col(f"{_class_key(c)}_keyword_count").cast("double") / total).alias(f"{_class_key(c)}_keyword_ratio")
              for c in classes]
    return counted.select(*keep, *out, *ratios)


def price_tier_expr(text, low_dict: Sequence[str] = C.BUDGET_KEYWORDS,
                    high_dict: Sequence[str] = C.LUXURY_KEYWORDS, method: str = "filter"):
    """Two-dictionary ordinal tier: empty → 2; high > low and high >= 2 → 3;
    low > high and low >= 2 → 1; otherwise 2."""
    t = as_col(text)
    low = F.lower(t)
    return tier_of(t, keyword_hits(low, low_dict, method), keyword_hits(low, high_dict, method))


def tier_of(text, lo, hi):
    """The tier from the hits of the two dictionaries."""
    return (F.when(text.isNull() | (text == ""), F.lit(2))
            .when((hi > lo) & (hi >= 2), F.lit(3))
            .when((lo > hi) & (lo >= 2), F.lit(1))
            .otherwise(F.lit(2)))


def price_tier(df: DataFrame, text_col: str, out_col: str = "price_tier", **kw) -> DataFrame:
    return df.withColumn(out_col, price_tier_expr(F.col(text_col), **kw))


def one_hot(df: DataFrame, col: str, domain: Sequence[str] = C.REGIONS,
            name=region_column) -> DataFrame:
    """One 0/1 column per domain value (``region_`` + lower, spaces → ``_``);
    a value outside the domain gives all zeros."""
    c = F.col(col)
    return df.select(*df.columns, *[F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(name(v))
                                    for v in domain])


def rule_class(df: DataFrame, classes: Sequence[str] = C.CLASS_LABELS, out_col: str = "rule_class",
               default: str | None = None) -> DataFrame:
    """Argmax of the class ratios (first class wins ties); ``default`` when no hit."""
    items = [F.struct(F.col(f"{_class_key(c)}_keyword_ratio").alias("r"), F.lit(-i).alias("o"),
                      F.lit(c).alias("c")) for i, c in enumerate(classes)]
    best = F.array_max(F.array(*items))
    return df.withColumn(out_col, F.when(best["r"] > 0, best["c"]).otherwise(F.lit(default)))


def keyword_table(spark, dictionary: Mapping[str, Sequence[str]] = C.CLASS_KEYWORDS) -> DataFrame:
    """Dictionary as a two-column table ``(cls, kw)``; order kept in ``kw_ord``."""
    rows = [(c, k.lower(), i) for c, kws in dictionary.items() for i, k in enumerate(kws)]
    return spark.createDataFrame(rows, "cls string, kw string, kw_ord int")


#: keywords of a table that are looked for in one pass over the texts
PASS_KEYWORDS = 200_000


def keyword_join(df: DataFrame, key: str, text_col: str, keywords: DataFrame,
                 classes: Sequence[str] | None = None, whole_words: bool = False) -> DataFrame:
    """Join ``lower(text) contains kw`` against a keyword table of any size, counted
    per (key, cls).  Every row gets a row per class (zero when nothing hits).

    Texts stay where they are: the table is cut by hash into parts of about
    ``PASS_KEYWORDS`` rows, each of which goes to the tasks for one pass over the texts,
    and the passes' counts are added inside the row."""
    kw = keywords.select("cls", F.lower("kw").alias("kw"))
    if classes is None:
        classes = [r["cls"] for r in kw.select("cls").distinct().orderBy("cls").collect()]     # the class list
    parts = max(1, -(-kw.count() // PASS_KEYWORDS))
    part = F.pmod(F.xxhash64("cls", "kw"), F.lit(parts))
    low = df.select(F.col(key), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    total = None
    for p in range(parts):
        rows = (kw if parts == 1 else kw.filter(part == p)).toPandas()          # about PASS_KEYWORDS rows
        own = {c: rows.loc[rows["cls"] == c, "kw"].tolist() for c in classes}
        hits = class_hits(F.col("_low"), own, whole_words)
        total = hits if total is None else F.zip_with(total, hits, lambda x, y: x + y)
    counted = low.select(key, total.alias("_hits"))
    named = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col("_hits").alias("hits"))
    return counted.select(key, F.explode(named).alias("_h")).select(key, F.col("_h.cls").alias("cls"), F.col("_h.hits").cast("long").alias("hits"))


def keyword_counts(df: DataFrame, key: str, text_col: str, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """:func:`keyword_join` for a dictionary known on the driver: counts per row and
    class without any shuffle."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(key), low.alias("_low"))
    pairs = F.array(*[F.struct(F.lit(c).alias("cls"), keyword_hits(F.col("_low"), kws).cast("long").alias("hits"))
                      for c, kws in dictionary.items()])
    return rows.select(key, F.explode(pairs).alias("_h")).select(key, "_h.cls", "_h.hits")
