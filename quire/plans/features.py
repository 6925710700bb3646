"""Feature matrix end to end: entities ⋈ articles → keyword, tier and region
features in the generated feature-schema order."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..operators.keywords import keyword_features, one_hot, price_tier_expr
from ..operators.relational import first_per_key, pending
from ..operators.validate import validate_entities
from ..schemas import feature_columns
from ..sources.tables import cache_key


def build_features(entities: DataFrame, articles: DataFrame,
                   dictionary: Mapping[str, Sequence[str]] = C.CLASS_KEYWORDS,
                   thresholds: Mapping[str, int] = C.CLASS_THRESHOLDS,
                   regions: Sequence[str] = C.REGIONS,
                   tier_low: Sequence[str] = C.BUDGET_KEYWORDS, tier_high: Sequence[str] = C.LUXURY_KEYWORDS,
                   name_col: str = "destination_name", region_col: str = "region",
                   label_col: str = "travel_style_label", order_col: str = "ord",
                   done: DataFrame | None = None, method: str = "filter") -> tuple[DataFrame, DataFrame]:
    """(features, rejected entities).

    Entities are validated (non-blank name, region in the domain), names
    stripped, the first row of a repeated name kept (``order_col``), names in
    ``done`` skipped.  Articles are matched on the content-addressed cache key
    (``articles.cache_key``); a missing article reads as empty text and is
    flagged ``is_empty_article``.  Output columns: the feature columns in schema
    order, then ``destination_name``, ``label``, ``is_empty_article``."""
    valid, rejects = validate_entities(entities, name_col, region_col, regions)
    if order_col in valid.columns:
        valid = first_per_key(valid, name_col, order_col)
    else:                   # without an order the smallest row of a repeated name wins
        rest = [c for c in valid.columns if c != name_col]
        valid = first_per_key(valid.withColumn("_row", F.struct(*rest)), name_col, "_row").drop("_row")
    if done is not None:
        valid = pending(valid, done.select(F.col(name_col)), name_col)
    ents = valid.withColumn("cache_key", cache_key(name_col))
    # keywords are counted where the article text is; only the counts meet the entities
    arts = articles.select("cache_key", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("understand", "do", "sleep")])
    arts = arts.withColumn("_combined", F.concat(F.col("understand"), F.lit(" "), F.col("do")))
    arts = keyword_features(arts, "_combined", dictionary, thresholds, method=method)
    arts = arts.withColumn("price_tier", price_tier_expr(F.col("sleep"), tier_low, tier_high, method="filter"))
    arts = arts.drop("understand", "do", "sleep", "_combined").withColumn("_has", F.lit(True))
    j = ents.join(arts, "cache_key", "left").withColumn("is_empty_article", F.col("_has").isNull())
    f = j.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in arts.columns and c.rpartition("_keyword_")[1]
                   else F.coalesce(F.col(c), F.lit(2)).alias(c) if c == "price_tier" else F.col(c) for c in j.columns])
    f = one_hot(f, region_col, regions)
    cols = feature_columns(dictionary, regions)
    return (f.select(*cols, F.col(name_col).alias("destination_name"), F.col(label_col).alias("label"),
                     "is_empty_article"),
            rejects)
