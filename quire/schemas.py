"""Explicit schemas for every file the engine reads or writes (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as C

ENTITY_SCHEMA = T.StructType([
    T.StructField("destination_name", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("travel_style_label", T.StringType()),
    T.StructField("wikivoyage_url", T.StringType()),
])

ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("understand", T.StringType()),
    T.StructField("do", T.StringType()),
    T.StructField("sleep", T.StringType()),
    T.StructField("full_text", T.StringType()),
])

# query.pages[].{missing, revisions[].slots.main.content}
ENVELOPE_SCHEMA = T.StructType([
    T.StructField("query", T.StructType([
        T.StructField("pages", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("missing", T.BooleanType()),
            T.StructField("revisions", T.ArrayType(T.StructType([
                T.StructField("slots", T.StructType([
                    T.StructField("main", T.StructType([
                        T.StructField("content", T.StringType()),
                    ])),
                ])),
            ]))),
        ]))),
    ])),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("source_document", T.StringType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("encoder_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_input", T.StringType()),
    T.StructField("agent_response", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
])

TOOL_CALL_SCHEMA = T.StructType([
    T.StructField("call_id", T.StringType(), False),
    T.StructField("run_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("tool_input", T.StringType()),
    T.StructField("tool_output", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
])

EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("accuracy_mean", T.DoubleType()),
    T.StructField("accuracy_std", T.DoubleType()),
    T.StructField("f1_mean", T.DoubleType()),
    T.StructField("f1_std", T.DoubleType()),
    T.StructField("per_class_metrics", T.StringType()),
    T.StructField("random_seed", T.IntegerType()),
    T.StructField("saved_model_path", T.StringType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("session_id", T.StringType()),
])


def region_column(region: str) -> str:
    return "region_" + region.lower().replace(" ", "_")


def keyword_feature_columns(classes=None) -> list[str]:
    """Count/binary pairs per class, then the ratios, in class order."""
    classes = list(classes or C.CLASS_KEYWORDS)
    cols = []
    for c in classes:
        k = c.lower()
        cols += [f"{k}_keyword_count", f"{k}_keyword_binary"]
    cols += [f"{c.lower()}_keyword_ratio" for c in classes]
    return cols


def feature_columns(classes=None, regions=None) -> list[str]:
    """Model inputs: keyword features, price tier, region one-hot."""
    regions = list(regions or C.REGIONS)
    return keyword_feature_columns(classes) + ["price_tier"] + [region_column(r) for r in regions]


def feature_schema(classes=None, regions=None, key="destination_name", label="label") -> T.StructType:
    """Schema of the feature matrix file, generated from the dictionary and domain."""
    fields = []
    for name in feature_columns(classes, regions):
        typ = T.DoubleType() if name.endswith("_ratio") else T.IntegerType()
        fields.append(T.StructField(name, typ))
    fields += [T.StructField(key, T.StringType()), T.StructField(label, T.StringType())]
    return T.StructType(fields)
