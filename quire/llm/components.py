"""Connected components by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(v, label)`` for every vertex of ``(a, b)`` long edges; the label is the
    smallest vertex of the component.  Each round takes the smallest label among
    the neighbours and then the label's own label, so the number of rounds grows
    with the logarithm of a component's diameter.  Labels stay on the executors and
    are written out once a round; only a count of changes reaches the driver."""
    pairs = edges.filter(F.col("a") != F.col("b"))
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                 .select("v", F.least("v", "m").alias("label")))
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        lower = cut(labels.join(around, "v").select("v", F.least("label", "m").alias("to"), F.col("label").alias("was")))
        via = lower.select(F.col("v").alias("to"), F.col("to").alias("beyond"))
        moved = cut(lower.join(via, "to").select("v", F.least("to", "beyond").alias("label"), "was"))
        labels = moved.select("v", "label")
        if not moved.filter(F.col("label") != F.col("was")).limit(1).count():
            return labels
