"""Conversation message lists.

The original keeps a growing in-memory list per conversation (an append
reducer).  Here the message table *is* the list (one row per message, ordered
by turn); summaries use decomposable aggregates only, so one enormous
conversation never has to be collected into a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def conversation_summary(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: message counts by role, last turn and its role, total characters."""
    return messages.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum((F.col(role) == "user").cast("long")).alias("n_user"),
        F.sum((F.col(role) == "assistant").cast("long")).alias("n_assistant"),
        F.max(turn).alias("last_turn"),
        F.max_by(role, turn).alias("last_role"),
        F.sum(F.length(text)).cast("long").alias("total_chars"))


def append_messages(log: DataFrame, new: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Append reducer as a table operation: new messages get turns after the
    conversation's current last turn (per-conversation max is a partial aggregate)."""
    last = log.groupBy(conv).agg(F.max(turn).alias("_last"))
    w_order = F.col("_seq")
    out = new.join(last, conv, "left").withColumn(
        turn, F.coalesce(F.col("_last"), F.lit(-1)) + w_order)
    return log.unionByName(out.drop("_last", "_seq"), allowMissingColumns=True)
