"""Conversation logs: one row per message.

Message columns: ``conv_id, subject_id, turn, role, text`` and, where activity
matters, ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import strip_prediction_marker
from ..schema import duration_us, micros

ROLE_NAMES = {"user": "User"}
CONTEXT_TITLE = "Previous conversation:"


def conversation_history(messages: DataFrame, last: int | None = 10) -> DataFrame:
    """The newest ``last`` messages of every conversation; of one turn the last by role and text."""
    if last is None:
        return messages
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return messages.withColumn("_r", newest).filter(F.col("_r") <= last).drop("_r")


def conversation_context(messages: DataFrame, last: int = 10) -> DataFrame:
    """The newest messages as one text per conversation."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(speaker, F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"])
    # At most ``last`` messages per conversation are gathered.
    return (
        conversation_history(messages, last)
        .groupBy("conv_id")
        .agg(F.concat_ws("\n", F.lit(CONTEXT_TITLE), lines).alias("context"))
    )


def conversation_get(messages: DataFrame, conv_id, subject_id=None) -> DataFrame:
    """Messages of one conversation, optionally only when it belongs to the subject."""
    test = F.col("conv_id") == F.lit(conv_id)
    if subject_id is not None:
        test = test & (F.col("subject_id") == F.lit(subject_id))
    return messages.filter(test)


def conversation_delete(messages: DataFrame, conv_id) -> DataFrame:
    """All messages but those of one conversation."""
    return messages.filter(~F.col("conv_id").eqNullSafe(F.lit(conv_id)))


def conversation_list(messages: DataFrame) -> DataFrame:
    """Conversations with their size and last activity, newest first within a subject."""
    return (
        messages.groupBy("subject_id", "conv_id")
        .agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"))
        .orderBy("subject_id", F.desc("last_activity"), "conv_id")
    )


def conversation_retention(conversations: DataFrame, keep: int = 10) -> DataFrame:
    """The newest ``keep`` conversations of every subject."""
    newest = F.row_number().over(
        Window.partitionBy("subject_id").orderBy(F.desc("last_activity"), F.asc("conv_id"))
    )
    return conversations.withColumn("_r", newest).filter(F.col("_r") <= keep).drop("_r")


def conversation_expiry(conversations: DataFrame, now: Column, idle: str | int = "24 hours") -> DataFrame:
    """Conversations that were active within ``idle`` before ``now``."""
    return conversations.filter(micros(F.col("last_activity")) >= micros(now) - duration_us(idle))


def conversation_stats(messages: DataFrame) -> DataFrame:
    """Conversations and messages per subject and in total (subject NULL)."""
    per = messages.groupBy("subject_id", "conv_id").agg(F.count(F.lit(1)).alias("m"))
    return per.rollup("subject_id").agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("m").alias("messages"), F.grouping("subject_id").cast("int").alias("is_total")
    )


def strip_markers(messages: DataFrame) -> DataFrame:
    """Marked prediction results become assistant messages without the marker."""
    text, role = strip_prediction_marker(F.col("text"), F.col("role"))
    return messages.withColumns({"text": text, "role": role})
