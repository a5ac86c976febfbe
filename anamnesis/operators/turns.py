"""Turns and the messages derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.ordered import ordinal

_STATE = ("session_id", "created_at", "status", "user_content", "assistant_content", "thinking", "usage", "done_reason", "error")


def last_states(turns: DataFrame) -> DataFrame:
    """The row of each turn id that was updated last; equal rows are folded on the map side."""
    return (
        turns.where("id is not null and session_id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("updated_at", *_STATE)).alias("t"))
        .select("id", "t.*")
    )


def numbered(turns: DataFrame) -> DataFrame:
    """Last states with turn_no, which runs from 0 in each session by creation. Sessions are scanned by day."""
    return ordinal(last_states(turns), ["session_id"], F.substring("created_at", 1, 10), ["created_at", "id"], "turn_no")


def messages(turns: DataFrame) -> DataFrame:
    """One row per message: event_id, session_id, sequence, role, content, created_at, turn_id, turn_no, status.

    The user message of turn i has sequence 2i + 1. The answer, 2i + 2, exists unless the turn is
    pending or blocked.
    """
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.lit(1).alias("step"), F.col("user_content").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit(2).alias("step"), F.col("assistant_content").alias("content")),
    )
    return (
        numbered(turns)
        .withColumn("m", F.explode(both))
        .where("m.role = 'user' or status not in ('pending', 'blocked')")
        .select(
            F.concat_ws(":", "id", "m.role").alias("event_id"),
            "session_id",
            (F.col("turn_no") * 2 + F.col("m.step")).alias("sequence"),
            "m.role",
            F.coalesce("m.content", F.lit("")).alias("content"),
            "created_at",
            F.col("id").alias("turn_id"),
            "turn_no",
            "status",
        )
    )
