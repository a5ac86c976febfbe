"""Replay of the append-only control log, and what it hides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.operators.ordered import neighbours

#: Records of a chain that are scanned together.
RUN = 1024


def records(log: DataFrame) -> DataFrame:
    """Each record once; repeated and displaced rows are folded by the record's own hash."""
    return log.where("record_sha256 is not null").dropDuplicates(["record_sha256"])


def state(log: DataFrame) -> DataFrame:
    """(store_id, target_kind, target_id, action, sequence): the last action on each target, by one aggregation."""
    return (
        records(log)
        .groupBy("store_id", "target_kind", "target_id")
        .agg(F.max_by("action", "sequence").alias("action"), F.max("sequence").alias("sequence"))
    )


def hidden(log: DataFrame, kind: str) -> DataFrame:
    """Targets of a kind that some store excludes now."""
    return state(log).where((F.col("target_kind") == kind) & (F.col("action") == "exclude")).select("target_id").distinct()


def visible(messages: DataFrame, log: DataFrame, event: str = "event_id", session: str = "session_id") -> DataFrame:
    """Messages whose session and event are not excluded: two anti joins, broadcast only if Spark finds them small."""
    sessions = hidden(log, "session").withColumnRenamed("target_id", session)
    events = hidden(log, "event").withColumnRenamed("target_id", event)
    return messages.join(sessions, session, "left_anti").join(events, event, "left_anti")


def chain_faults(log: DataFrame) -> DataFrame:
    """Records whose sequence or stored previous hash does not follow the record before them in their store."""
    linked = neighbours(
        records(log).select("store_id", "sequence", "record_sha256", "previous_record_sha256"),
        ["store_id"],
        F.floor(F.col("sequence") / RUN),
        ["sequence", "record_sha256"],
        F.struct("sequence", "record_sha256"),
    )
    before = F.col("value_before")
    return linked.select(
        "store_id",
        "sequence",
        "record_sha256",
        F.when(~before["record_sha256"].eqNullSafe(F.col("previous_record_sha256")), "previous_hash")
        .when(F.col("sequence") != F.coalesce(before["sequence"], F.lit(0)) + 1, "sequence_gap")
        .alias("fault"),
    ).where("fault is not null")


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Records that exclude an excluded target or restore one that is not excluded."""
    from pyspark.sql import Window

    w = Window.partitionBy("store_id", "target_kind", "target_id").orderBy("sequence", "record_sha256")
    return (
        records(log)
        .withColumn("before", F.coalesce(F.lag("action").over(w), F.lit("restore")))
        .where("before = action")
        .select("store_id", "target_kind", "target_id", "sequence", "action")
    )
