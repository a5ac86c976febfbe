"""Incremental forms: activity sessions of a stream, and stages that each keep their own watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def session_windows(events: DataFrame, entity: str, ts: str, gap: str, late: str) -> DataFrame:
    """(entity, start, end, n_events): sessions parted by more than gap, in the session time zone; works on a stream and on a table.

    An event that comes more than `late` behind the newest one is dropped by a stream, and so
    bounds the state it holds. Rows without entity or time are left out.
    """
    timed = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, late)
    w = F.session_window(ts, gap)
    return (
        timed.groupBy(w.alias("w"), entity)
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n_events"))
        .select(entity, "start", "end", "n_events")
    )


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a stream over all that is there now and read back its last result."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)

    def keep(batch: DataFrame, epoch: int) -> None:
        # The same epoch writes the same folder again, so a repeated batch changes nothing.
        batch.write.mode("overwrite").parquet(f"{out}/result/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(keep).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/result")
    last = got.agg(F.max("epoch").alias("epoch")) if mode == "complete" else None
    return (got.join(F.broadcast(last), "epoch") if last is not None else got).drop("epoch")


def advance(units: DataFrame, watermarks: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Units beyond a stage's watermark, and the stage's new watermarks.

    units: (session_id, sequence, ...); watermarks: (session_id, stage, through_sequence). A stage without
    a watermark for a session has done nothing of it; other stages' watermarks stay as they are.
    """
    held = watermarks.where(F.col("stage") == stage).select("session_id", "through_sequence")
    pending = units.join(held, "session_id", "left").where("through_sequence is null or sequence > through_sequence").drop("through_sequence")
    moved = units.groupBy("session_id").agg(F.max("sequence").alias("through_sequence")).withColumn("stage", F.lit(stage))
    others = watermarks.where(F.col("stage") != stage)
    gone = held.join(moved.select("session_id"), "session_id", "left_anti").withColumn("stage", F.lit(stage))
    return pending, moved.unionByName(gone).unionByName(others)
