"""Structured Streaming queries: survey section 2.9."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.operators import turns
from anamnesis.plans.conversation import M_
from anamnesis.sources.tables import table
from anamnesis.streaming.sessions import advance, run_to_table, session_windows

GAP = "30 minutes"


def stream_sessions(s, d):
    """Sessions of each user's events, read as a stream."""
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    # A pattern rather than a path: a file stream takes a single file only so.
    stream = s.readStream.schema(schema).parquet(path[:-1] + "[t]")
    got = run_to_table(session_windows(stream, "user_id", "ts", GAP, "1 day"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return got.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n_events")


def table_sessions(s, d):
    """The same sessions from the table at once."""
    got = session_windows(table(s, d, "events"), "user_id", "ts", GAP, "1 day")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return got.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n_events")


def stage_watermarks(s, d):
    """Messages that a stage still has to do, where its watermark is that of the delivered boundary inputs."""
    units = turns.messages(table(s, d, "turns")).select("session_id", "sequence", "event_id")
    marks = table(s, d, "boundary_inputs").where("session_id is not null").groupBy("session_id").agg(F.min("watermark_before").alias("through_sequence")).withColumn("stage", F.lit("boundaries"))
    pending, moved = advance(units, marks, "boundaries")
    n = pending.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_pending"))
    return moved.join(n, "session_id", "left").select("session_id", "stage", "through_sequence", F.coalesce("n_pending", F.lit(0)).alias("n_pending"))


_S = """with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) b from events where user_id is not null and ts is not null),
  r as (select *, sum(case when b is null or ts - b > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) k from e)
  select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) end_us, count(*) n_events from r group by user_id, k"""


QUERIES = {f.__name__: f for f in (stream_sessions, table_sessions, stage_watermarks)}
ORACLES = {
    "stream_sessions": _S,
    "table_sessions": _S,
    "stage_watermarks": f"with {M_}, w as (select session_id, min(watermark_before) through from boundary_inputs where session_id is not null group by 1), u as (select session_id, max(sequence) l from m group by 1), p as (select m.session_id, count(*) n from m left join w using (session_id) where through is null or sequence > through group by 1) select coalesce(u.session_id, w.session_id) session_id, 'boundaries' stage, coalesce(l, through) through_sequence, coalesce(n, 0) n_pending from u full join w on u.session_id = w.session_id left join p on p.session_id = coalesce(u.session_id, w.session_id)",
}
