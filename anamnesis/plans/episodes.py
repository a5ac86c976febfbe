"""Episodes of boundary_inputs: problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.instants import rfc3339
from anamnesis.operators.sessions import ENDLESS, cut_tree, gap_tree
from anamnesis.sources.tables import table

#: The gap of a session whose profile is in no configuration, in minutes.
DEFAULT_GAP_MINUTES = 30
#: Gap settings that p5_gap_settings compares, in minutes.
SETTINGS = (5, 10, 15, 20, 30, 45, 60, 120, 240)


def readable_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event_id of boundary_inputs once, with its instant; unreadable times are left out.

    Deliveries of one event are folded before anything else is done, combined on the map side, so
    an event that is delivered very often costs nothing. Where they disagree, the earliest instant counts.
    """
    said = rfc3339(F.col("created_at"))
    return (
        table(spark, folder, "boundary_inputs")
        .select("event_id", "session_id", "profile_id", "sequence", said.alias("instant"))
        .where("instant is not null and event_id is not null and session_id is not null")
        .groupBy("event_id")
        .agg(F.min(F.struct("instant", "sequence", "session_id", "profile_id")).alias("d"))
        .select("event_id", "d.*")
    )


def episode_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Gap trees of all sessions with each session's own threshold, limit_s, in seconds."""
    nodes = gap_tree(readable_events(spark, folder), "session_id", "event_id", F.col("instant"), "sequence", F.col("profile_id"))
    held = (
        table(spark, folder, "memory_configs")
        .groupBy("profile_id")
        .agg(F.max_by("episode_gap_minutes", "config_version").alias("minutes"))
    )
    limit = F.coalesce("minutes", F.lit(DEFAULT_GAP_MINUTES)).cast("long") * 60
    return nodes.join(held, nodes["profile"] == held["profile_id"], "left").select(nodes["*"], limit.alias("limit_s"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_tree(episode_nodes(spark, folder), F.col("limit_s")).select(
        F.col("entity").alias("session_id"),
        F.col("first_event").alias("start_event_id"),
        F.col("last_event").alias("end_event_id"),
    )


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Start, end, duration and size of every episode."""
    us = lambda s, n: F.col(s) * 1_000_000 + F.floor(F.col(n) / 1000)
    return cut_tree(episode_nodes(spark, folder), F.col("limit_s")).select(
        F.col("entity").alias("session_id"),
        F.col("first_event").alias("start_event_id"),
        F.col("last_event").alias("end_event_id"),
        us("first_sec", "first_nano").alias("start_us"),
        us("last_sec", "last_nano").alias("end_us"),
        (F.col("last_sec") - F.col("first_sec") - F.when(F.col("last_nano") < F.col("first_nano"), 1).otherwise(0)).alias("duration_s"),
        "n_events",
    )


def p5_gap_settings(spark: SparkSession, folder: str) -> DataFrame:
    """How many episodes each of many gap settings would give: one tree, one pass over its nodes."""
    seconds = F.array(*[F.lit(m * 60).cast("long") for m in SETTINGS])
    held = F.filter(seconds, lambda t: (F.col("gap") <= t) & (F.col("parent_gap") > t))
    return (
        episode_nodes(spark, folder)
        .select(F.explode(held).alias("t"), "n_events")
        .groupBy((F.col("t") / 60).cast("long").alias("gap_minutes"))
        .agg(
            F.count(F.lit(1)).alias("n_episodes"),
            F.sum("n_events").alias("n_events"),
            F.max("n_events").alias("largest"),
        )
    )


def p5_gap_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded gaps of boundary_decisions beside the gaps that all messages give.

    An event starts a run at limit - 1 s but none at the limit if its gap equals the limit, so the
    state follows from the tree at two settings. An event of boundary_inputs without readable time
    has the state missing_timestamp or invalid_or_out_of_order; an unknown one, unknown_event.
    """
    at = (F.col("gap") <= F.col("limit_s")) & (F.col("parent_gap") > F.col("limit_s"))
    under = (F.col("gap") <= F.col("limit_s") - 1) & (F.col("parent_gap") > F.col("limit_s") - 1)
    root = F.col("parent_gap") == ENDLESS
    starts = (
        episode_nodes(spark, folder)
        .where(at | under | root | (F.col("gap") < 0))
        .groupBy(F.col("first_event").alias("event_id"))
        .agg(F.bool_or(root).alias("root"), F.bool_or(at).alias("at"), F.bool_or(under).alias("under"))
    )
    known = (
        table(spark, folder, "boundary_inputs")
        .where("event_id is not null")
        .groupBy("event_id")
        .agg(F.max("created_at").alias("said"))
    )
    recorded = (
        table(spark, folder, "boundary_decisions")
        .select(F.col("before_event_id").alias("event_id"), F.col("gap").alias("recorded_gap"))
        .distinct()
    )
    state = (
        F.when(F.col("root"), "first_message")
        .when(F.col("at"), "greater_than_threshold")
        .when(F.col("under"), "equal_to_threshold")
        .when(F.col("at").isNotNull(), "below_threshold")
        .when(F.col("seen").isNull(), "unknown_event")
        .when(F.col("said").isNull(), "missing_timestamp")
        .otherwise("invalid_or_out_of_order")
    )
    known = known.withColumn("seen", F.lit(True))
    return (
        recorded.join(known, "event_id", "left")
        .join(starts, "event_id", "left")
        .select("event_id", "recorded_gap", state.alias("derived_gap"))
        .withColumn("agrees", F.coalesce(F.col("recorded_gap") == F.col("derived_gap"), F.lit(False)))
    )


EVENTS_ = r"""
  e as (
    select event_id, min(session_id) session_id, min(profile_id) profile_id, min(sequence) seq, min(us) us from (
      select *, epoch_us(try_cast(created_at as timestamptz)) us from boundary_inputs
      where regexp_full_match(created_at, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)'))
    where us is not null group by event_id),
  lim as (select profile_id, arg_max(episode_gap_minutes, config_version) * 60 lim from memory_configs group by 1),
  g as (
    select e.*, coalesce(lim, 1800) lim, lag(us) over w prev, (us - lag(us) over w) // 1000000 gap
    from e left join lim using (profile_id) window w as (partition by session_id order by us, seq, event_id))"""
RUNS_ = """
  r as (select *, sum(case when gap is null or gap > {lim} then 1 else 0 end) over (partition by session_id order by us, seq, event_id) run from g)"""

QUERIES = {
    "p5_found": p5_found,
    "p5_sessions": p5_sessions,
    "p5_gap_settings": p5_gap_settings,
    "p5_gap_audit": p5_gap_audit,
}
ORACLES = {
    "p5_found": f"with {EVENTS_}, {RUNS_.format(lim='lim')} "
    "select session_id, arg_min(event_id, (us, seq, event_id)) start_event_id, arg_max(event_id, (us, seq, event_id)) end_event_id from r group by session_id, run",
    "p5_sessions": f"with {EVENTS_}, {RUNS_.format(lim='lim')} "
    "select session_id, arg_min(event_id, (us, seq, event_id)) start_event_id, arg_max(event_id, (us, seq, event_id)) end_event_id, "
    "min(us) start_us, max(us) end_us, (max(us) - min(us)) // 1000000 duration_s, count(*) n_events from r group by session_id, run",
    "p5_gap_settings": f"with {EVENTS_}, "
    + f"s as (select unnest({list(SETTINGS)}) m), "
    + "r as (select m, session_id, us, sum(case when gap is null or gap > m * 60 then 1 else 0 end) over (partition by m, session_id order by us, seq, event_id) run from g, s), "
    + "k as (select m, session_id, run, count(*) n from r group by all) "
    + "select m::bigint gap_minutes, count(*) n_episodes, sum(n)::bigint n_events, max(n) largest from k group by 1",
    "p5_gap_audit": f"with {EVENTS_}, "
    "k as (select event_id, max(created_at) said from boundary_inputs where event_id is not null group by 1), "
    "d as (select distinct before_event_id event_id, gap recorded_gap from boundary_decisions), "
    "j as (select d.*, case when g.event_id is not null and gap is null then 'first_message' when gap > lim then 'greater_than_threshold' "
    "when gap = lim then 'equal_to_threshold' when gap < lim then 'below_threshold' when k.event_id is null then 'unknown_event' "
    "when said is null then 'missing_timestamp' else 'invalid_or_out_of_order' end derived_gap "
    "from d left join k using (event_id) left join g using (event_id)) "
    "select *, coalesce(recorded_gap = derived_gap, false) agrees from j",
}
