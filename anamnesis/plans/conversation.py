"""Sessions, turns, messages, control log and clauses: survey sections 2.1 to 2.6 and 2.10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import control, turns
from anamnesis.operators.ordered import neighbours, ordinal
from anamnesis.sources.tables import table

#: Fixed values of the reference: shares of the input budget, and its parts.
CONTEXT, OUTPUT, MARGIN, WARN, TRIM = 32768, 4096, 512, 0.90, 0.80
INPUT = CONTEXT - OUTPUT - MARGIN
SUFFIX_BUDGET = 4000


def _turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "turns")


def _messages(s: SparkSession, d: str) -> DataFrame:
    return turns.messages(_turns(s, d))


def _log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "control_records")


def events_derive(s, d):
    """User and assistant messages of every turn, numbered in their session."""
    return _messages(s, d).select("event_id", "session_id", "sequence", "role", "status", F.sha2("content", 256).alias("content_sha256"))


def session_list(s, d):
    """Sessions that are not excluded, with their latest change."""
    by = turns.last_states(_turns(s, d)).groupBy("session_id").agg(F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("n_turns"))
    return by.join(control.hidden(_log(s, d), "session").withColumnRenamed("target_id", "session_id"), "session_id", "left_anti")


def session_prefix(s, d):
    """S3: what a prefix of six characters of each session id resolves to; null where it is ambiguous."""
    ids = _turns(s, d).select("session_id").distinct()
    return (
        ids.groupBy(F.substring("session_id", 1, 6).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min("session_id").alias("first"))
        .select("prefix", "n_matches", F.when(F.col("n_matches") == 1, F.col("first")).alias("session_id"))
    )


def session_title(s, d):
    """A session's title from its first message."""
    first = turns.last_states(_turns(s, d)).groupBy("session_id").agg(F.min_by("user_content", F.struct("created_at", "id")).alias("c"))
    return first.select("session_id", T.title(F.col("c")).alias("title"))


def eligible_turns(s, d):
    """turns that may serve as context."""
    return turns.last_states(_turns(s, d)).where("status in ('complete', 'truncated') and assistant_content <> ''").select("id", "session_id", "status")


def turns_recovered(s, d):
    """A pending turn that nothing followed up counts as interrupted."""
    return turns.last_states(_turns(s, d)).select("id", F.when(F.col("status") == "pending", "interrupted").otherwise(F.col("status")).alias("status"))


def retryable_errors(s, d):
    """turns by whether their error may be tried again."""
    retry = F.col("error").rlike(r"(?i)connection|stream|timed out|\b(408|429|500|502|503|504)\b")
    return (
        turns.last_states(_turns(s, d)).where("error is not null").groupBy("error", retry.alias("retryable")).agg(F.count(F.lit(1)).alias("n"))
    )


def usage_rollup(s, d):
    """Sums over the turns whose input and output counts are both known; a total needs both."""
    u = F.col("usage")
    known = u["input_tokens"].isNotNull() & u["output_tokens"].isNotNull()
    both = lambda c: F.sum(F.when(known, c))
    return (
        turns.last_states(_turns(s, d))
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.count_if(known).alias("n_known"),
            both(u["input_tokens"]).alias("input_tokens"),
            both(u["output_tokens"]).alias("output_tokens"),
            both(u["input_tokens"] + u["output_tokens"]).alias("total_tokens"),
        )
    )


def append_only_violations(s, d):
    """K2: saved states of one turn that differ in what may never change, or change after a final state."""
    final = F.col("status").isin("complete", "truncated", "failed", "interrupted", "no_answer", "blocked")
    w = Window.partitionBy("id").orderBy("updated_at", "status")
    rows = _turns(s, d).select("id", "updated_at", "status", "user_content", "created_at", "assistant_content", final.alias("final")).distinct()
    before = F.lag(F.struct("user_content", "created_at", "assistant_content", "status", "final")).over(w)
    kind = (
        F.when(~F.col("b.user_content").eqNullSafe(F.col("user_content")) | ~F.col("b.created_at").eqNullSafe(F.col("created_at")), "rewritten")
        .when(F.col("b.final") & (~F.col("b.assistant_content").eqNullSafe(F.col("assistant_content")) | ~F.col("b.status").eqNullSafe(F.col("status"))), "changed_after_end")
    )
    return rows.withColumn("b", before).where("b is not null").select("id", "updated_at", kind.alias("violation")).where("violation is not null")


def control_state(s, d):
    """The last action on every target."""
    return control.state(_log(s, d))


def control_violations(s, d):
    """actions that do not alternate."""
    return control.illegal_transitions(_log(s, d))


def control_chain(s, d):
    """records that do not follow the record before."""
    return control.chain_faults(_log(s, d))


def control_targets(s, d):
    """event records by whether the event is there and still has the recorded session and content."""
    r = control.records(_log(s, d)).where("target_kind = 'event'").select("record_sha256", "target_id", "target_session_id", "target_content_sha256")
    e = table(s, d, "boundary_inputs").where("event_id is not null").groupBy("event_id").agg(F.min(F.struct("session_id", "content_sha256")).alias("e"))
    state = (
        F.when(F.col("e").isNull(), "missing")
        .when(F.col("e.session_id") != F.col("target_session_id"), "other_session")
        .when(F.col("e.content_sha256") != F.col("target_content_sha256"), "other_content")
        .otherwise("bound")
    )
    return r.join(e, r["target_id"] == e["event_id"], "left").select("record_sha256", state.alias("binding"))


def visible_events(s, d):
    """boundary messages that neither their session nor themselves hide."""
    e = table(s, d, "boundary_inputs").where("event_id is not null and session_id is not null").select("event_id", "session_id").distinct()
    return control.visible(e, _log(s, d))


def content_hash(s, d):
    """Stored content hashes that differ from the content's."""
    e = table(s, d, "boundary_inputs").select("event_id", "content_sha256", F.sha2("content", 256).alias("computed_sha256")).distinct()
    return e.groupBy((F.col("content_sha256") == F.col("computed_sha256")).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


def token_upper_bound(s, d):
    """Upper bound of a session's tokens, in bytes."""
    size = F.octet_length("content") + F.octet_length("role") + 64
    return _messages(s, d).groupBy("session_id").agg((F.sum(size) + 256).cast("bigint").alias("upper_bound"))


def budget_thresholds(s, d):
    """Input budget and thresholds beside each session's bound."""
    return token_upper_bound(s, d).select(
        "session_id",
        F.lit(INPUT).alias("input_budget"),
        F.lit(int(INPUT * WARN)).alias("warn_at"),
        F.lit(int(INPUT * TRIM)).alias("trim_to"),
        F.try_divide("upper_bound", F.lit(INPUT)).alias("ratio"),
    )


def limit_status(s, d):
    """Whether a session's context is ready, warned of, or must be trimmed first."""
    at = F.col("upper_bound")
    return token_upper_bound(s, d).select(
        "session_id", F.when(at > INPUT, "limit").when(at >= int(INPUT * WARN), "warning").otherwise("ready").alias("limit_status")
    )


def _linked(s, d, value):
    m = _messages(s, d)
    return neighbours(m, ["session_id"], F.substring("created_at", 1, 10), ["sequence"], value)


def edge_adjacent(s, d):
    """Each message that is not blank and the next one of its session."""
    seen = F.col("content").rlike(r"[\p{L}\p{N}\p{P}\p{S}]")
    spoken = F.when(seen, F.col("event_id"))
    return _linked(s, d, spoken).where(seen & F.col("value_after").isNotNull()).select(
        F.col("event_id").alias("src"), F.col("value_after").alias("dst"), F.lit(1.0).alias("weight")
    )


def edge_reply(s, d):
    """A message and the one it replies to, which is the message before."""
    return _linked(s, d, F.col("event_id")).where("value_before is not null").select(
        F.col("event_id").alias("src"), F.col("value_before").alias("dst"), F.lit(1.0).alias("weight")
    )


def preceding_assistant(s, d):
    """The assistant message right before each user message."""
    return _linked(s, d, F.struct("event_id", "role")).where("role = 'user'").select(
        "event_id", F.when(F.col("value_before.role") == "assistant", F.col("value_before.event_id")).alias("assistant_event_id")
    )


def recent_suffix(s, d):
    """The newest messages of each session that fit a budget; the first misfit ends the scan.

    Sizes are summed from the newest message back in two levels, by day and within a day.
    """
    size = F.octet_length("content") + F.octet_length("role") + 64
    m = _messages(s, d).withColumn("size", size).withColumn("day", F.substring("created_at", 1, 10))
    later = Window.partitionBy("session_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = m.groupBy("session_id", "day").agg(F.sum("size").alias("n")).withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    within = Window.partitionBy("session_id", "day").orderBy(F.col("sequence").desc())
    run = m.withColumn("run", F.sum("size").over(within))
    return run.join(days, ["session_id", "day"]).where(F.col("run") + F.col("after") <= SUFFIX_BUDGET).select("session_id", "event_id", "sequence")


def turn_pairing(s, d):
    """Messages of evaluation sessions paired into turns: a user message and the answer after it, else one side alone."""
    sessions = table(s, d, "eval_cases").select(F.explode("sessions").alias("s")).select("s.external_id", "s.messages").where("external_id is not null")
    one = sessions.groupBy("external_id").agg(F.min("messages").alias("messages"))
    m = one.select("external_id", F.posexplode(F.transform("messages", lambda x: x["role"])).alias("pos", "role"))
    w = Window.partitionBy("external_id").orderBy("pos")  # a session is one row of the input
    starts = F.when((F.col("role") == "assistant") & (F.lag("role").over(w) == "user"), 0).otherwise(1)
    t = m.withColumn("starts", starts).withColumn("turn", F.sum("starts").over(w))
    return t.groupBy("external_id", "turn").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_messages"), F.max(F.when(F.col("role") == "user", 1).otherwise(0)).alias("has_user"))


def pending_units(s, d):
    """Boundary messages beyond their watermark, per session and batch of 16."""
    e = table(s, d, "boundary_inputs").where("event_id is not null and session_id is not null and sequence > watermark_before")
    once = e.groupBy("session_id", "event_id").agg(F.min("sequence").alias("sequence"))
    o = ordinal(once, ["session_id"], F.floor(F.col("sequence") / 1024), ["sequence", "event_id"])
    return o.groupBy("session_id", F.floor(F.col("ordinal") / 16).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("from_sequence"), F.max("sequence").alias("through_sequence")
    )


def stale_sessions(s, d):
    """sessions whose smallest delivered watermark lies before their last message."""
    e = table(s, d, "boundary_inputs").where("session_id is not null")
    by = e.groupBy("session_id").agg(F.max("watermark_before").alias("watermark"), F.max("sequence").alias("last_sequence"))
    return by.where("watermark is null or last_sequence > watermark").select("session_id", (F.col("last_sequence") - F.coalesce("watermark", F.lit(0))).alias("lag"))


def _clauses(df: DataFrame, key: str, content: str) -> DataFrame:
    raw = df.select(key, F.posexplode(T.raw_clauses(F.col(content))).alias("no", "raw"), T.raw_clauses(F.col(content)).alias("all"))
    begin = F.aggregate(F.slice("all", F.lit(1), F.col("no")), F.lit(0), lambda a, x: a + F.char_length(x))
    lead = F.char_length("raw") - F.char_length(F.ltrim(F.regexp_replace("raw", r"^\s+", "")))
    tidy = F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "")
    return (
        raw.select(key, "no", (begin + lead).alias("start_char"), tidy.alias("clause"))
        .where("clause <> ''")
        .withColumn("end_char", F.col("start_char") + F.char_length("clause"))
    )


def clauses(s, d):
    """Clauses of every distinct message content with their offsets."""
    c = table(s, d, "boundary_inputs").where("content is not null").groupBy("content_sha256").agg(F.min("content").alias("content"))
    return _clauses(c, "content_sha256", "content").select("content_sha256", "start_char", "end_char", F.sha2("clause", 256).alias("clause_sha256"))


def clause_offsets(s, d):
    """Stored clauses whose offsets do not give back their text."""
    c = table(s, d, "source_clauses").where("clause_id is not null").dropDuplicates(["clause_id"])
    e = table(s, d, "boundary_inputs").where("event_id is not null").groupBy("event_id").agg(F.min("content").alias("content"))
    got = F.col("content").substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    fault = F.when(F.col("content").isNull(), "unknown_event").when(
        (F.col("start_char") < 0) | (F.col("end_char") > F.char_length("content")) | (F.col("end_char") <= F.col("start_char")), "out_of_range"
    ).when(got != F.col("text"), "other_text")
    return c.join(e, "event_id", "left").select("clause_id", fault.alias("fault")).where("fault is not null")


def nonassertive(s, d):
    """clauses that assert nothing: a greeting, or a lone question without inner marks."""
    t = F.trim(F.lower("text"))
    plain = F.regexp_replace(t, r"[.。!！?？;；,，\s]+$", "")
    question = t.rlike(r"[?？]$") & ~F.regexp_replace(t, r"[?？]+$", "").rlike(r"[,，、.。;；!！?？]")
    c = table(s, d, "source_clauses").where("clause_id is not null").dropDuplicates(["clause_id"])
    return c.select("clause_id", (plain.isin(*T.GREETINGS) | question).alias("nonassertive"))


def normalize_answer(s, d):
    """Normal form of expected answers."""
    c = table(s, d, "eval_cases").where("id is not null").groupBy("id").agg(F.min("expected_answer").alias("a"))
    return c.select("id", T.normal_answer(F.col("a")).alias("answer"))


def passages(s, d):
    """Sliding windows over every distinct snapshot content."""
    c = table(s, d, "knowledge_snapshots").where("content is not null and revision_id is not null").groupBy("revision_id").agg(F.min("content").alias("content"))
    p = c.withColumn("start_char", F.explode(T.window_starts(F.char_length("content"))))
    return p.select("revision_id", "start_char", (F.col("start_char") + T.WINDOW).alias("end_char"), F.sha2(F.col("content").substr(F.col("start_char") + 1, F.lit(T.WINDOW)), 256).alias("span_sha256"))


def turn_pool_status(s, d):
    """State of each session's turns as one word."""
    st = F.col("status")
    return (
        turns.last_states(_turns(s, d))
        .groupBy("session_id")
        .agg(F.bool_or(st == "interrupted").alias("cut"), F.bool_and(st == "complete").alias("all_ok"), F.bool_or(st == "complete").alias("some_ok"))
        .select("session_id", F.when(F.col("cut"), "cancelled").when(F.col("all_ok"), "completed").when(F.col("some_ok"), "partial").otherwise("failed").alias("stage_status"))
    )


T_ = """t as (select * exclude (k) from (select *, row_number() over (partition by id order by updated_at desc) k from turns where id is not null and session_id is not null) where k = 1)"""
M_ = T_ + """,
  n as (select *, row_number() over (partition by session_id order by created_at, id) - 1 turn_no from t),
  m as (select id || ':user' event_id, session_id, 2 * turn_no + 1 sequence, 'user' role, coalesce(user_content, '') content, status from n
    union all select id || ':assistant', session_id, 2 * turn_no + 2, 'assistant', coalesce(assistant_content, ''), status from n where status not in ('pending', 'blocked'))"""
R_ = """r as (select distinct * from control_records where record_sha256 is not null),
  st as (select store_id, target_kind, target_id, arg_max(action, sequence) action, max(sequence) sequence from r group by all),
  hid as (select distinct target_kind, target_id from st where action = 'exclude')"""
UB_ = f"with {M_}, ub as (select session_id, sum(strlen(content) + strlen(role) + 64)::bigint + 256 upper_bound from m group by 1)"
C_ = """c as (select content_sha256, min(content) content from boundary_inputs where content is not null group by 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        events_derive, session_list, session_prefix, session_title, eligible_turns, turns_recovered, retryable_errors, usage_rollup,
        append_only_violations, control_state, control_violations, control_chain, control_targets, visible_events, content_hash,
        token_upper_bound, budget_thresholds, limit_status, edge_adjacent, edge_reply, preceding_assistant, recent_suffix, turn_pairing,
        pending_units, stale_sessions, clauses, clause_offsets, nonassertive, normalize_answer, passages, turn_pool_status,
    )
}
ORACLES = {
    "events_derive": f"with {M_} select event_id, session_id, sequence, role, status, sha256(content) content_sha256 from m",
    "session_list": f"with {T_}, {R_} select session_id, max(updated_at) updated_at, count(*) n_turns from t where session_id not in (select target_id from hid where target_kind = 'session') group by 1",
    "session_prefix": "select left(session_id, 6) prefix, count(distinct session_id) n_matches, case when count(distinct session_id) = 1 then min(session_id) end session_id from turns group by 1",
    "session_title": rf"with {T_}, f as (select session_id, trim(regexp_replace(arg_min(user_content, (created_at, id)), '\s+', ' ', 'g')) c from t group by 1) select session_id, case when length(c) > 40 then c[1:40] || '…' else c end title from f",
    "eligible_turns": f"with {T_} select id, session_id, status from t where status in ('complete', 'truncated') and assistant_content <> ''",
    "turns_recovered": f"with {T_} select id, case when status = 'pending' then 'interrupted' else status end status from t",
    "retryable_errors": rf"with {T_} select error, regexp_matches(error, '(?i)connection|stream|timed out|\b(408|429|500|502|503|504)\b') retryable, count(*) n from t where error is not null group by 1, 2",
    "usage_rollup": f"with {T_}, k as (select *, usage.input_tokens is not null and usage.output_tokens is not null known from t) select session_id, count(*) n_turns, count(*) filter (known) n_known, sum(usage.input_tokens) filter (known)::bigint input_tokens, sum(usage.output_tokens) filter (known)::bigint output_tokens, sum(usage.input_tokens + usage.output_tokens) filter (known)::bigint total_tokens from k group by 1",
    "append_only_violations": "with x as (select distinct id, updated_at, status, user_content, created_at, assistant_content, status in ('complete', 'truncated', 'failed', 'interrupted', 'no_answer', 'blocked') fin from turns), y as (select *, lag(user_content) over w lu, lag(created_at) over w lc, lag(assistant_content) over w la, lag(status) over w ls, lag(fin) over w lf, row_number() over w k from x window w as (partition by id order by updated_at, status)), z as (select id, updated_at, case when lu is distinct from user_content or lc is distinct from created_at then 'rewritten' when lf and (la is distinct from assistant_content or ls is distinct from status) then 'changed_after_end' end violation from y where k > 1) select * from z where violation is not null",
    "control_state": f"with {R_} select * from st",
    "control_violations": f"with {R_}, x as (select *, coalesce(lag(action) over (partition by store_id, target_kind, target_id order by sequence, record_sha256), 'restore') b from r) select store_id, target_kind, target_id, sequence, action from x where b = action",
    "control_chain": f"with {R_}, x as (select *, lag(sequence) over w ls, lag(record_sha256) over w lh from r window w as (partition by store_id order by sequence, record_sha256)), y as (select store_id, sequence, record_sha256, case when lh is distinct from previous_record_sha256 then 'previous_hash' when sequence <> coalesce(ls, 0) + 1 then 'sequence_gap' end fault from x) select * from y where fault is not null",
    "control_targets": f"with {R_}, e as (select event_id, min((session_id, content_sha256)) e from boundary_inputs where event_id is not null group by 1) select record_sha256, case when event_id is null then 'missing' when e[1] <> target_session_id then 'other_session' when e[2] <> target_content_sha256 then 'other_content' else 'bound' end binding from r left join e on target_id = event_id where target_kind = 'event'",
    "visible_events": f"with {R_} select distinct event_id, session_id from boundary_inputs where event_id is not null and session_id is not null and session_id not in (select target_id from hid where target_kind = 'session') and event_id not in (select target_id from hid where target_kind = 'event')",
    "content_hash": "with e as (select distinct event_id, content_sha256, sha256(content) computed from boundary_inputs) select content_sha256 = computed equal, count(*) n from e group by 1",
    "token_upper_bound": f"{UB_} select * from ub",
    "budget_thresholds": f"{UB_} select session_id, {INPUT} input_budget, {int(INPUT * WARN)} warn_at, {int(INPUT * TRIM)} trim_to, upper_bound / {INPUT} ratio from ub",
    "limit_status": f"{UB_} select session_id, case when upper_bound > {INPUT} then 'limit' when upper_bound >= {int(INPUT * WARN)} then 'warning' else 'ready' end limit_status from ub",
    "edge_adjacent": f"with {M_}, x as (select *, lead(event_id) over (partition by session_id order by sequence) nx from m where regexp_matches(content, '[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}]')) select event_id src, nx dst, 1.0::double weight from x where nx is not null",
    "edge_reply": f"with {M_}, x as (select *, lag(event_id) over (partition by session_id order by sequence) b from m) select event_id src, b dst, 1.0::double weight from x where b is not null",
    "preceding_assistant": f"with {M_}, x as (select *, lag(event_id) over w b, lag(role) over w br from m window w as (partition by session_id order by sequence)) select event_id, case when br = 'assistant' then b end assistant_event_id from x where role = 'user'",
    "recent_suffix": f"with {M_}, x as (select *, sum(strlen(content) + strlen(role) + 64) over (partition by session_id order by sequence desc) run from m) select session_id, event_id, sequence from x where run <= {SUFFIX_BUDGET}",
    "turn_pairing": "with s as (select s.external_id, min(s.messages) ms from (select unnest(sessions) s from eval_cases) group by 1), m as (select external_id, unnest(range(len(ms)))::int pos, unnest(ms).role role from s where external_id is not null), x as (select *, case when role = 'assistant' and lag(role) over w = 'user' then 0 else 1 end b from m window w as (partition by external_id order by pos)), y as (select *, sum(b) over (partition by external_id order by pos)::bigint turn from x) select external_id, turn, min(pos) first_pos, count(*) n_messages, max((role = 'user')::int) has_user from y group by 1, 2",
    "pending_units": "with e as (select session_id, event_id, min(sequence) sequence from boundary_inputs where event_id is not null and session_id is not null and sequence > watermark_before group by 1, 2), o as (select *, (row_number() over (partition by session_id order by sequence, event_id) - 1) // 16 batch from e) select session_id, batch, count(*) n, min(sequence) from_sequence, max(sequence) through_sequence from o group by 1, 2",
    "stale_sessions": "with b as (select session_id, max(watermark_before) w, max(sequence) l from boundary_inputs where session_id is not null group by 1) select session_id, l - coalesce(w, 0) lag from b where w is null or l > w",
    "clauses": rf"with {C_}, x as (select content_sha256, regexp_extract_all(content, '[^.。!！?？;；\r\n]*[.。!！?？;；\r\n]|[^.。!！?？;；\r\n]+$') a from c), y as (select content_sha256, unnest(range(len(a))) i, a from x), z as (select content_sha256, a[i + 1] raw, coalesce(list_sum(list_transform(a[1:i], lambda v: length(v))), 0) b from y), t as (select content_sha256, raw, b, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') clause from z) select content_sha256, (b + length(raw) - length(regexp_replace(raw, '^\s+', '')))::int start_char, (b + length(raw) - length(regexp_replace(raw, '^\s+', '')) + length(clause))::int end_char, sha256(clause) clause_sha256 from t where clause <> ''",
    "clause_offsets": "with c as (select distinct * exclude (span_id) from source_clauses where clause_id is not null), e as (select event_id, min(content) content from boundary_inputs where event_id is not null group by 1), x as (select distinct clause_id, case when content is null then 'unknown_event' when start_char < 0 or end_char > length(content) or end_char <= start_char then 'out_of_range' when substr(content, start_char + 1, end_char - start_char) <> text then 'other_text' end fault from c left join e using (event_id)) select * from x where fault is not null",
    "nonassertive": rf"with c as (select distinct clause_id, trim(lower(text)) t from source_clauses where clause_id is not null) select clause_id, regexp_replace(t, '[.。!！?？;；,，\s]+$', '') in {T.GREETINGS!r} or (regexp_matches(t, '[?？]$') and not regexp_matches(regexp_replace(t, '[?？]+$', ''), '[,，、.。;；!！?？]')) nonassertive from c",
    "normalize_answer": r"with c as (select id, min(expected_answer) a from eval_cases where id is not null group by 1) select id, case when a is null then null else array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(a), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+'), lambda w: w not in ('a', 'an', 'the', '')), ' ') end answer from c",
    "passages": f"with c as (select revision_id, min(content) content from knowledge_snapshots where content is not null and revision_id is not null group by 1), x as (select *, length(content) - {T.WINDOW} l from c where length(content) > {T.WINDOW}), y as (select revision_id, content, unnest(list_append(list_filter(range(0, l + 1, {T.STEP}), lambda v: v < l), l))::int start_char from x) select revision_id, start_char, start_char + {T.WINDOW} end_char, sha256(substr(content, start_char + 1, {T.WINDOW})) span_sha256 from y",
    "turn_pool_status": f"with {T_} select session_id, case when bool_or(status = 'interrupted') then 'cancelled' when bool_and(status = 'complete') then 'completed' when bool_or(status = 'complete') then 'partial' else 'failed' end stage_status from t group by 1",
}
