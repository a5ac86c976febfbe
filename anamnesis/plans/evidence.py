"""Selection, visibility, provenance and assembly of evidence: survey sections 2.3 to 2.8 and 2.10 to 2.12."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import control, graph, turns
from anamnesis.operators.ordered import neighbours
from anamnesis.plans import conversation as C
from anamnesis.plans import evaluation as E
from anamnesis.plans import recall as R
from anamnesis.plans.episodes import EVENTS_, RUNS_
from anamnesis.session import cut
from anamnesis.sources.tables import table

#: Fixed values of the reference: documents and characters of knowledge, messages and characters of conversation.
KNOWLEDGE_ITEMS, KNOWLEDGE_CHARS, CORE_ITEMS, CORE_CHARS = 4, 3200, 4, 1600
#: Entities of a session that are shown, sessions of the newest list, results of a mask.
ENTITIES, NEWEST, MASKED = 12, 50, 10
SYSTEM_SIZE = 256
#: Beginnings of session ids that are asked for, and names shown for an ambiguous one.
PREFIXES, SHOWN = (5, 6, 8), 5
#: A clause longer than HALF characters is halved; without a weak mark the halves share OVERLAP characters.
HALF, OVERLAP = 64, 32
MASKS = {"text": ("text",), "title": ("title",), "full": ("text", "title")}
#: Gap states that a review asks about.
ASKED_REASONS = ("invalid_or_out_of_order", "missing_timestamp")
_SEP = "\u001f"


def kb_select(s, d):
    """The candidates of every question in the order of their ranks, and why each is taken or not.

    A greedy scan with state: one fold over a question's own candidates, of which there are at most R.TOP.
    """
    key = F.concat_ws(_SEP, F.coalesce("source_id", F.lit("")), F.coalesce("document_key", F.lit("")))
    docs = table(s, d, "documents").select("doc_id", key.alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.char_length("text").alias("n"))
    c = R.kb_bm25(s, d).join(docs, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "key", "hash", "n"))).alias("all"))
    texts, kind = F.array().cast("array<string>"), "array<struct<doc_id:bigint,rank:int,reason:string>>"

    def step(state, x):
        reason = (
            F.when(F.array_contains(state["keys"], x["key"]), "duplicate_document")
            .when(F.array_contains(state["hashes"], x["hash"]), "duplicate_content")
            .when(F.size(state["keys"]) >= KNOWLEDGE_ITEMS, "selection_limit")
            .when(state["used"] + x["n"] > KNOWLEDGE_CHARS, "evidence_budget")
            .otherwise("selected_core")
        )
        taken = reason == "selected_core"
        more = lambda held, value: F.when(taken, F.concat(state[held], F.array(x[value]))).otherwise(state[held])
        said = F.struct(x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), reason.alias("reason"))
        return F.struct((state["used"] + F.when(taken, x["n"]).otherwise(0)).alias("used"), more("keys", "key").alias("keys"), more("hashes", "hash").alias("hashes"), F.concat(state["out"], F.array(said)).alias("out"))

    zero = F.struct(F.lit(0).alias("used"), texts.alias("keys"), texts.alias("hashes"), F.array().cast(kind).alias("out"))
    return c.select("query_id", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("query_id", "x.*")


def evidence_blocks(s, d):
    """The header lines of each question's selected documents, as one hash of the whole."""
    got = kb_select(s, d).where("reason = 'selected_core'").join(table(s, d, "documents").select("doc_id", "title"), "doc_id")
    one = got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title"))).alias("a"))
    lines = F.transform("a", lambda x, i: F.concat(F.lit("[K"), (i + 1).cast("string"), F.lit("] "), x["doc_id"].cast("string"), F.lit(" "), F.coalesce(x["title"], F.lit(""))))
    return one.select("query_id", F.size("a").alias("n_blocks"), F.sha2(F.array_join(lines, "\n"), 256).alias("blocks_sha256"))


def channel_masks(s, d):
    """Fused results of every question under each set of channels."""
    held = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(c).alias("channel")) for m, cs in MASKS.items() for c in cs])
    masks = s.range(1).select(F.explode(held).alias("x")).select("x.*")
    f = R._channels(s, d).join(F.broadcast(masks), "channel").groupBy("mask", "query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("mask", "query_id").orderBy(F.desc("score"), "doc_id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MASKED)


def evidence_exclusions(s, d):
    """Message candidates of every question: kept, in a session's recent history, or a text that a better candidate has."""
    recent = C.recent_suffix(s, d).select("event_id", F.lit(True).alias("recent"))
    m = turns.messages(table(s, d, "turns")).select("event_id", F.sha2("content", 256).alias("hash"))
    c = R.conv_bm25(s, d).join(m, "event_id").join(recent, "event_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "hash").orderBy("rank")) == 1
    state = F.when(F.col("recent"), "recent").when(~first, "duplicate").otherwise("kept")
    return c.select("query_id", "event_id", "rank", state.alias("state"))


def fragment_weights(s, d):
    """Windows of every long message and the characters that each covers first, which are its weight."""
    m = turns.messages(table(s, d, "turns")).select("event_id", T.window_starts(F.char_length("content")).alias("a")).where("a is not null")
    end = lambda x: x + T.WINDOW
    covered = F.transform("a", lambda x, i: F.struct(x.alias("start_char"), F.when(i == 0, F.lit(T.WINDOW)).otherwise(end(x) - F.greatest(x, end(F.element_at("a", F.greatest(i, F.lit(1)))))).alias("weight")))
    return m.select("event_id", F.explode(covered).alias("x")).select("event_id", "x.*")


def episode_members(s, d):
    """Episodes, their events and the content each had."""
    e = table(s, d, "boundary_inputs").where("event_id is not null").groupBy("event_id").agg(F.min("content_sha256").alias("content_sha256"))
    return R._episode_members(s, d).select(F.col("src").alias("episode"), F.col("dst").alias("event_id")).join(e, "event_id")


def edge_mention(s, d):
    """Messages and the entities that they name, by how often."""
    m = turns.messages(table(s, d, "turns")).select(F.col("event_id").alias("key"), F.explode(F.regexp_extract_all("content", F.lit(r"[A-Z][a-z]{4,}"), F.lit(0))).alias("term"))
    kept = graph.shared(R._entities(s, d)).select("term").distinct()
    return m.join(kept, "term", "left_semi").groupBy(F.col("key").alias("src"), F.col("term").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _user_events(s, d) -> DataFrame:
    """Events with the claim that they support: the first event of the user's run of one type."""
    e = table(s, d, "events").where("user_id is not null and event_type is not null and ts is not null").select("event_id", "user_id", "event_type", "ts")
    day, order = F.unix_date(F.to_date("ts")), ["ts", "event_id"]
    n = neighbours(e, ["user_id"], day, order, F.col("event_type"))
    own = F.when(F.col("value_before").isNull() | (F.col("value_before") != F.col("event_type")), F.col("event_id"))
    n = n.select("event_id", "user_id", "event_type", "ts", own.alias("own"))
    return neighbours(n, ["user_id"], day, order, F.col("own")).select("event_id", "user_id", "event_type", "ts", F.coalesce("own", "value_before").alias("claim"), F.col("value_after").alias("next"))


def edge_claims(s, d):
    """What supports a claim, what replaced it, and claims of one user that begin at one instant."""
    e = cut(_user_events(s, d))
    claims = e.where("event_id = claim")
    start = claims.select(F.col("event_id").alias("next"), F.col("ts").alias("next_ts"))
    moved = claims.join(start, "next").select(F.when(F.col("ts") == F.col("next_ts"), "conflict").otherwise("replacement").alias("kind"), F.col("claim").alias("src"), F.col("next").alias("dst"))
    return e.select(F.lit("support").alias("kind"), F.col("event_id").alias("src"), F.col("claim").alias("dst")).unionByName(moved)


def edge_corecall(s, d):
    """Pieces of evidence that the same cases name, and how many cases. A case's list is one value of the input."""
    c = E._cases(s, d).select("id", F.array_sort(F.array_distinct("gold_evidence")).alias("a")).select("id", "a", F.posexplode("a").alias("i", "src"))
    p = c.select("id", "src", F.explode(F.slice("a", F.col("i") + 2, F.greatest(F.size("a") - F.col("i") - 1, F.lit(0)))).alias("dst"))
    return p.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_cases"))


def node_visible(s, d):
    """nodes of each kind, and those that existed at the cutoff."""
    m = turns.messages(table(s, d, "turns")).select(F.col("event_id").alias("key"), "created_at")
    named = graph.shared(R._entities(s, d)).join(m, "key").groupBy("term").agg(F.min("created_at").alias("created_at"))
    claims = R._claims(s, d).select(F.date_format("valid_from", "yyyy-MM-dd").alias("created_at"))
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), (F.col("created_at") <= R.CUTOFF).alias("seen"))
    return of(m, "message").unionByName(of(named, "entity")).unionByName(of(claims, "claim")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("seen").alias("n_visible"))


def edge_visible(s, d):
    """edges between messages of each kind, and those whose both ends existed at the cutoff."""
    m = turns.messages(table(s, d, "turns")).select("event_id", (F.col("created_at") <= R.CUTOFF).alias("seen"))
    e = graph.folded(R._message_edges(s, d))
    end = lambda c: m.select(F.col("event_id").alias(c), F.col("seen").alias(f"{c}_seen"))
    return e.join(end("src"), "src").join(end("dst"), "dst").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src_seen") & F.col("dst_seen")).alias("n_visible"))


def scope_nodes(s, d):
    """F8: a session's own messages, and the entities, which every session may see."""
    m = turns.messages(table(s, d, "turns")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_own"))
    n = graph.shared(R._entities(s, d)).agg(F.countDistinct("term").alias("n_entities"))  # one row
    return m.join(F.broadcast(n))


def prefix_validity(s, d):
    """Whether what was organised of a session, up to its watermark, still holds."""
    b = table(s, d, "boundary_inputs").where("event_id is not null and session_id is not null")
    mark = b.groupBy("session_id").agg(F.max("watermark_before").alias("watermark"))
    e = b.groupBy("session_id", "event_id").agg(F.min("sequence").alias("sequence"), F.min("content_sha256").alias("h"), F.min("content").alias("c"))
    inside = F.col("sequence") <= F.col("watermark")
    n = e.join(mark, "session_id").groupBy("session_id").agg(
        F.max("watermark").alias("watermark"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_beyond"), F.count_if(inside & (F.col("h") != F.sha2("c", 256))).alias("n_changed")
    )
    return n.withColumn("state", F.when(F.col("watermark").isNull(), "missing").when(F.col("n_changed") > 0, "changed").when(F.col("n_beyond") > 0, "stale").otherwise("valid"))


def sequence_duplicates(s, d):
    """Sequence numbers of a session that more than one event has."""
    b = table(s, d, "boundary_inputs").where("event_id is not null and session_id is not null and sequence is not null")
    return b.groupBy("session_id", "sequence").agg(F.countDistinct("event_id").alias("n_events")).where("n_events > 1")


def configured_revisions(s, d):
    """revisions whose source is still enabled with the same kind and location."""
    last = F.max_by(F.struct("enabled", "kind", "location"), F.struct("last_sync_at", "delivered_at")).alias("x")
    now = table(s, d, "source_states").where("source_id is not null").groupBy("source_id").agg(last).where("x.enabled")
    now = now.select("source_id", F.col("x.kind").alias("source_kind"), F.col("x.location").alias("configured_location"))
    k = table(s, d, "knowledge_snapshots").where("revision_id is not null").select("revision_id", "source_id", "source_kind", "configured_location").distinct()
    return k.join(now, ["source_id", "source_kind", "configured_location"], "left_semi").select("revision_id").distinct()


def active_range(s, d):
    """Each session's active turns, from the first that its recent history holds, and the eligible ones that it omits."""
    n = turns.numbered(table(s, d, "turns")).select("session_id", "turn_no", (F.col("status").isin("complete", "truncated") & (F.col("assistant_content") != "")).alias("ok"))
    start = C.recent_suffix(s, d).groupBy("session_id").agg(F.floor((F.min("sequence") - 1) / 2).alias("start"))
    inside = F.col("turn_no") >= F.col("start")
    return n.join(start, "session_id").groupBy("session_id").agg(
        F.max("start").alias("start"), F.count_if(F.col("ok") & inside).alias("n_active"), F.count_if(F.col("ok") & ~inside).alias("n_omitted")
    )


def gold_resolution(s, d):
    """A case's gold evidence that its sessions hold, and that they lack."""
    held = E._ranking(s, d).select("id", "evidence", F.lit(True).alias("there"))
    g = E._cases(s, d).select("id", F.explode(F.array_distinct("gold_evidence")).alias("evidence"))
    return g.join(held, ["id", "evidence"], "left").groupBy("id").agg(F.count("there").alias("n_resolved"), F.count_if(F.col("there").isNull()).alias("n_unresolved"))


def decision_reasons(s, d):
    """U8: of all recorded decisions of an event the reasons that a review asks about, each once."""
    b = table(s, d, "boundary_decisions").where(F.col("before_event_id").isNotNull() & F.col("gap").isin(*ASKED_REASONS))
    return b.groupBy(F.col("before_event_id").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_set("gap")), ",").alias("reasons"))


def assistant_contexts(s, d):
    """Assistant messages that stand before a user message or are replied to, each once."""
    a = C.preceding_assistant(s, d).select(F.col("assistant_event_id").alias("event_id"))
    b = C.edge_reply(s, d).where("dst like '%:assistant'").select(F.col("dst").alias("event_id"))
    return a.unionByName(b).where("event_id is not null").dropDuplicates(["event_id"])


def entity_order(s, d):
    """A session's entities: those of its last message first, then by their first use; the first twelve."""
    m = turns.messages(table(s, d, "turns")).select(F.col("event_id").alias("key"), "session_id", "sequence")
    last = m.groupBy("session_id").agg(F.max("sequence").alias("last"))
    e = graph.shared(R._entities(s, d)).join(m, "key").join(last, "session_id")
    by = e.groupBy("session_id", "term").agg(F.min("sequence").alias("first"), F.bool_or(F.col("sequence") == F.col("last")).alias("matched"))
    w = Window.partitionBy("session_id").orderBy(F.desc("matched"), "first", "term")
    return by.withColumn("place", F.row_number().over(w)).where(F.col("place") <= ENTITIES).select("session_id", "term", "place", "matched")


def newest_sessions(s, d):
    """The newest sessions, by their latest change, then by id."""
    by = turns.last_states(table(s, d, "turns")).groupBy("session_id").agg(F.max("updated_at").alias("updated_at"))
    return by.orderBy(F.desc("updated_at"), "session_id").limit(NEWEST)


def cache_split(s, d):
    """Messages whose content was embedded before, as the boundary inputs hold its hash, and the misses; places are kept."""
    known = table(s, d, "boundary_inputs").where("content_sha256 is not null").select(F.col("content_sha256").alias("hash")).distinct().withColumn("hit", F.lit(True))
    m = turns.messages(table(s, d, "turns")).select("event_id", "session_id", "sequence", F.sha2("content", 256).alias("hash"))
    return m.join(known, "hash", "left").select("event_id", "session_id", "sequence", F.coalesce("hit", F.lit(False)).alias("hit"))


def evidence_sessions(s, d):
    """External ids of evidence and the sessions that they come from."""
    m = table(s, d, "eval_cases").select(F.explode("sessions").alias("s")).select(F.col("s.external_id").alias("session"), F.explode("s.messages").alias("m"))
    e = m.select("session", F.col("m.evidence.external_id").alias("evidence"), F.col("m.evidence.source_session_id").alias("source")).where("evidence is not null").distinct()
    return e.groupBy("evidence").agg(F.count(F.lit(1)).alias("n_places"), F.bool_and(F.col("session").eqNullSafe(F.col("source"))).alias("agrees"))


def clause_names(s, d):
    """Names that clauses hold, of those that the messages share. Names are looked up, so no text meets every name."""
    kept = graph.shared(R._entities(s, d)).select("term").distinct()
    c = table(s, d, "source_clauses").where("clause_id is not null and text is not null").select("clause_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{4,}"), F.lit(0)))).alias("term"))
    return c.join(kept, "term", "left_semi").select("clause_id", "term").distinct()


def clause_split(s, d):
    """Both halves of every long clause: after the weak mark nearest to its middle, else overlapping."""
    c = table(s, d, "source_clauses").where(F.col("clause_id").isNotNull() & (F.char_length("text") > HALF)).groupBy("clause_id").agg(F.min("text").alias("text"))
    n = F.char_length("text")
    mid = F.floor(n / 2).cast("int")
    marks = F.filter(F.transform(F.split("text", ""), lambda x, i: F.when(x.isin(*",，、:："), i + 1)), lambda x: x.isNotNull() & (x < n))
    near = F.array_min(F.transform(marks, lambda x: F.struct(F.abs(x - mid).alias("off"), x.alias("at"))))["at"]
    c = c.select("clause_id", n.alias("n"), mid.alias("mid"), near.alias("near"))
    half = F.array(
        F.struct(F.lit(0).alias("start_char"), F.coalesce("near", F.col("mid") + OVERLAP // 2).alias("end_char")),
        F.struct(F.coalesce("near", F.col("mid") - OVERLAP // 2).alias("start_char"), F.col("n").alias("end_char")),
    )
    return c.select("clause_id", F.posexplode(half).alias("part", "x")).select("clause_id", "part", "x.*")


def plan_tokens(s, d):
    """A turn's tokens: as counted, else estimated as a third of its bytes."""
    u = F.col("usage")
    exact = F.coalesce(u["total_tokens"], u["input_tokens"] + u["output_tokens"])
    guess = F.ceil((F.octet_length(F.coalesce("user_content", F.lit(""))) + F.octet_length(F.coalesce("assistant_content", F.lit("")))) / 3).cast("bigint")
    return turns.last_states(table(s, d, "turns")).select("id", F.coalesce(exact, guess).alias("tokens"), exact.isNotNull().alias("exact"))


def canonical_hash(s, d):
    """One hash of each revision's record: a tag, a presence byte before every optional value, a count before the list."""
    maybe = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string"))), F.lit(_SEP))
    links = F.array_sort(F.coalesce("links", F.array().cast("array<string>")))
    whole = F.concat(F.lit(f"revision:v1{_SEP}"), *[maybe(c) for c in ("revision_id", "source_id", "document_key", "title", "content")], F.size(links).cast("string"), F.lit(_SEP), F.array_join(links, _SEP))
    k = table(s, d, "knowledge_snapshots").where("revision_id is not null")
    return k.groupBy("revision_id").agg(F.min(F.sha2(whole, 256)).alias("record_sha256"), F.countDistinct(F.sha2(whole, 256)).alias("n_forms"))


def row_digest(s, d):
    """One digest of a session's messages, whatever their order: their hashes' first 60 bits, combined."""
    m = turns.messages(table(s, d, "turns"))
    bits = F.conv(F.substring(F.sha2(F.concat_ws(_SEP, "event_id", F.col("sequence").cast("string"), "role", "content"), 256), 1, 15), 16, 10).cast("bigint")
    return m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bits).alias("digest"))


def delta_merge(s, d):
    """Clauses of an event that say the same at the same place as one, numbered anew, with what they were called."""
    c = table(s, d, "source_clauses").where("clause_id is not null and event_id is not null").select("event_id", "start_char", "end_char", F.sha2("text", 256).alias("h"), "clause_id").distinct()
    one = c.groupBy("event_id", "start_char", "end_char", "h").agg(F.count(F.lit(1)).alias("n_merged"), F.sha2(F.array_join(F.array_sort(F.collect_list("clause_id")), ","), 256).alias("ids_sha256"))
    w = Window.partitionBy("event_id").orderBy("start_char", "end_char", "h")
    return one.select("event_id", F.row_number().over(w).alias("local_id"), "start_char", "end_char", "n_merged", "ids_sha256")


def memory_status(s, d):
    """What the memory holds: turns by status, messages, sessions, vectors, and how long turns took."""
    t = turns.last_states(table(s, d, "turns"))
    row = lambda df, name, value: df.select(name.alias("metric"), value.cast("double").alias("value"))
    n = F.count(F.lit(1))
    by = row(t.groupBy("status").agg(n.alias("n")), F.concat(F.lit("turns_"), F.coalesce("status", F.lit("unknown"))), F.col("n"))
    sessions = row(t.agg(F.countDistinct("session_id").alias("n")), F.lit("sessions"), F.col("n"))
    messages = row(turns.messages(table(s, d, "turns")).agg(n.alias("n")), F.lit("messages"), F.col("n"))
    vectors = row(table(s, d, "embeddings").agg(F.count("embedding").alias("n")), F.lit("vectors"), F.col("n"))
    took = t.where("status = 'complete'").select(F.lit(0).alias("all"), ((F.unix_millis(F.to_timestamp("updated_at")) - F.unix_millis(F.to_timestamp("created_at"))) / 1000.0).alias("v"))
    p = E.percentiles(took, ["all"], "v", {"p50": 0.5, "p95": 0.95})
    spent = p.select(F.explode(F.array(*[F.struct(F.lit(f"seconds_{x}").alias("metric"), F.col(x).alias("value")) for x in ("p50", "p95")])).alias("x")).select("x.*")
    return by.unionByName(sessions).unionByName(messages).unionByName(vectors).unionByName(spent)


def evidence_caps(s, d):
    """B2: what budget_pack takes, under the hard caps on items and characters, by bucket and rank; one fold over a case."""
    b = E.budget_pack(s, d).where("state in ('selected', 'reflowed')").withColumn("b", F.array_position(F.array(*[F.lit(x) for x in E.BUCKETS]), F.col("bucket")))
    one = b.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("b", "rank", "evidence", "size"))).alias("all"))
    kind = "array<struct<evidence:string,kept:boolean>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def step(state, x):
        kept = (state["n"] < CORE_ITEMS) & (state["used"] + x["size"] <= CORE_CHARS)
        said = F.array(F.struct(x["evidence"].alias("evidence"), kept.alias("kept")))
        return F.struct((state["used"] + F.when(kept, x["size"]).otherwise(0)).alias("used"), (state["n"] + kept.cast("int")).alias("n"), F.concat(state["out"], said).alias("out"))

    return one.select("id", F.explode(F.aggregate("all", zero, step)["out"]).alias("x")).select("id", "x.*")


def context_plan(s, d):
    """The parts of every case's context in their order, with their sizes in bytes, or in characters for knowledge."""
    chars = kb_select(s, d).where("reason = 'selected_core'").join(table(s, d, "documents").select("doc_id", F.char_length("text").alias("n")), "doc_id")
    knowledge = chars.groupBy(F.col("query_id").alias("id")).agg(F.sum("n").alias("knowledge"))
    taken = E.budget_pack(s, d).where("state in ('selected', 'reflowed')").groupBy("id").agg(
        F.sum(F.when(F.col("bucket") != "recent_history", F.col("size"))).alias("evidence"), F.sum(F.when(F.col("bucket") == "recent_history", F.col("size"))).alias("history")
    )
    c = E._cases(s, d).select("id", F.octet_length("question").alias("current")).join(knowledge, "id", "left").join(taken, "id", "left")
    parts = F.array(*[F.struct(F.lit(i).alias("part_no"), F.lit(p).alias("part"), F.coalesce(v.cast("bigint"), F.lit(0)).alias("size")) for i, (p, v) in enumerate((("system", F.lit(SYSTEM_SIZE)), ("knowledge", F.col("knowledge")), ("evidence", F.col("evidence")), ("history", F.col("history")), ("current", F.col("current"))), 1)])
    return c.select("id", F.explode(parts).alias("x")).select("id", "x.*")


def session_resolve(s, d):
    """S3: what the beginnings of session ids, of 5, 6, 8 and all characters, resolve to: exact, unique or ambiguous, with up to five names."""
    ids = table(s, d, "turns").where("session_id is not null").select("session_id").distinct()
    cuts = F.array(*[F.substring("session_id", 1, n) for n in PREFIXES], F.col("session_id"))
    asked = ids.select("session_id", F.explode(F.array_distinct(cuts)).alias("asked"))
    w = Window.partitionBy("asked").orderBy("session_id")
    shown = asked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SHOWN)
    names = shown.groupBy("asked").agg(F.array_join(F.array_sort(F.collect_list("session_id")), ",").alias("names"))
    n = asked.groupBy("asked").agg(F.count(F.lit(1)).alias("n_matches"), F.bool_or(F.col("asked") == F.col("session_id")).alias("exact"))
    kind = F.when(F.col("exact"), "exact").when(F.col("n_matches") == 1, "unique").otherwise("ambiguous")
    return n.join(names, "asked").select("asked", kind.alias("kind"), "n_matches", "names")


def source_last_good(s, d):
    """K4, K5: each source's last good sync, which stays in force after failed ones, and how many failed after it."""
    rows = table(s, d, "source_states").where("sync_id is not null and source_id is not null")
    held = F.struct("delivered_at", "source_id", "enabled", "last_sync_at", "last_success_at", F.size("active_revisions").alias("n"))
    last = rows.groupBy("sync_id").agg(F.max(held).alias("r")).select("sync_id", "r.*")
    good = F.col("enabled") & (F.col("last_success_at") == F.col("last_sync_at"))
    by = last.groupBy("source_id").agg(
        F.max(F.when(good, F.struct("last_sync_at", "sync_id", "n"))).alias("g"), F.max_by("enabled", F.struct("last_sync_at", "sync_id")).alias("enabled_now"), F.count(F.lit(1)).alias("n_syncs")
    )
    after = last.join(by.select("source_id", F.col("g.last_sync_at").alias("since")), "source_id").where(~F.coalesce(good, F.lit(False)) & (F.col("since").isNull() | (F.col("last_sync_at") > F.col("since"))))
    n = after.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_failed_after"))
    return by.join(n, "source_id", "left").select("source_id", "n_syncs", "enabled_now", F.col("g.sync_id").alias("good_sync"), F.col("g.n").alias("n_active"), F.coalesce("n_failed_after", F.lit(0)).alias("n_failed_after"))


def edge_provenance(s, d):
    """A1: what every edge of shared entities rests on: the names, in order. A pair shares at most the names of one message."""
    kept = graph.shared(R._entities(s, d))
    a, b = kept.select(F.col("key").alias("src"), "term"), kept.select(F.col("key").alias("dst"), "term")
    met = a.join(b, "term").where("src < dst").groupBy("src", "dst")
    return met.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


def stage_status(s, d):
    """A session's state from its stages, facts (its events' clauses) and boundaries (their decisions).

    A stage is up to date if all events are done, completed if those up to the watermark are. An
    excluded session is cancelled; else all, some or no stages decide.
    """
    b = table(s, d, "boundary_inputs").where("event_id is not null and session_id is not null")
    e = b.groupBy("session_id", "event_id").agg(F.min("sequence").alias("sequence"))
    mark = b.groupBy("session_id").agg(F.max("watermark_before").alias("watermark"))
    done = lambda name, key, out: table(s, d, name).where(F.col(key).isNotNull()).select(F.col(key).alias("event_id")).distinct().withColumn(out, F.lit(True))
    e = e.join(mark, "session_id").join(done("source_clauses", "event_id", "fact"), "event_id", "left").join(done("boundary_decisions", "before_event_id", "boundary"), "event_id", "left")
    inside = F.coalesce(F.col("sequence") <= F.col("watermark"), F.lit(False))
    left = lambda c, of=F.lit(True): F.count_if(F.col(c).isNull() & of)
    by = e.groupBy("session_id").agg(left("fact").alias("f"), left("fact", inside).alias("fi"), left("boundary").alias("b"), left("boundary", inside).alias("bi"))
    state = lambda every, part: F.when(F.col(every) == 0, "up_to_date").when(F.col(part) == 0, "completed").otherwise("failed")
    gone = control.hidden(table(s, d, "control_records"), "session").select(F.col("target_id").alias("session_id"), F.lit(True).alias("gone"))
    by = by.join(gone, "session_id", "left").select("session_id", state("f", "fi").alias("facts"), state("b", "bi").alias("boundaries"), "gone")
    n = F.when(F.col("facts") != "failed", 1).otherwise(0) + F.when(F.col("boundaries") != "failed", 1).otherwise(0)
    fresh = (F.col("facts") == "up_to_date") & (F.col("boundaries") == "up_to_date")
    whole = F.when(F.col("gone"), "cancelled").when(fresh, "up_to_date").when(n == 2, "completed").when(n == 1, "partial").otherwise("failed")
    return by.select("session_id", "facts", "boundaries", whole.alias("status"))


_KS = f"""{R.KB_.replace('with ', 'with recursive ', 1)},
  kc as (select query_id, rank, doc_id, coalesce(source_id, '') || chr(31) || coalesce(document_key, '') k, sha256(coalesce(text, '')) h, length(text) n from kb join documents using (doc_id)),
  kx as (select query_id, 0::bigint rank, 0::bigint used, []::varchar[] ks, []::varchar[] hs, 'start' reason, null::bigint doc_id from (select distinct query_id from kb)
    union all select query_id, rank, case when reason = 'selected_core' then used + n else used end, case when reason = 'selected_core' then list_append(ks, k) else ks end, case when reason = 'selected_core' then list_append(hs, h) else hs end, reason, doc_id
    from (select kc.*, used, ks, hs, case when list_contains(ks, k) then 'duplicate_document' when list_contains(hs, h) then 'duplicate_content' when len(ks) >= {KNOWLEDGE_ITEMS} then 'selection_limit'
      when used + n > {KNOWLEDGE_CHARS} then 'evidence_budget' else 'selected_core' end reason from kx join kc on kc.query_id = kx.query_id and kc.rank = kx.rank + 1)),
  ks as (select query_id, doc_id, rank, reason from kx where rank > 0)"""
_NAME = "[A-Z][a-z]{4,}"
_CREATED = "mc as (select m.*, created_at from m join t on split_part(event_id, ':', 1) = t.id)"
_RECENT = f"rs as (select session_id, event_id, sequence from (select *, sum(strlen(content) + strlen(role) + 64) over (partition by session_id order by sequence desc) run from m) where run <= {C.SUFFIX_BUDGET})"
_UE = """ue as (select *, event_type is distinct from lag(event_type) over w own from (select event_id, user_id, event_type, ts from events where user_id is not null and event_type is not null and ts is not null) window w as (partition by user_id order by ts, event_id)),
  ur as (select *, sum(own::int) over (partition by user_id order by ts, event_id) run from ue),
  uc as (select *, first_value(event_id) over (partition by user_id, run order by ts, event_id) claim from ur),
  ul as (select *, lead(claim) over w nx, lead(ts) over w nt from uc where own window w as (partition by user_id order by ts, event_id))"""
_BP = E.BP_ + ", bt as (select id, evidence, bucket, b, rank, size from bs left join bg using (id, evidence) where taken or late)"

QUERIES = {
    f.__name__: f
    for f in (
        kb_select, evidence_blocks, channel_masks, evidence_exclusions, fragment_weights, episode_members, edge_mention, edge_claims, edge_corecall,
        node_visible, edge_visible, scope_nodes, prefix_validity, sequence_duplicates, configured_revisions, active_range, gold_resolution,
        decision_reasons, assistant_contexts, entity_order, newest_sessions, cache_split, evidence_sessions, clause_names, clause_split,
        plan_tokens, canonical_hash, row_digest, delta_merge, memory_status, evidence_caps, context_plan,
        session_resolve, source_last_good, edge_provenance, stage_status,
    )
}
_NEAR = "list_sort(list_transform(list_filter(range(1, length(text)), lambda i: text[i] in (',', '，', '、', ':', '：')), lambda i: {'off': abs(i - length(text) // 2), 'at': i}))"
_MAYBE = " || ".join(f"case when {c} is null then '0' else '1' || {c} end || chr(31)" for c in ("revision_id", "source_id", "document_key", "title", "content"))
ORACLES = {
    "kb_select": f"{_KS} select * from ks",
    "evidence_blocks": f"{_KS}, x as (select query_id, row_number() over (partition by query_id order by rank) i, doc_id, title from ks join documents using (doc_id) where reason = 'selected_core') select query_id, count(*)::int n_blocks, sha256(string_agg('[K' || i || '] ' || doc_id || ' ' || coalesce(title, ''), chr(10) order by i)) blocks_sha256 from x group by 1",
    "channel_masks": f"{R.CH_}, k as (select unnest({[m for m, cs in MASKS.items() for _ in cs]}) mask, unnest({[c for cs in MASKS.values() for c in cs]}) channel), f as (select mask, query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) score from ch join k using (channel) group by 1, 2, 3) select * from (select *, row_number() over (partition by mask, query_id order by score desc, doc_id) rank from f) where rank <= {MASKED}",
    "evidence_exclusions": f"with {C.M_}, {R.Q_}, {R._bm25_sql('(select event_id, content as text from m)', 'event_id')}, {_RECENT}, x as (select kb.*, sha256(content) h, rs.event_id is not null recent from kb join m using (event_id) left join rs using (event_id)) select query_id, event_id, rank, case when recent then 'recent' when row_number() over (partition by query_id, h order by rank) > 1 then 'duplicate' else 'kept' end state from x",
    "fragment_weights": f"with {C.M_}, x as (select event_id, length(content) - {T.WINDOW} l from m where length(content) > {T.WINDOW}), y as (select event_id, unnest(list_append(list_filter(range(0, l + 1, {T.STEP}), lambda v: v < l), l))::int start_char from x) select event_id, start_char, (start_char + {T.WINDOW} - greatest(start_char, coalesce(max(start_char + {T.WINDOW}) over (partition by event_id order by start_char rows between unbounded preceding and 1 preceding), 0)))::int weight from y",
    "episode_members": f"with {EVENTS_}, {RUNS_.format(lim='lim')}, h as (select event_id, min(content_sha256) content_sha256 from boundary_inputs where event_id is not null group by 1) select 'episode:' || first_value(event_id) over (partition by session_id, run order by us, seq, event_id) episode, event_id, content_sha256 from r join h using (event_id)",
    "edge_mention": f"with {R.E_}, x as (select event_id src, unnest(regexp_extract_all(content, '{_NAME}')) dst from m) select src, dst, count(*)::double weight from x where dst in (select term from ek) group by 1, 2",
    "edge_claims": f"with {_UE} select 'support' kind, event_id src, claim dst from uc union all select case when ts = nt then 'conflict' else 'replacement' end, claim, nx from ul where nx is not null",
    "edge_corecall": f"with {E.CA_}, x as (select distinct id, unnest(gold_evidence) e from ca) select a.e src, b.e dst, count(*) n_cases from x a join x b on a.id = b.id and a.e < b.e group by 1, 2",
    "node_visible": f"with {R.E_}, {_CREATED}, {R.CL_}, x as (select 'message' kind, created_at from mc union all select 'entity', min(created_at) from ek join mc on key = event_id group by term union all select 'claim', strftime(valid_from, '%Y-%m-%d') from c) select kind, count(*) n, count(*) filter (created_at <= '{R.CUTOFF}') n_visible from x group by 1",
    "edge_visible": f"with {R.ME_}, {_CREATED}, fo as ({R._FOLD.format('me')}) select kind, count(*) n, count(*) filter (a.created_at <= '{R.CUTOFF}' and b.created_at <= '{R.CUTOFF}') n_visible from fo join mc a on a.event_id = src join mc b on b.event_id = dst group by 1",
    "scope_nodes": f"with {R.E_} select session_id, count(*) n_own, (select count(distinct term) from ek) n_entities from m group by 1",
    "prefix_validity": "with b as (select * from boundary_inputs where event_id is not null and session_id is not null), w as (select session_id, max(watermark_before) watermark from b group by 1), e as (select session_id, event_id, min(sequence) sequence, min(content_sha256) h, min(content) c from b group by 1, 2), n as (select session_id, max(watermark) watermark, count(*) filter (not coalesce(sequence <= watermark, false)) n_beyond, count(*) filter (sequence <= watermark and h <> sha256(c)) n_changed from e join w using (session_id) group by 1) select *, case when watermark is null then 'missing' when n_changed > 0 then 'changed' when n_beyond > 0 then 'stale' else 'valid' end state from n",
    "sequence_duplicates": "select session_id, sequence, count(distinct event_id) n_events from boundary_inputs where event_id is not null and session_id is not null and sequence is not null group by 1, 2 having count(distinct event_id) > 1",
    "configured_revisions": "with l as (select * from (select *, row_number() over (partition by source_id order by last_sync_at desc, delivered_at desc) k from source_states where source_id is not null) where k = 1 and enabled) select distinct revision_id from knowledge_snapshots s where revision_id is not null and exists (select 1 from l where l.source_id = s.source_id and kind = source_kind and location = configured_location)",
    "active_range": f"with {C.M_}, {_RECENT}, a as (select session_id, (min(sequence) - 1) // 2 as first_turn from rs group by 1), x as (select n.session_id, turn_no, first_turn, status in ('complete', 'truncated') and assistant_content <> '' ok from n join a using (session_id)) select session_id, max(first_turn) \"start\", count(*) filter (ok and turn_no >= first_turn) n_active, count(*) filter (ok and turn_no < first_turn) n_omitted from x group by 1",
    "gold_resolution": f"with {E.RK_}, g as (select distinct id, unnest(gold_evidence) evidence from ca) select g.id, count(rank) n_resolved, count(*) filter (rank is null) n_unresolved from g left join rk using (id, evidence) group by 1",
    "decision_reasons": f"select before_event_id event_id, string_agg(distinct gap, ',' order by gap) reasons from boundary_decisions where before_event_id is not null and gap in {ASKED_REASONS} group by 1",
    "assistant_contexts": f"with {C.M_}, x as (select *, lead(role) over (partition by session_id order by sequence) nr from m) select event_id from x where role = 'assistant' and nr is not null",
    "entity_order": f"with {R.E_}, l as (select session_id, max(sequence) l from m group by 1), x as (select session_id, term, min(sequence) f, bool_or(sequence = l) matched from ek join m on key = event_id join l using (session_id) group by 1, 2) select session_id, term, place, matched from (select *, row_number() over (partition by session_id order by matched desc, f, term) place from x) where place <= {ENTITIES}",
    "newest_sessions": f"with {C.T_} select session_id, max(updated_at) updated_at from t group by 1 order by 2 desc, 1 limit {NEWEST}",
    "cache_split": f"with {C.M_} select event_id, session_id, sequence, sha256(content) in (select content_sha256 from boundary_inputs where content_sha256 is not null) hit from m",
    "evidence_sessions": "with s as (select unnest(sessions) s from eval_cases), m as (select s.external_id session, unnest(s.messages) m from s), e as (select distinct session, m.evidence.external_id evidence, m.evidence.source_session_id source from m where m.evidence.external_id is not null) select evidence, count(*) n_places, bool_and(session is not distinct from source) agrees from e group by 1",
    "clause_names": f"with {R.E_}, x as (select distinct clause_id, unnest(regexp_extract_all(text, '{_NAME}')) term from source_clauses where clause_id is not null) select * from x where term in (select term from ek)",
    "clause_split": f"with c as (select clause_id, min(text) as text from source_clauses where clause_id is not null and length(text) > {HALF} group by 1), x as (select clause_id, length(text) n, length(text) // 2 mid, {_NEAR}[1].at near from c) select clause_id, 0 part, 0 start_char, coalesce(near, mid + {OVERLAP // 2})::int end_char from x union all select clause_id, 1, coalesce(near, mid - {OVERLAP // 2})::int, n::int from x",
    "plan_tokens": f"with {C.T_}, x as (select id, coalesce(usage.total_tokens, usage.input_tokens + usage.output_tokens) e, ceil((strlen(coalesce(user_content, '')) + strlen(coalesce(assistant_content, ''))) / 3)::bigint g from t) select id, coalesce(e, g) tokens, e is not null exact from x",
    "canonical_hash": f"with x as (select revision_id, sha256('revision:v1' || chr(31) || {_MAYBE} || len(coalesce(links, [])) || chr(31) || coalesce(array_to_string(list_sort(coalesce(links, [])), chr(31)), '')) h from knowledge_snapshots where revision_id is not null) select revision_id, min(h) record_sha256, count(distinct h) n_forms from x group by 1",
    "row_digest": f"with {C.M_} select session_id, count(*) n, bit_xor(('0x' || left(sha256(event_id || chr(31) || sequence || chr(31) || role || chr(31) || content), 15))::bigint) digest from m group by 1",
    "delta_merge": "with c as (select distinct event_id, start_char, end_char, sha256(text) h, clause_id from source_clauses where clause_id is not null and event_id is not null), o as (select event_id, start_char, end_char, h, count(*) n_merged, sha256(string_agg(clause_id, ',' order by clause_id)) ids_sha256 from c group by 1, 2, 3, 4) select event_id, row_number() over (partition by event_id order by start_char nulls first, end_char nulls first, h nulls first) local_id, start_char, end_char, n_merged, ids_sha256 from o",
    "memory_status": f"with {C.M_}, y as (select epoch_ms(updated_at::timestamptz) - epoch_ms(created_at::timestamptz) v from t where status = 'complete'), z as (select list_sort(list(v / 1000.0::double)) a from y where v is not null) select 'turns_' || coalesce(status, 'unknown') metric, count(*)::double as value from t group by 1 union all select 'sessions', count(distinct session_id) from t union all select 'messages', count(*) from m union all select 'vectors', count(embedding) from embeddings union all select 'seconds_p50', a[ceil((len(a) - 1) * 0.5)::int + 1] from z union all select 'seconds_p95', a[ceil((len(a) - 1) * 0.95)::int + 1] from z",
    "evidence_caps": f"with {_BP}, l as (select id, evidence, list(size) over (partition by id order by b, rank rows between unbounded preceding and current row) upto from bt), f as (select id, evidence, list_reduce(list_concat([0::bigint], upto), lambda a, x: case when a % 1000000 + x <= {CORE_CHARS} and a // 1000000 < {CORE_ITEMS} then a + x + 1000000 else a end) a, list_reduce(list_concat([0::bigint], upto[:-2]), lambda a, x: case when a % 1000000 + x <= {CORE_CHARS} and a // 1000000 < {CORE_ITEMS} then a + x + 1000000 else a end) b from l) select id, evidence, a > b kept from f",
    "context_plan": f"{_KS}, {E.BP_}, bt as (select id, bucket, size from bs left join bg using (id, evidence) where taken or late), kn as (select query_id id, sum(length(text)) n from ks join documents using (doc_id) where reason = 'selected_core' group by 1), ta as (select id, sum(size) filter (bucket <> 'recent_history') e, sum(size) filter (bucket = 'recent_history') h from bt group by 1), x as (select id, strlen(question) c, n, e, h from ca left join kn using (id) left join ta using (id)) select id, 1 part_no, 'system' part, {SYSTEM_SIZE}::bigint size from x union all select id, 2, 'knowledge', coalesce(n, 0)::bigint from x union all select id, 3, 'evidence', coalesce(e, 0)::bigint from x union all select id, 4, 'history', coalesce(h, 0)::bigint from x union all select id, 5, 'current', coalesce(c, 0)::bigint from x",
    "session_resolve": f"with i as (select distinct session_id from turns where session_id is not null), a as (select distinct session_id, unnest([{', '.join(f'left(session_id, {n})' for n in PREFIXES)}, session_id]) asked from i), r as (select *, row_number() over (partition by asked order by session_id) k from a) select asked, case when bool_or(asked = session_id) then 'exact' when count(*) = 1 then 'unique' else 'ambiguous' end kind, count(*) n_matches, string_agg(session_id, ',' order by session_id) filter (k <= {SHOWN}) as names from r group by 1",
    "source_last_good": "with l as (select *, enabled and last_success_at = last_sync_at good from (select *, row_number() over (partition by sync_id order by delivered_at desc) k from source_states where sync_id is not null and source_id is not null) where k = 1), g as (select source_id, count(*) n_syncs, arg_max(enabled, (last_sync_at, sync_id)) enabled_now, max(last_sync_at) filter (good) since, arg_max(sync_id, (last_sync_at, sync_id)) filter (good) good_sync, arg_max(len(active_revisions), (last_sync_at, sync_id)) filter (good)::int n_active from l group by 1) select g.source_id, any_value(n_syncs) n_syncs, any_value(enabled_now) enabled_now, any_value(good_sync) good_sync, any_value(n_active) n_active, count(*) filter (not coalesce(good, false) and (since is null or last_sync_at > since)) n_failed_after from g join l using (source_id) group by 1",
    "edge_provenance": f"with {R.E_} select a.key src, b.key dst, count(*) n, string_agg(term, ',' order by term) terms from ek a join ek b using (term) where a.key < b.key group by 1, 2",
    "stage_status": f"with {C.R_}, b as (select * from boundary_inputs where event_id is not null and session_id is not null), w as (select session_id, max(watermark_before) w from b group by 1), e as (select session_id, event_id, min(sequence) sequence from b group by 1, 2), x as (select e.*, coalesce(sequence <= w, false) inside, event_id not in (select event_id from source_clauses where event_id is not null) nf, event_id not in (select before_event_id from boundary_decisions where before_event_id is not null) nb from e join w using (session_id)), y as (select session_id, case when count(*) filter (nf) = 0 then 'up_to_date' when count(*) filter (nf and inside) = 0 then 'completed' else 'failed' end facts, case when count(*) filter (nb) = 0 then 'up_to_date' when count(*) filter (nb and inside) = 0 then 'completed' else 'failed' end boundaries from x group by 1) select *, case when session_id in (select target_id from hid where target_kind = 'session') then 'cancelled' when facts = 'up_to_date' and boundaries = 'up_to_date' then 'up_to_date' when facts <> 'failed' and boundaries <> 'failed' then 'completed' when facts <> 'failed' or boundaries <> 'failed' then 'partial' else 'failed' end status from y",
}
