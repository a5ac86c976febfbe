"""Scores of retrieval and answers, knowledge sources, boundaries and budgets: survey sections 2.2, 2.5 and 2.11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions.instants import rfc3339
from anamnesis.functions.text import CJK, mixed_tokens, normal_answer
from anamnesis.operators.ordered import neighbours
from anamnesis.session import cut
from anamnesis.sources.tables import table

#: Fixed values of the reference: boundary thresholds and votes, and shares of the budget in percent
#: (recent, exact, episode, graph) by kind of question.
NEAR, FAR, VOTES, GAP_MINUTES = 0.65, 0.55, 2, 30  # the minutes hold only for a profile in no configuration
SHIFT, DISTANCE = 0.60, 0.50
PERCENT = {
    "exact_fact": (45, 40, 5, 10),
    "general": (45, 30, 15, 10),
    "event_recap": (35, 20, 35, 10),
    "temporal": (35, 35, 15, 15),
    "multi_hop": (30, 25, 15, 30),
}
EVIDENCE_BUDGET = 1200
#: Phrases that change the topic, and the order in which buckets are served.
CUES = ("换个话题", "换一个话题", "说点别的", "另一个话题", "回到刚才", "change the subject", "new topic")
BUCKETS = ("exact_or_state", "episode", "graph", "recent_history")


def _cases(s: SparkSession, d: str) -> DataFrame:
    held = F.struct("question", "expected_answer", "question_class", "gold_evidence", "stale_evidence", "negative_evidence", "sessions")
    return table(s, d, "eval_cases").where("id is not null").groupBy("id").agg(F.min(held).alias("c")).select("id", "c.*")


def _ranking(s, d) -> DataFrame:
    """Messages of a case's own sessions by the tokens that they share with its question."""
    c = _cases(s, d).select("id", F.array_distinct(mixed_tokens(F.col("question"))).alias("q"), F.explode("sessions").alias("s"))
    m = c.select("id", "q", F.explode("s.messages").alias("m")).select("id", "q", F.col("m.evidence.external_id").alias("evidence"), F.col("m.content").alias("content"))
    m = m.where("evidence is not null").groupBy("id", "evidence").agg(F.min("q").alias("q"), F.min("content").alias("content"))
    t = F.array_distinct(mixed_tokens(F.col("content")))
    score = F.round(F.size(F.array_intersect("q", t)) / F.greatest(F.lit(1), F.size(F.array_union("q", t))), 9)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "evidence")  # a case is one row of the input
    return m.select("id", "evidence", "content", score.alias("score")).withColumn("rank", F.row_number().over(w))


def eval_ranking(s, d):
    """Every case's ranked evidence."""
    return _ranking(s, d).select("id", "evidence", "score", "rank")


def _gold(s, d, ranked: DataFrame) -> DataFrame:
    g = _cases(s, d).select("id", F.explode(F.array_distinct("gold_evidence")).alias("evidence"))
    return g.join(ranked.select("id", "evidence", "rank"), ["id", "evidence"], "left")


def _recall(s, d, ranked):
    k = lambda n: F.round(F.count_if(F.col("rank") <= n) / F.count(F.lit(1)), 9)
    return _gold(s, d, ranked).groupBy("id").agg(k(5).alias("recall_5"), k(10).alias("recall_10"))


def recall_at_k(s, d):
    """A5: share of a case's gold evidence among its first 5 and 10; cases without gold are left out."""
    return _recall(s, d, _ranking(s, d))


def mrr(s, d):
    """One over the first gold rank, 0 if none is ranked."""
    return _mrr(s, d, _ranking(s, d))


def _mrr(s, d, ranked):
    return _gold(s, d, ranked).groupBy("id").agg(F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 9).alias("mrr"))


def _f1(s, d, ranked: DataFrame) -> DataFrame:
    """The expected answer against the first ranked message, as multisets of tokens."""
    words = lambda c: mixed_tokens(normal_answer(c))
    first = ranked.where("rank = 1").select("id", "content")
    both = _cases(s, d).where("expected_answer is not null").select("id", "expected_answer").join(first, "id")
    side = lambda c, name: both.select("id", F.explode(words(F.col(c))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias(name))
    j = side("expected_answer", "a").join(side("content", "b"), ["id", "w"], "full_outer")
    t = j.groupBy("id").agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    return t.select("id", F.round(F.when((F.col("a") > 0) & (F.col("b") > 0), 2 * F.col("n") / (F.col("a") + F.col("b"))).otherwise(0.0), 9).alias("f1"))


def token_f1(s, d):
    """Token F1 of the first ranked message as an answer."""
    return _f1(s, d, _ranking(s, d))


#: Scores of a case beside recall, MRR and F1; those of one class are null in the others.
SCORES = ("answer_correct", "temporal_correct", "conflict_correct", "refused", "correct_refusal", "relevant_selected", "stale_recalled", "no_answer_false_recall")


def _case_scores(s, d, ranked: DataFrame) -> DataFrame:
    """Scores of the first ranked message as the answer and of the first ten as the selected evidence.

    A case without an expected answer is right if it is refused. stale_recalled is null without stale evidence.
    """
    r = ranked.where("rank <= 10").groupBy("id").agg(F.collect_list("evidence").alias("top"), F.max(F.when(F.col("rank") == 1, F.col("content"))).alias("answer"))
    c = _cases(s, d).join(r, "id", "left")
    answer = normal_answer(F.coalesce("answer", F.lit("")))
    n = lambda name: F.coalesce(F.size(F.array_intersect(name, "top")), F.lit(0))
    among = lambda name: F.greatest(n(name), F.lit(0))
    of = lambda kind, score: F.when(F.col("question_class") == kind, score)
    refused = answer == "no answer"
    right = F.when(F.col("expected_answer").isNull(), refused).otherwise(answer == normal_answer(F.col("expected_answer")))
    return c.select(
        "id",
        right.alias("answer_correct"),
        of("temporal", right).alias("temporal_correct"),
        of("conflict_update", right).alias("conflict_correct"),
        refused.alias("refused"),
        of("no_answer", refused).alias("correct_refusal"),
        among("gold_evidence").alias("relevant_selected"),
        F.when(F.size("stale_evidence") > 0, among("stale_evidence") > 0).alias("stale_recalled"),
        of("no_answer", among("negative_evidence") > 0).alias("no_answer_false_recall"),
    )


def eval_score(s, d):
    """The scores of a case side by side that need no model's answer and no token usage."""
    ranked = cut(_ranking(s, d))  # four readers
    out = _cases(s, d).select("id", "question_class")
    for x in (_recall(s, d, ranked), _mrr(s, d, ranked), _f1(s, d, ranked), _case_scores(s, d, ranked)):
        out = out.join(x, "id", "left")
    return out


#: Buckets of a unit of value in which sorted values are numbered.
STEP = 1024


def percentiles(values: DataFrame, group: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """(group, mean, n and one column per place q): the value at place ceil((n - 1) * q), from 0, of the sorted ones.

    No group is gathered: equal values are counted, the counts are added up in buckets of value,
    and per group only the buckets are. Nulls are left out.
    """
    c = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("bucket", F.floor(F.col("v") * STEP))
    b = c.groupBy(*group, "bucket").agg(F.sum("c").alias("held"), F.sum(F.col("v") * F.col("c")).alias("x"))
    upto = Window.partitionBy(*group).orderBy("bucket")
    every = Window.partitionBy(*group)
    b = b.select(*group, "bucket", (F.sum("held").over(upto) - F.col("held")).alias("before"), F.sum("held").over(every).alias("n"), F.sum("x").over(every).alias("x"))
    at = F.sum("c").over(Window.partitionBy(*group, "bucket").orderBy("v")) + F.col("before")
    placed = c.join(b, [*group, "bucket"]).withColumn("at", at)
    found = [F.min(F.when(F.col("at") > F.ceil((F.col("n") - 1) * q), F.col("v"))).alias(name) for name, q in places.items()]
    return placed.groupBy(*group).agg(F.round(F.max("x") / F.max("n"), 9).alias("mean"), *found, F.max("n").alias("n"))


def eval_agg(s, d):
    """A3: mean, median, 95th percentile and count of each score by class."""
    e = eval_score(s, d)
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("recall_5", "recall_10", "mrr", "f1", *SCORES)])
    flat = e.select("question_class", F.explode(metrics).alias("m")).select("question_class", "m.metric", "m.v")
    return percentiles(flat, ["question_class", "metric"], "v", {"p50": 0.5, "p95": 0.95})


def eval_summary(s, d):
    """A4: one row over all cases; each mean over the cases that have the score."""
    return eval_score(s, d).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.round(F.avg("recall_5"), 9).alias("recall_5"),
        F.round(F.avg("recall_10"), 9).alias("recall_10"),
        F.round(F.avg("mrr"), 9).alias("mrr"),
        F.round(F.avg("f1"), 9).alias("f1"),
        F.count_if("stale_recalled").alias("n_stale"),
        *[F.round(F.avg(F.col(x).cast("double")), 9).alias(x) for x in SCORES],
    )


def eval_resume(s, d):
    """Cases that no case of their group with a smaller id comes before: what a run that did those would still have to do."""
    c = table(s, d, "eval_cases").where("id is not null").select("id", "group_id").distinct()
    done = c.groupBy("group_id").agg(F.min("id").alias("id")).select("id")
    return c.join(done, "id", "left_anti").select("id", "group_id")


def evidence_audit(s, d):
    """evidence ids that stand for more than one content, or messages with a role of their own."""
    m = table(s, d, "eval_cases").select(F.explode("sessions").alias("s")).select(F.explode("s.messages").alias("m"))
    e = m.select(F.col("m.evidence.external_id").alias("evidence"), F.sha2("m.content", 256).alias("h"), F.col("m.role").alias("role"))
    return e.groupBy("evidence").agg(F.countDistinct("h").alias("n_contents"), F.count_if(~F.col("role").isin("user", "assistant")).alias("n_odd_roles")).where("n_contents > 1 or n_odd_roles > 0")


def group_sessions(s, d):
    """Cases of each group, and whether they share the same sessions in the same order."""
    ids = F.array_join(F.transform("sessions", lambda x: F.coalesce(x["external_id"], F.lit(""))), "|")
    c = _cases(s, d).select("id", ids.alias("ids"), F.size("sessions").alias("n"))
    g = table(s, d, "eval_cases").where("id is not null").select("id", "group_id").distinct()
    return c.join(g, "id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_cases"), F.min("n").alias("least"), F.max("n").alias("most"), (F.countDistinct("ids") == 1).alias("identical"))


def kb_sync(s, d):
    """Each revision's previous one, the revision of its source and key fetched before it, beside the recorded pointer."""
    r = table(s, d, "knowledge_snapshots").where("revision_id is not null").groupBy("revision_id").agg(
        F.min(F.struct("source_id", "document_key", "fetched_at")).alias("r"), F.max("previous_revision").alias("recorded")
    ).select("revision_id", "r.*", "recorded")
    n = neighbours(r, ["source_id", "document_key"], F.substring("fetched_at", 1, 10), ["fetched_at", "revision_id"], F.col("revision_id"))
    return n.select("revision_id", F.col("value_before").alias("previous"), F.col("value_after").isNull().alias("is_last"), F.coalesce(F.col("recorded") == F.col("value_before"), F.col("recorded").isNull() & F.col("value_before").isNull()).alias("agrees"))


def kb_list(s, d):
    """Sources with what their last delivered state says."""
    last = table(s, d, "source_states").where("source_id is not null").groupBy("source_id").agg(
        F.max_by(F.struct("enabled", F.size("active_revisions").alias("n"), "last_error"), F.struct("last_sync_at", "delivered_at")).alias("x"), F.countDistinct("sync_id").alias("n_syncs")
    )
    return last.select("source_id", "n_syncs", "x.enabled", F.col("x.n").alias("n_active"), F.col("x.last_error").isNotNull().alias("failing"))


def revision_conflicts(s, d):
    """revisions that more than one source holds active, or whose id has no valid shape."""
    a = table(s, d, "source_states").where("enabled").select("source_id", F.explode("active_revisions").alias("revision_id")).distinct()
    g = a.groupBy("revision_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return g.where((F.col("n_sources") > 1) | ~F.col("revision_id").rlike("^rev_[0-9a-f]{64}$"))


def link_targets(s, d):
    """Links of snapshots by whether their source has a document of that key."""
    k = table(s, d, "knowledge_snapshots").where("source_id is not null")
    keys = k.select("source_id", F.col("document_key").alias("link")).distinct().withColumn("there", F.lit(True))
    links = k.where("revision_id is not null").select("source_id", "revision_id", F.explode("links").alias("link")).distinct()
    return links.join(keys, ["source_id", "link"], "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_links"), F.count("there").alias("n_found"))


def _inputs(s, d) -> DataFrame:
    """Each event once, as delivered first by its content, with both instants and its profile's gap limit in seconds."""
    held = F.struct("session_id", "created_at", "previous_user_created_at", "content", "previous_user_content", "cosine_similarity", "profile_id")
    b = table(s, d, "boundary_inputs").where("event_id is not null").groupBy("event_id").agg(F.min(held).alias("b")).select("event_id", "b.*")
    c = table(s, d, "memory_configs").where("profile_id is not null").groupBy("profile_id").agg(F.max_by("episode_gap_minutes", "config_version").alias("minutes"))
    b = b.join(c, "profile_id", "left").withColumn("limit_s", F.coalesce("minutes", F.lit(GAP_MINUTES)).cast("long") * 60)
    return b.withColumn("now", rfc3339(F.col("created_at"))).withColumn("before", rfc3339(F.col("previous_user_created_at")))


def _seconds() -> Column:
    return F.col("now.sec") - F.col("before.sec") - F.when(F.col("now.nano") < F.col("before.nano"), 1).otherwise(0)


def _gap_state() -> Column:
    g = _seconds()
    return (
        F.when(F.col("previous_user_created_at").isNull(), "first_message")
        .when(F.col("now").isNull() | F.col("before").isNull() | (g < 0), "invalid_or_out_of_order")
        .when(g > F.col("limit_s"), "greater_than_threshold")
        .when(g == F.col("limit_s"), "equal_to_threshold")
        .otherwise("below_threshold")
    )


def _cue() -> Column:
    return F.lower("content").rlike("|".join(CUES))


def gap_state(s, d):
    """The state of each event's gap as it was known on arrival, in whole seconds."""
    return _inputs(s, d).select("event_id", _gap_state().alias("gap"))


def boundary_class(s, d):
    """Boundary by rule: session start, cue, gap in whole minutes, then similarity; between the thresholds it is ambiguous."""
    minutes = F.when(_seconds() >= 0, F.floor(_seconds() / 60))
    c = F.col("cosine_similarity")
    kind = (
        F.when(F.col("previous_user_created_at").isNull(), "session_start")
        .when(_cue(), "cue")
        .when(minutes > F.col("limit_s") / 60, "gap")
        .when(c < FAR, "dissimilar")
        .when(c >= NEAR, "none")
        .otherwise("ambiguous")
    )
    return _inputs(s, d).select("event_id", kind.alias("boundary"))


def boundary_votes(s, d):
    """Soft votes of each event, from its names and its similarity, and whether they, the gap or an explicit cue make a boundary."""
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]{4,}"), F.lit(0)))
    i = _inputs(s, d).withColumn("a", names("content")).withColumn("b", names("previous_user_content"))
    far = F.when((F.size("a") > 0) & (F.size("b") > 0), 1 - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")) >= DISTANCE)
    votes = F.when(far, 1).otherwise(0) + F.when(F.col("cosine_similarity") < SHIFT, 1).otherwise(0)
    hard = _gap_state().isin("first_message", "greater_than_threshold") | F.coalesce(_cue(), F.lit(False))
    return i.select("event_id", votes.alias("soft_votes"), (hard | (votes >= VOTES)).alias("is_boundary"))


def votes_audit(s, d):
    """Stored decisions by whether their votes are those of their signals."""
    t = table(s, d, "boundary_decisions").where("before_event_id is not null")
    n = F.size(F.filter("soft_signals", lambda x: x["state"] == "true"))
    return t.select("before_event_id", "soft_true_votes", n.alias("n")).distinct().groupBy((F.col("soft_true_votes") == F.col("n")).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


def _groups(s, d) -> DataFrame:
    """Candidates of each case with their bucket, size and place.

    A case's last session is its recent history. Elsewhere a message that matches the question is
    exact; one without a match that stands beside such a one is reached by a path, so graph; what
    else its session holds comes by the session, so episode. Sessions without any match give nothing.
    """
    kind = F.when(F.col("question_class").isin(*PERCENT), F.col("question_class")).otherwise("general")
    c = _cases(s, d).select("id", kind.alias("kind"), F.size("sessions").alias("n_sessions"), F.posexplode("sessions").alias("s_no", "s"))
    m = c.select("id", "kind", (F.col("s_no") == F.col("n_sessions") - 1).alias("recent"), "s_no", F.posexplode("s.messages").alias("m_no", "m"))
    m = m.select("id", "kind", "recent", "s_no", "m_no", F.col("m.evidence.external_id").alias("evidence")).where("evidence is not null")
    r = _ranking(s, d).join(m.groupBy("id", "evidence").agg(F.min(F.struct("s_no", "m_no", "kind", "recent")).alias("x")), ["id", "evidence"]).select("id", "evidence", "content", "score", "rank", "x.*")
    w = Window.partitionBy("id", "s_no").orderBy("m_no")  # a session of a case is one value of the input
    hit = F.col("score") > 0
    beside = F.coalesce(F.lag(hit).over(w), F.lit(False)) | F.coalesce(F.lead(hit).over(w), F.lit(False))
    any_hit = F.max(hit).over(Window.partitionBy("id", "s_no"))
    bucket = F.when(F.col("recent"), "recent_history").when(hit, "exact_or_state").when(beside, "graph").when(any_hit, "episode")
    return r.select("id", "kind", "evidence", "rank", bucket.alias("bucket"), (F.octet_length("content") + 64).alias("size")).where("bucket is not null")


def budget_groups(s, d):
    """B1: evidence of each case by bucket."""
    return _groups(s, d).groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def budget_split(s, d):
    """The budget of each bucket of a case, in whole units by its kind of question."""
    names = ("recent_history", "exact_or_state", "episode", "graph")
    per = F.create_map(*[x for k, v in PERCENT.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    kind = F.when(F.col("question_class").isin(*PERCENT), F.col("question_class")).otherwise("general")
    c = _cases(s, d).select("id", F.posexplode(per[kind]).alias("i", "percent"))
    return c.select("id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("bucket"), F.expr(f"{EVIDENCE_BUDGET} * percent div 100").alias("budget"))


def budget_pack(s, d):
    """Every candidate of a case and what became of it.

    First each bucket takes what fits its own budget, by rank, skipping what does not; then what is left
    of the whole budget goes to the others, by the order of buckets and rank (T9). A greedy
    scan with state: two folds over a case's own candidates, which are one row of the input.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in BUCKETS]), F.col("bucket")).cast("int")
    g = _groups(s, d).join(budget_split(s, d), ["id", "bucket"]).withColumn("b", order)
    one = g.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("b", "rank", "evidence", "bucket", "size", "budget"))).alias("all"))
    item = lambda x, state: F.struct(x["evidence"].alias("evidence"), x["bucket"].alias("bucket"), x["rank"].alias("rank"), x["size"].cast("bigint").alias("size"), state.alias("state"))
    kind = "array<struct<evidence:string,bucket:string,rank:int,size:bigint,state:string>>"
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("all"), F.array().cast(kind).alias("out"))

    def first(state, x):
        used = F.when(state["b"] == x["b"], state["used"]).otherwise(0)
        fits = used + x["size"] <= x["budget"]
        more = F.when(fits, x["size"]).otherwise(0).cast("bigint")
        return F.struct(x["b"].alias("b"), (used + more).alias("used"), (state["all"] + more).alias("all"), F.concat(state["out"], F.array(item(x, F.when(fits, "selected").otherwise("bucket_budget")))).alias("out"))

    def second(state, x):
        fits = (x["state"] == "bucket_budget") & (state["all"] + x["size"] <= EVIDENCE_BUDGET)
        more = F.when(fits, x["size"]).otherwise(0).cast("bigint")
        return F.struct((state["all"] + more).alias("all"), F.concat(state["out"], F.array(item(x, F.when(fits, "reflowed").otherwise(x["state"])))).alias("out"))

    begun = one.withColumn("f", F.aggregate("all", zero, first))
    done = begun.withColumn("g", F.aggregate("f.out", F.struct(F.col("f.all").alias("all"), F.array().cast(kind).alias("out")), second))
    return done.select("id", F.explode("g.out").alias("x")).select("id", "x.evidence", "x.bucket", "x.rank", "x.size", "x.state")


_CJK = CJK.encode().decode("unicode_escape")


def mixed_sql(x: str) -> str:
    """Words, and each CJK character for itself."""
    return f"regexp_extract_all(lower({x}), '[{_CJK}]|(?:[^\\P{{L}}{_CJK}]|[^\\P{{N}}{_CJK}])+')"


CA_ = "ca as (select * exclude (k) from (select *, row_number() over (partition by id order by question) k from eval_cases where id is not null) where k = 1)"
RK_ = CA_ + f""",
  cm as (select id, q, unnest(s.messages) m from (select id, list_distinct({mixed_sql('question')}) q, unnest(sessions) s from ca)),
  ev as (select id, m.evidence.external_id evidence, min(m.content) content, any_value(q) q from cm where m.evidence.external_id is not null group by 1, 2),
  es as (select id, evidence, content, q, list_distinct({mixed_sql('content')}) t from ev),
  ei as (select id, evidence, content, len(list_intersect(q, t)) i, len(q) + len(t) n from es),
  rk as (select id, evidence, content, round(i / greatest(1, n - i), 9) score, row_number() over (partition by id order by round(i / greatest(1, n - i), 9) desc, evidence) rank from ei)"""
GO_ = RK_ + ", go as (select id, evidence, rank from (select distinct id, unnest(gold_evidence) evidence from ca) left join rk using (id, evidence))"
_N = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+'), lambda w: w not in ('a', 'an', 'the', '')), ' ')"
F1_ = RK_ + ", bo as (select ca.id, expected_answer x, content y from ca join rk on ca.id = rk.id and rank = 1 where expected_answer is not null), " + (
    f"wa as (select id, unnest({mixed_sql(_N.format('x'))}) w from bo), wb as (select id, unnest({mixed_sql(_N.format('y'))}) w from bo), "
    "na as (select id, w, count(*) a from wa group by 1, 2), nb as (select id, w, count(*) b from wb group by 1, 2), "
    "ft as (select id, sum(least(coalesce(a, 0), coalesce(b, 0))) n, sum(coalesce(a, 0)) a, sum(coalesce(b, 0)) b from na full join nb using (id, w) group by 1), "
    "f1 as (select id, round(case when a > 0 and b > 0 then 2 * n / (a + b) else 0 end, 9) f1 from ft)"
)
SC_ = F1_ + f""", go as (select id, evidence, rank from (select distinct id, unnest(gold_evidence) evidence from ca) left join rk using (id, evidence)),
  gr as (select id, round(count(*) filter (rank <= 5) / count(*), 9) recall_5, round(count(*) filter (rank <= 10) / count(*), 9) recall_10, round(coalesce(1 / min(rank), 0), 9) mrr from go group by 1),
  tp as (select id, list(evidence) top, max(content) filter (rank = 1) answer from rk where rank <= 10 group by 1),
  cs as (select ca.id, {_N.format("coalesce(answer, '')")} said, {_N.format('expected_answer')} want, coalesce(top, []) top, ca.* exclude (id) from ca left join tp using (id)),
  ct as (select *, said = 'no answer' refused, case when expected_answer is null then said = 'no answer' else said = want end answer_correct from cs),
  sx as (select id, answer_correct, case when question_class = 'temporal' then answer_correct end temporal_correct, case when question_class = 'conflict_update' then answer_correct end conflict_correct,
    refused, case when question_class = 'no_answer' then refused end correct_refusal, coalesce(len(list_intersect(gold_evidence, top)), 0)::int relevant_selected,
    case when len(stale_evidence) > 0 then len(list_intersect(stale_evidence, top)) > 0 end stale_recalled,
    case when question_class = 'no_answer' then coalesce(len(list_intersect(negative_evidence, top)), 0) > 0 end no_answer_false_recall from ct),
  sc as (select ca.id, question_class, recall_5, recall_10, mrr, f1, sx.* exclude (id) from ca left join gr using (id) left join f1 using (id) left join sx using (id))"""
IN_ = r"""b as (select *, row_number() over (partition by event_id order by session_id nulls first, created_at nulls first, previous_user_created_at nulls first, content nulls first, previous_user_content nulls first, cosine_similarity nulls first) k from boundary_inputs where event_id is not null),
  li as (select profile_id, arg_max(episode_gap_minutes, config_version) * 60 lim from memory_configs where profile_id is not null group by 1),
  i as (select event_id, created_at ca, previous_user_created_at pa, content, previous_user_content pc, cosine_similarity cs, coalesce(lim, 1800) lim,
    case when regexp_full_match(created_at, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)') then epoch_us(try_cast(created_at as timestamptz)) end n,
    case when regexp_full_match(previous_user_created_at, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)') then epoch_us(try_cast(previous_user_created_at as timestamptz)) end p from b left join li using (profile_id) where k = 1),
  g as (select *, case when n >= p then (n - p) // 1000000 when n < p then -1 end s from i),
  gs as (select *, case when pa is null then 'first_message' when s is null or s < 0 then 'invalid_or_out_of_order' when s > lim then 'greater_than_threshold' when s = lim then 'equal_to_threshold' else 'below_threshold' end gap,
    coalesce(regexp_matches(lower(content), '""" + "|".join(CUES) + r"""'), false) cue from g)"""
GR_ = RK_ + """,
  ss as (select id, case when question_class in {kinds} then question_class else 'general' end kind, len(sessions) n, unnest(range(len(sessions))) s_no, unnest(sessions) s from ca),
  sm as (select id, kind, s_no = n - 1 recent, s_no, unnest(range(len(s.messages))) m_no, unnest(s.messages) m from ss),
  sp as (select id, m.evidence.external_id evidence, min((s_no, m_no, kind, recent)) x from sm where m.evidence.external_id is not null group by 1, 2),
  so as (select id, evidence, content, score, rank, x[1] s_no, x[2] m_no, x[3] kind, x[4] recent from rk join sp using (id, evidence)),
  sw as (select *, coalesce(lag(score > 0) over w, false) or coalesce(lead(score > 0) over w, false) beside, bool_or(score > 0) over (partition by id, s_no) hit from so window w as (partition by id, s_no order by m_no)),
  gq as (select id, kind, evidence, rank, case when recent then 'recent_history' when score > 0 then 'exact_or_state' when beside then 'graph' when hit then 'episode' end bucket, strlen(content) + 64 size from sw),
  gp as (select * from gq where bucket is not null)""".format(kinds=tuple(PERCENT))
_PER = " union all ".join(
    f"select '{k}' kind, '{n}' bucket, {p} percent" for k, v in PERCENT.items() for n, p in zip(("recent_history", "exact_or_state", "episode", "graph"), v)
)
_FIT = "list_reduce(list_concat([0::bigint], {}), lambda a, x: case when a + x <= {} then a + x else a end)"
BP_ = GR_ + f""", pe as ({_PER}),
  ba as (select gp.*, ({EVIDENCE_BUDGET} * percent) // 100 budget, list_position({list(BUCKETS)}, bucket) b from gp join pe using (kind, bucket)),
  bl as (select *, list(size) over (partition by id, bucket order by rank rows between unbounded preceding and current row) upto from ba),
  bf as (select *, {_FIT.format('upto', 'budget')} > {_FIT.format('upto[:-2]', 'budget')} taken from bl),
  bs as (select *, sum(case when taken then size else 0 end) over (partition by id) spent from bf),
  br as (select id, evidence, list(size) over (partition by id order by b, rank rows between unbounded preceding and current row) upto, {EVIDENCE_BUDGET} - spent room from bs where not taken),
  bg as (select id, evidence, {_FIT.format('upto', 'room')} > {_FIT.format('upto[:-2]', 'room')} late from br)"""

QUERIES = {
    f.__name__: f
    for f in (
        eval_ranking, recall_at_k, mrr, token_f1, eval_score, eval_agg, eval_summary, eval_resume, evidence_audit, group_sessions, kb_sync, kb_list,
        revision_conflicts, link_targets, gap_state, boundary_class, boundary_votes, votes_audit, budget_groups, budget_split, budget_pack,
    )
}
ORACLES = {
    "eval_ranking": f"with {RK_} select id, evidence, score, rank from rk",
    "recall_at_k": f"with {GO_} select id, round(count(*) filter (rank <= 5) / count(*), 9) recall_5, round(count(*) filter (rank <= 10) / count(*), 9) recall_10 from go group by 1",
    "mrr": f"with {GO_} select id, round(coalesce(1 / min(rank), 0), 9) mrr from go group by 1",
    "token_f1": f"with {F1_} select * from f1",
    "eval_score": f"with {SC_} select * from sc",
    "eval_agg": f"with {SC_}, w as (select question_class, {', '.join(f'{m}::double {m}' for m in ('recall_5', 'recall_10', 'mrr', 'f1', *SCORES))} from sc), x as (unpivot w on {', '.join(('recall_5', 'recall_10', 'mrr', 'f1', *SCORES))} into name metric value v) select question_class, metric, round(avg(v), 9) mean, list_sort(list(v))[ceil((count(*) - 1) * 0.5)::int + 1] p50, list_sort(list(v))[ceil((count(*) - 1) * 0.95)::int + 1] p95, count(*) n from x where v is not null group by 1, 2",
    "eval_summary": f"with {SC_} select count(*) n_cases, {', '.join(f'round(avg({m}::double), 9) {m}' for m in ('recall_5', 'recall_10', 'mrr', 'f1', *SCORES))}, count(*) filter (stale_recalled) n_stale from sc",
    "eval_resume": "select distinct id, group_id from eval_cases where id is not null and id not in (select min(id) from eval_cases where id is not null group by group_id)",
    "evidence_audit": "with m as (select unnest(s.messages) m from (select unnest(sessions) s from eval_cases)) select m.evidence.external_id evidence, count(distinct m.content) n_contents, count(*) filter (m.role not in ('user', 'assistant')) n_odd_roles from m group by 1 having n_contents > 1 or n_odd_roles > 0",
    "group_sessions": f"with {CA_} select group_id, count(*) n_cases, min(len(sessions))::int least, max(len(sessions))::int most, count(distinct array_to_string(list_transform(sessions, lambda x: coalesce(x.external_id, '')), '|')) = 1 identical from ca group by 1",
    "kb_sync": "with r as (select revision_id, min(source_id) source_id, min(document_key) document_key, min(fetched_at) fetched_at, max(previous_revision) recorded from knowledge_snapshots where revision_id is not null group by 1), x as (select *, lag(revision_id) over w b, lead(revision_id) over w a from r window w as (partition by source_id, document_key order by fetched_at, revision_id)) select revision_id, b previous, a is null is_last, recorded is not distinct from b agrees from x",
    "kb_list": "with x as (select *, row_number() over (partition by source_id order by last_sync_at desc, delivered_at desc) k, count(distinct sync_id) over (partition by source_id) n from source_states where source_id is not null) select source_id, n n_syncs, enabled, len(active_revisions)::int n_active, last_error is not null failing from x where k = 1",
    "revision_conflicts": "with a as (select distinct source_id, unnest(active_revisions) revision_id from source_states where enabled) select revision_id, count(*) n_sources from a group by 1 having count(*) > 1 or not regexp_full_match(revision_id, 'rev_[0-9a-f]{64}')",
    "link_targets": "with k as (select distinct source_id, document_key from knowledge_snapshots where source_id is not null), l as (select distinct source_id, revision_id, unnest(links) link from knowledge_snapshots where source_id is not null and revision_id is not null) select l.source_id, count(*) n_links, count(document_key) n_found from l left join k on l.source_id = k.source_id and link = document_key group by 1",
    "gap_state": f"with {IN_} select event_id, gap from gs",
    "boundary_class": f"with {IN_} select event_id, case when pa is null then 'session_start' when cue then 'cue' when s >= 0 and s // 60 > lim / 60 then 'gap' when cs < {FAR} then 'dissimilar' when cs >= {NEAR} then 'none' else 'ambiguous' end boundary from gs",
    "boundary_votes": f"with {IN_}, x as (select *, list_distinct(regexp_extract_all(content, '[A-Z][a-z]{{4,}}')) a, list_distinct(regexp_extract_all(pc, '[A-Z][a-z]{{4,}}')) b from gs), y as (select event_id, gap, cue, coalesce((len(a) > 0 and len(b) > 0 and 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= {DISTANCE})::int, 0) + coalesce((cs < {SHIFT})::int, 0) v from x) select event_id, v soft_votes, gap in ('first_message', 'greater_than_threshold') or cue or v >= {VOTES} is_boundary from y",
    "votes_audit": "with x as (select distinct before_event_id, soft_true_votes, len(list_filter(soft_signals, lambda v: v.state = 'true')) n from boundary_decisions where before_event_id is not null) select soft_true_votes = n equal, count(*) n from x group by 1",
    "budget_groups": f"with {GR_} select id, bucket, count(*) n, sum(size)::bigint size from gp group by 1, 2",
    "budget_pack": f"with {BP_} select id, evidence, bucket, rank, size, case when taken then 'selected' when late then 'reflowed' else 'bucket_budget' end state from bs left join bg using (id, evidence)",
    "budget_split": f"with {CA_}, pe as ({_PER}) select id, bucket, ({EVIDENCE_BUDGET} * percent) // 100 budget from ca join pe on kind = case when question_class in {tuple(PERCENT)!r} then question_class else 'general' end",
}
