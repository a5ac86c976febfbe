"""Lexical, vector and graph recall: survey sections 2.4 to 2.8 and 2.11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import CJK, tokens
from anamnesis.operators import graph, lexical, turns, vectors
from anamnesis.operators.ordered import neighbours, ordinal
from anamnesis.operators.sessions import cut_tree
from anamnesis.plans.conversation import M_
from anamnesis.plans.episodes import EVENTS_, RUNS_
from anamnesis.session import cut, spread
from anamnesis.sources.tables import table

#: The reference's limit of lexical and vector candidates, and of neighbours of a vector.
TOP, NEIGHBOURS, LEAST_COSINE = 64, 5, 0.30
#: The reference's limit of graph candidates; and the candidates of a question that seed its graph.
GRAPH_TOP, SEEDS = 32, 8
KINDS = ("reply", "adjacent", "shared_entity", "keyword", "mutual_topk", "episode_member", "replacement")
CUTOFF = "2024-09-01"


def _documents(s, d):
    return table(s, d, "documents").select("doc_id", "text", "title")


def _questions(s, d):
    return table(s, d, "eval_cases").where("id is not null and question is not null").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("q"))


def _terms(q: DataFrame) -> DataFrame:
    return q.select("query_id", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))


def term_df(s, d):
    """A2: texts per term."""
    return lexical.document_frequency(lexical.postings(spread(_documents(s, d), "doc_id"), "doc_id", "text"))


def kb_bm25(s, d):
    """The best documents of every evaluation question."""
    return lexical.bm25(_documents(s, d), _terms(_questions(s, d)), "doc_id", "text", TOP)


def conv_bm25(s, d):
    """The best messages, of either role, of every evaluation question."""
    return lexical.bm25(turns.messages(table(s, d, "turns")), _terms(_questions(s, d)), "event_id", "content", TOP)


def _titles(s, d):
    return lexical.bm25(_documents(s, d), _terms(_questions(s, d)), "doc_id", "title", TOP)


def _channels(s, d):
    text = kb_bm25(s, d).select("query_id", "doc_id", "rank", F.lit("text").alias("channel"))
    return text.unionByName(_titles(s, d).select("query_id", "doc_id", "rank", F.lit("title").alias("channel")))


def rrf(s, d):
    """Text and title ranks fused by reciprocal ranks."""
    return lexical.fuse(_channels(s, d), "doc_id", TOP)


def channel_status(s, d):
    """Both expected channels of every question, also where they found nothing."""
    q = _questions(s, d).select("query_id", F.explode(F.array(F.lit("text"), F.lit("title"))).alias("channel"))
    n = _channels(s, d).groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    return q.join(n, ["query_id", "channel"], "left").select(
        "query_id", "channel", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "complete").otherwise("empty").alias("status")
    )


def seed_mass(s, d):
    """Each candidate's share of its question's mass: 1/rank within its channel, channels equal."""
    c = cut(_channels(s, d))  # two readers
    per = Window.partitionBy("query_id", "channel")
    share = (1 / F.col("rank")) / F.sum(1 / F.col("rank")).over(per)
    n = c.groupBy("query_id").agg(F.countDistinct("channel").alias("n_channels"))
    return c.withColumn("share", share).join(n, "query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("share") / F.col("n_channels")), 9).alias("mass"))


def subqueries(s, d):
    """R2: a question that lists three items or more gives one query for each beside the whole."""
    items = F.filter(F.split("q", r"[、,，]| and "), lambda x: F.trim(x) != "")
    one = _questions(s, d).select("query_id", F.when(F.size(items) >= 3, F.concat(F.array("q"), F.transform(items, lambda x: F.trim(x)))).otherwise(F.array("q")).alias("a"))
    return one.select("query_id", F.posexplode("a").alias("pos", "sub")).select("query_id", "pos", F.sha2("sub", 256).alias("sub_sha256"))


def _vectors(s, d):
    return table(s, d, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def vec_normalize(s, d):
    """Length of every vector and the sum of its unit form."""
    u = F.aggregate(vectors.unit(F.col("vector")), F.lit(0.0), lambda a, x: a + x)
    return _vectors(s, d).select("id", F.round(vectors.norm(F.col("vector")), 6).alias("norm"), F.round(u, 6).alias("unit_sum"))


def vec_audit(s, d):
    """Vectors by what is wrong with them."""
    n = vectors.norm(F.col("vector"))
    fault = F.when(F.size("vector") == 0, "empty").when(F.isnan(n) | (n == float("inf")), "not_finite").when(F.abs(n - 1) > 1e-5, "not_unit").otherwise("good")
    return _vectors(s, d).groupBy(fault.alias("state"), F.size("vector").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def cosine(s, d):
    """Similarity of each vector and the next id's."""
    a = _vectors(s, d).select("id", "vector")
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    c = vectors.dot(F.col("vector"), F.col("other")) / (vectors.norm(F.col("vector")) * vectors.norm(F.col("other")))
    return a.join(b, "id").select("id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 6).alias("cosine"))


def vec_mean(s, d):
    """Mean vector of each label."""
    return vectors.pooled(_vectors(s, d), "label", "vector", F.lit(1))


def vec_pool(s, d):
    """Weighted pool of each label; the weight is the id's rest by seven, plus one."""
    return vectors.pooled(_vectors(s, d), "label", "vector", F.col("id") % 7 + 1)


def vector_topk(s, d):
    """The nearest vectors of every vector whose id is divisible by 50."""
    v = _vectors(s, d).select("id", "vector")
    return vectors.nearest(v.where("id % 50 = 0"), v, TOP)


def edge_mutual_topk(s, d):
    """Pairs that are among each other's five nearest and at least LEAST_COSINE alike."""
    v = _vectors(s, d).select("id", "vector")
    n = cut(vectors.nearest(v, v, NEIGHBOURS).where(F.col("similarity") >= LEAST_COSINE))
    back = n.select(F.col("row_id").alias("query_id"), F.col("query_id").alias("row_id"))
    return n.where("query_id < row_id").join(back, ["query_id", "row_id"]).select(F.col("query_id").alias("src"), F.col("row_id").alias("dst"), F.col("similarity").alias("weight"))


def vec_codec(s, d):
    """Vectors to little-endian bytes and back."""
    import numpy as np

    encode = F.pandas_udf(lambda v: v.map(lambda x: x.astype("<f4").tobytes()), "binary")
    decode = F.pandas_udf(lambda b: b.map(lambda x: np.frombuffer(x, "<f4")), "array<float>")
    v = _vectors(s, d).withColumn("blob", encode("vector")).withColumn("again", decode("blob"))
    return v.select("id", F.length("blob").alias("n_bytes"), (F.col("again") == F.col("vector")).alias("equal"))


def _entities(s, d) -> DataFrame:
    """(key, term): invented names, which are written with a capital, of each message."""
    m = turns.messages(table(s, d, "turns"))
    return m.select(F.col("event_id").alias("key"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Z][a-z]{4,}"), F.lit(0)))).alias("term"))


def edge_shared_entity(s, d):
    """Messages that name the same things, one for each."""
    return graph.pairs(graph.shared(_entities(s, d))).select("src", "dst", F.col("n").cast("double").alias("weight"))


def edge_keyword(s, d):
    """Messages that share rare terms, by the share of their rare terms."""
    m = turns.messages(table(s, d, "turns"))
    t = m.select(F.col("event_id").alias("key"), F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).where(F.char_length("term") >= 2)
    return graph.keyword_edges(graph.shared(t)).select("src", "dst", F.round("weight", 9).alias("weight"))


def jaccard(s, d):
    """Distance of the names in each user message and the one before in its session; null where either names none."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Z][a-z]{4,}"), F.lit(0)))
    m = turns.messages(table(s, d, "turns")).where("role = 'user'").withColumn("names", names)
    n = neighbours(m, ["session_id"], F.substring("created_at", 1, 10), ["sequence"], F.col("names"))
    a, b = F.col("names"), F.col("value_before")
    j = F.when((F.size(a) > 0) & (F.size(b) > 0), 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return n.select("event_id", F.round(j, 9).alias("distance"))


def _named(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))


def _message_edges(s, d) -> DataFrame:
    """Edges between messages: what PageRank and paths from messages can reach."""
    from anamnesis.plans import conversation as C

    edges = _named(C.edge_reply(s, d), "reply").unionByName(_named(C.edge_adjacent(s, d), "adjacent"))
    return edges.unionByName(_named(edge_shared_entity(s, d), "shared_entity")).unionByName(_named(edge_keyword(s, d), "keyword"))


def _episode_members(s, d) -> DataFrame:
    """Each episode, named after its first event, and each of its events, found by their places in the session."""
    from anamnesis.plans import episodes as E

    e = E.readable_events(s, d).select("session_id", "event_id", F.col("instant.sec").alias("sec"), F.col("instant.nano").alias("nano"), "sequence")
    place = ordinal(e, ["session_id"], F.floor(F.col("sec") / 86400), ["sec", "nano", "sequence", "event_id"], "place").select("session_id", "event_id", "place")
    first = cut_tree(E.episode_nodes(s, d), F.col("limit_s")).select(F.col("first_event").alias("event_id"), "n_events").join(place, "event_id")
    held = first.select("session_id", F.concat(F.lit("episode:"), "event_id").alias("src"), F.explode(F.sequence("place", F.col("place") + F.col("n_events") - 1)).alias("place"))
    return held.join(place, ["session_id", "place"]).select("src", F.col("event_id").alias("dst"), F.lit(1.0).alias("weight"))


def _replacements(s, d) -> DataFrame:
    """Each claim and the one that replaced it."""
    n = neighbours(_claims(s, d), ["user_id"], F.unix_date(F.to_date("valid_from")), ["valid_from", "event_id"], F.col("event_id"))
    claim = lambda c: F.concat(F.lit("claim:"), F.col(c).cast("string"))
    return n.where("value_after is not null").select(claim("event_id").alias("src"), claim("value_after").alias("dst"), F.lit(1.0).alias("weight"))


def _edges(s, d) -> DataFrame:
    """All kinds that the tables give. Vectors, episodes and claims have ids of their own, so no path joins them to messages."""
    vector = lambda c: F.concat(F.lit("vec:"), F.col(c).cast("string")).alias(c)
    alike = edge_mutual_topk(s, d).select(vector("src"), vector("dst"), "weight")
    edges = _message_edges(s, d).unionByName(_named(alike, "mutual_topk")).unionByName(_named(_episode_members(s, d), "episode_member"))
    return edges.unionByName(_named(_replacements(s, d), "replacement"))


def graph_edges(s, d):
    """A1: all edges, one for each kind and unordered pair."""
    return graph.folded(_edges(s, d))


def graph_nodes(s, d):
    """G1: message, session and entity nodes."""
    m = turns.messages(table(s, d, "turns"))
    e = graph.shared(_entities(s, d)).select("term").distinct()
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("source_id"))
    return (
        m.select(node("message", F.col("event_id")).alias("n"))
        .union(m.select("session_id").distinct().select(node("session", F.col("session_id"))))
        .union(e.select(node("entity", F.col("term"))))
        .select("n.kind", "n.source_id", F.sha2(F.concat_ws("\u001f", "n.kind", "n.source_id"), 256).alias("node_id"))
    )


def graph_report(s, d):
    """Edges of every kind that is computed, also of those that have none."""
    kinds = s.range(1).select(F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    n = graph_edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n_edges"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def graph_scope(s, d):
    """A10: message nodes of each session and edges that touch them."""
    m = turns.messages(table(s, d, "turns")).select("event_id", "session_id")
    e = graph.folded(_message_edges(s, d))
    ends = e.select("kind", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("event_id"))
    touched = ends.join(m, "event_id").select("session_id", "kind", "src", "dst").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes")).join(touched, "session_id", "left").select("session_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def scope_entities(s, d):
    """Names that a session's user or assistant messages use, each once."""
    m = turns.messages(table(s, d, "turns")).select(F.col("event_id").alias("key"), "session_id", "role")
    e = _entities(s, d).join(m, "key")
    return e.where("role = 'user'").select("session_id", "term").union(e.where("role = 'assistant'").select("session_id", "term")).distinct()


def _steps_and_seeds(s, d):
    steps = cut(graph.transitions(_message_edges(s, d)))
    first = turns.messages(table(s, d, "turns")).where("sequence = 1").select(F.col("event_id").alias("node"))
    n = first.agg(F.count(F.lit(1)).alias("n"))
    return steps, cut(first.join(F.broadcast(n)).select("node", (1 / F.col("n")).alias("mass")))


def ppr(s, d):
    """Scores at convergence, from the first message of every session."""
    steps, seeds = _steps_and_seeds(s, d)
    return graph.pagerank(steps, seeds).select("node", F.round("score", 9).alias("score"))


def ppr_questions(s, d):
    """For every question the messages near its best candidates, whose mass is one over their rank, scaled to one.

    Replies, neighbours and shared entities are the edges; keyword edges have no bounded degree.
    """
    c = conv_bm25(s, d).where(F.col("rank") <= SEEDS)
    mass = (1 / F.col("rank")) / F.sum(1 / F.col("rank")).over(Window.partitionBy("query_id"))
    seeds = cut(c.select("query_id", F.col("event_id").alias("node"), mass.alias("mass")))
    edges = _message_edges(s, d).where("kind <> 'keyword'")
    ranked = graph.pagerank_by_query(edges, seeds).select("query_id", "node", F.round("score", 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= GRAPH_TOP)


def best_path(s, d):
    """T5: the best path of at most two hops to every message."""
    return graph.best_paths(*_steps_and_seeds(s, d))


def shortest_leaf(s, d):
    """Of the stored clauses that hold a character of an event, the shortest; asked for every clause's middle."""
    c = table(s, d, "source_clauses").where("clause_id is not null and event_id is not null and end_char > start_char").dropDuplicates(["clause_id"])
    asked = c.select("event_id", F.col("clause_id").alias("asked"), F.floor((F.col("start_char") + F.col("end_char")) / 2).cast("int").alias("at"))
    held = c.select("event_id", "clause_id", "start_char", "end_char")
    met = asked.join(held, "event_id").where("start_char <= at and at < end_char")
    return met.groupBy("asked").agg(F.min_by("clause_id", F.struct(F.col("end_char") - F.col("start_char"), "clause_id")).alias("leaf"))


def doc_asof(s, d):
    """whether all messages of a session lie before a cutoff."""
    m = turns.messages(table(s, d, "turns"))
    return m.groupBy("session_id").agg(F.bool_and(F.col("created_at") <= CUTOFF).alias("visible"), F.count(F.lit(1)).alias("n"))


def _claims(s, d):
    """One claim per change of a user's event type, valid until the next."""
    e = table(s, d, "events").where("user_id is not null and event_type is not null and ts is not null")
    day = F.unix_date(F.to_date("ts"))
    n = neighbours(e.select("event_id", "user_id", "event_type", "ts"), ["user_id"], day, ["ts", "event_id"], F.col("event_type"))
    changed = n.where("value_before is null or value_before <> event_type").select("event_id", "user_id", "event_type", "ts")
    return neighbours(changed, ["user_id"], day, ["ts", "event_id"], F.col("ts")).select("event_id", "user_id", "event_type", F.col("ts").alias("valid_from"), F.col("value_after").alias("valid_to"))


def claims_asof(s, d):
    """Claims valid at the middle of each month of 2024, by object."""
    months = F.array(*[F.to_timestamp(F.lit(f"2024-{m:02d}-15")) for m in range(1, 13)])
    c = _claims(s, d).withColumn("at", F.explode(F.filter(months, lambda t: (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))))
    return c.groupBy(F.month("at").alias("month_no"), "event_type").agg(F.count(F.lit(1)).alias("n_users"))


def claim_transitions(s, d):
    """Created and replaced claims of each user."""
    c = _claims(s, d)
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_created"), F.count("valid_to").alias("n_replaced"))


_CJK = CJK.encode().decode("unicode_escape")


def tokens_sql(x: str) -> str:
    """Words, and 2- and 3-grams of CJK runs; a run of one character is a token."""
    plain = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')"
    grams = lambda n: f"list_transform(range(1, length(r) - {n} + 2), lambda i: r[i:i + {n} - 1])"
    runs = f"list_transform(regexp_extract_all({plain}, '[{_CJK}]+'), lambda r: case when length(r) = 1 then [r] else list_concat({grams(2)}, {grams(3)}) end)"
    return f"list_concat(regexp_extract_all(regexp_replace({plain}, '[{_CJK}]', ' ', 'g'), '[^ ]+'), flatten({runs}))"


Q_ = f"q as (select id query_id, min(question) q from eval_cases where id is not null and question is not null group by 1), qt as (select distinct query_id, unnest({tokens_sql('q')}) term from q)"


def _bm25_sql(src: str, key: str, name: str = "kb") -> str:
    """Every term of a question; k1 = 1.2, b = 0.75."""
    return f"""
  {name}t as (select {key}, {tokens_sql('text')} t from {src}),
  {name}p as (select {key}, term, count(*) tf, any_value(len) len from (select {key}, len(t) len, unnest(t) term from {name}t) group by 1, 2),
  {name}z as (select count(*) n, avg(len) mean from {name}t, lateral (select len(t) len) where len > 0),
  {name}i as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf, mean from (select term, count(*) df from {name}p group by 1), {name}z),
  {name}s as (select query_id, {key}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) score from {name}p join {name}i using (term) join qt using (term) group by 1, 2),
  {name} as (select query_id, {key}, score, rank from (select *, row_number() over (partition by query_id order by score desc, {key}) rank from {name}s) where rank <= {TOP})"""


KB_ = f"with {Q_}, {_bm25_sql('(select doc_id, text from documents where text is not null)', 'doc_id')}"
CH_ = KB_ + f""", {_bm25_sql('(select doc_id, title as text from documents where title is not null)', 'doc_id', 'ti')},
  ch as (select query_id, doc_id, rank, 'text' channel from kb union all select query_id, doc_id, rank, 'title' from ti)"""
V_ = "v as (select vec_id id, label, embedding::double[] e from embeddings where vec_id is not null and embedding is not null), u as (select id, label, e, sqrt(list_dot_product(e, e)) n, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) u from v)"
_POOL = V_ + ", f as (select id, label, unnest(range(len(u)))::int pos, unnest(u) x from u), s as (select label, pos, sum({w} * x) x from f group by 1, 2) select label, pos, round(x / sqrt(sum(x * x) over (partition by label)), 6) as value from s"
E_ = M_ + """,
  en as (select distinct event_id key, unnest(regexp_extract_all(content, '[A-Z][a-z]{4,}')) term from m),
  ek as (select key, term from en join (select term from en group by 1 having count(*) between 2 and 32) using (term)),
  se as (select a.key src, b.key dst, count(*)::double weight from ek a join ek b using (term) where a.key < b.key group by 1, 2)"""
CL_ = """e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) b from events),
  c as (select event_id, user_id, event_type, ts valid_from, lead(ts) over (partition by user_id order by ts, event_id) valid_to from e where b is null or b <> event_type)"""
KW_ = f"""
  kt as (select distinct event_id key, unnest({tokens_sql('content')}) term from m),
  kk as (select key, term from kt join (select term from kt where length(term) >= 2 group by 1 having count(*) between 2 and 32) using (term)),
  kz as (select key, count(*) n from kk group by 1),
  kp as (select a.key src, b.key dst, count(*) n from kk a join kk b using (term) where a.key < b.key group by 1, 2),
  kw as (select src, dst, round(kp.n / (x.n + y.n - kp.n), 9) weight from kp join kz x on src = x.key join kz y on dst = y.key)"""
MU_ = f"""
  vx as (select a.id q, b.id r, round(list_dot_product(a.e, b.e), 6) s from v a join v b on a.id <> b.id),
  vk as (select * from (select *, row_number() over (partition by q order by s desc, r) n from vx) where n <= {NEIGHBOURS} and s >= {LEAST_COSINE}),
  mu as (select a.q src, a.r dst, a.s weight from vk a join vk b on a.q = b.r and a.r = b.q where a.q < a.r)"""
#: Edges between messages; then all kinds, folded.
ME_ = f"""{E_}, {KW_},
  ad as (select event_id src, lead(event_id) over (partition by session_id order by sequence) dst from m where regexp_matches(content, '[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}]')),
  re as (select event_id src, lag(event_id) over (partition by session_id order by sequence) dst from m),
  me as (select 'reply' kind, src, dst, 1.0::double weight from re where dst is not null union all select 'adjacent', src, dst, 1.0 from ad where dst is not null
    union all select 'shared_entity', src, dst, weight from se union all select 'keyword', src, dst, weight from kw)"""
_FOLD = "select kind, least(src, dst) src, greatest(src, dst) dst, round(sum(weight), 9) weight, count(*) n_parts from {} group by 1, 2, 3"
ED_ = f"""{ME_}, {V_}, {MU_}, {EVENTS_}, {RUNS_.format(lim='lim')}, {CL_.replace('e as (', 'ce as (', 1).replace(' from e where', ' from ce where')},
  em as (select 'episode:' || first_value(event_id) over (partition by session_id, run order by us, seq, event_id) src, event_id dst from r),
  rp as (select 'claim:' || event_id src, 'claim:' || lead(event_id) over (partition by user_id order by valid_from, event_id) dst from c),
  ed as (from me union all select 'mutual_topk', 'vec:' || src, 'vec:' || dst, weight from mu union all select 'episode_member', src, dst, 1.0 from em
    union all select 'replacement', src, dst, 1.0 from rp where dst is not null),
  fo as ({_FOLD.format('ed')})"""
ST_ = ME_ + """,
  bo as (select src, dst, sum(weight) weight from (select src, dst, weight from me union all select dst, src, weight from me) group by 1, 2),
  sp as (select src, dst, weight / sum(weight) over (partition by src) p from bo),
  sd as (select event_id node, 1.0 / count(*) over () mass from m where sequence = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        term_df, kb_bm25, conv_bm25, rrf, channel_status, seed_mass, subqueries, vec_normalize, vec_audit, cosine, vec_mean, vec_pool,
        vector_topk, edge_mutual_topk, vec_codec, edge_shared_entity, edge_keyword, jaccard, graph_edges, graph_nodes, graph_report,
        graph_scope, scope_entities, ppr, ppr_questions, best_path, shortest_leaf, doc_asof, claims_asof, claim_transitions,
    )
}
ORACLES = {
    "term_df": f"select term, count(distinct doc_id) df from (select doc_id, unnest({tokens_sql('text')}) term from documents) group by 1",
    "kb_bm25": f"{KB_} select * from kb",
    "conv_bm25": f"with {M_}, {Q_}, {_bm25_sql('(select event_id, content as text from m)', 'event_id')} select * from kb",
    "rrf": f"{CH_}, f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) score from ch group by 1, 2) select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from f) where rank <= {TOP}",
    "channel_status": f"{CH_}, x as (select query_id, unnest(['text', 'title']) channel from q), n as (select query_id, channel, count(*) n from ch group by 1, 2) select query_id, channel, coalesce(n, 0) n, case when n > 0 then 'complete' else 'empty' end status from x left join n using (query_id, channel)",
    "seed_mass": f"{CH_}, x as (select query_id, doc_id, (1.0::double / rank) / sum(1.0::double / rank) over (partition by query_id, channel) s from ch), n as (select query_id, count(distinct channel) k from ch group by 1) select query_id, doc_id, round(sum(s / k), 9) mass from x join n using (query_id) group by 1, 2",
    "subqueries": f"with {Q_}, a as (select query_id, q, list_filter(regexp_split_to_array(q, '[、,，]| and '), lambda x: trim(x, ' ') <> '') items from q), b as (select query_id, case when len(items) >= 3 then list_concat([q], list_transform(items, lambda x: trim(x, ' '))) else [q] end a from a) select query_id, unnest(range(len(a)))::int pos, sha256(unnest(a)) sub_sha256 from b",
    "vec_normalize": f"with {V_} select id, round(n, 6) norm, round(list_sum(u), 6) unit_sum from u",
    "vec_audit": f"with {V_} select case when len(e) = 0 then 'empty' when isnan(n) or isinf(n) then 'not_finite' when abs(n - 1) > 1e-5 then 'not_unit' else 'good' end state, len(e)::int dimensions, count(*) n, count(distinct id) n_ids from u group by 1, 2",
    "cosine": f"with {V_} select a.id, round(greatest(-1.0, least(1.0, list_dot_product(a.e, b.e) / (a.n * b.n))), 6) cosine from u a join u b on b.id = a.id + 1",
    "vec_mean": f"with {_POOL.format(w='1.0::double')}",
    "vec_pool": f"with {_POOL.format(w='(id % 7 + 1)')}",
    "vector_topk": f"with {V_}, x as (select a.id query_id, b.id row_id, round(list_dot_product(a.e, b.e), 6) similarity from v a join v b on a.id <> b.id where a.id % 50 = 0) select * from (select *, row_number() over (partition by query_id order by similarity desc, row_id) rank from x) where rank <= {TOP}",
    "edge_mutual_topk": f"with {V_}, {MU_} select * from mu",
    "edge_shared_entity": f"with {E_} select * from se",
    "edge_keyword": f"with {M_}, {KW_} select * from kw",
    "jaccard": f"with {M_}, x as (select event_id, list_distinct(regexp_extract_all(content, '[A-Z][a-z]{{4,}}')) a, session_id, sequence from m where role = 'user'), y as (select *, lag(a) over (partition by session_id order by sequence) b from x) select event_id, case when len(a) > 0 and len(b) > 0 then round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) end distance from y",
    "graph_edges": f"with {ED_} select * from fo",
    "graph_nodes": f"with {E_}, nd as (select 'message' kind, event_id source_id from m union all select distinct 'session', session_id from m union all select distinct 'entity', term from ek) select kind, source_id, sha256(kind || chr(31) || source_id) node_id from nd",
    "graph_report": f"with {ED_}, k as (select unnest({list(KINDS)}) kind), nk as (select kind, count(*) n, round(sum(weight), 6) w from fo group by 1) select kind, coalesce(n, 0) n_edges, coalesce(w, 0.0)::double weight from k left join nk using (kind)",
    "graph_scope": f"with {ME_}, fo as ({_FOLD.format('me')}), x as (select distinct session_id, kind, src, dst from fo join m on event_id = src or event_id = dst), tt as (select session_id, count(*) n_edges from x group by 1) select session_id, count(*) n_nodes, coalesce(any_value(n_edges), 0) n_edges from m left join tt using (session_id) group by 1",
    "scope_entities": f"with {E_} select distinct session_id, term from en join m on key = event_id",
    "best_path": f"with {ST_}, z as (select node seed, node target, 0 hops, mass quality from sd), o as (select seed, dst target, 1 hops, max(quality * p) quality from z join sp on target = src where dst <> seed group by 1, 2), w as (select seed, dst target, 2 hops, max(quality * p) quality from o join sp on target = src where dst <> seed group by 1, 2), a as (select seed, target, hops, round(quality, 9) quality from (select * from z union all select * from o union all select * from w)) select seed, target, hops, quality from (select *, row_number() over (partition by target order by quality desc, hops, seed) r from a) where r = 1",
    "shortest_leaf": "with c as (select distinct clause_id, event_id, start_char, end_char from source_clauses where clause_id is not null and event_id is not null and end_char > start_char), x as (select a.clause_id asked, b.clause_id leaf, row_number() over (partition by a.clause_id order by b.end_char - b.start_char, b.clause_id) k from c a join c b on a.event_id = b.event_id and b.start_char <= (a.start_char + a.end_char) // 2 and (a.start_char + a.end_char) // 2 < b.end_char) select asked, leaf from x where k = 1",
    "doc_asof": f"with {M_}, x as (select m.*, created_at from m join t on split_part(event_id, ':', 1) = t.id) select session_id, bool_and(created_at <= '{CUTOFF}') visible, count(*) n from x group by 1",
    "claims_asof": f"with {CL_}, mo as (select make_date(2024, unnest(range(1, 13))::int, 15)::timestamp as moment) select month(moment)::int as month_no, event_type, count(*) n_users from c join mo on valid_from <= moment and (valid_to is null or moment < valid_to) group by 1, 2",
    "claim_transitions": f"with {CL_} select user_id, count(*) n_created, count(valid_to) n_replaced from c group by 1",
}
