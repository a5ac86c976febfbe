"""Whole results against plain Python, where the stored SQL has the cut that a query once had."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import lexical

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def plain_tokens(text):
    out = []
    for run in re.findall(rf"[{CJK}]+|[^\W_{CJK}]+", text.lower()):
        grams = [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
        out += (grams or [run]) if re.match(f"[{CJK}]", run) else [run]
    return sorted(out)


def test_cjk_runs_give_grams(spark):
    texts = ["会議の予算はいくらですか。Budget 2024年", "我", "한국어 text混合abc東京都", "plain words, words", "", "未" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokens(F.col("t")).alias("a")).collect()
    assert [sorted(r.a) for r in sorted(got)] == [plain_tokens(t) for t in texts]
    mixed = spark.createDataFrame([("Budget予算is",)], "t string").select(T.mixed_tokens(F.col("t")).alias("a")).first().a
    assert mixed == ["budget", "予", "算", "is"]


def test_cjk_question_meets_a_text_that_shares_a_part(spark):
    texts = spark.createDataFrame([(1, "昨日の会議は長かった。"), (2, "天気がよい。")], "id long, t string")
    q = spark.createDataFrame([("q", "会議はいつですか")], "query_id string, q string").select("query_id", F.explode(F.array_distinct(T.tokens(F.col("q")))).alias("term"))
    assert [r.id for r in lexical.bm25(texts, q, "id", "t", 5).collect()] == [1]


@needs_data
def test_bm25_scores_every_term(spark):
    from anamnesis.plans import recall

    texts = {r.doc_id: Counter(plain_tokens(r.text)) for r in recall._documents(spark, FOLDER).where("text is not null").distinct().collect()}
    texts = {i: c for i, c in texts.items() if c}
    n, df = len(texts), Counter(t for c in texts.values() for t in c)
    mean = sum(c.total() for c in texts.values()) / n
    want = set()
    for q in recall._questions(spark, FOLDER).collect():
        terms = set(plain_tokens(q.q))
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
        s = {i: round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in terms if c[t]), 6) for i, c in texts.items() if terms & c.keys()}
        want |= {(q.query_id, i, k + 1) for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[: recall.TOP])}
    got = {(r.query_id, r.doc_id, r["rank"]) for r in recall.kb_bm25(spark, FOLDER).collect()}
    assert got == want


def test_bm25_of_nothing_nulls_and_clashing_columns(spark):
    texts = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "a b", None), (5, "a " * 30000, "x")], "id long, t string, score string")
    q = spark.createDataFrame([("q", "a"), ("q", "zzz"), (None, "b")], "query_id string, term string")
    got = lexical.bm25(texts, q, "id", "t", 2).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {("q", 1), ("q", 2), (None, 1), (None, 2)} and all(r.id > 2 for r in got)
    assert lexical.bm25(texts.limit(0), q, "id", "t", 2).count() == 0 and lexical.bm25(texts, q.limit(0), "id", "t", 2).count() == 0


def test_bm25_in_many_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "common " + "x " * (i % 7) + ("rare" if i == 50 else "")) for i in range(90)], "id long, t string")
    q = spark.createDataFrame([(f"q{i}", t) for i in range(9) for t in ("common", "rare")], "query_id string, term string")
    run = lambda: {tuple(r) for r in lexical.bm25(texts, q, "id", "t", 4).collect()}
    one = run()
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 5)
    assert run() == one and len(one) == 36 and {r[1] for r in one if r[3] == 1} == {50}


@needs_data
def test_graph_has_every_kind_that_the_tables_give(spark):
    from anamnesis.plans import episodes, recall

    edges = recall.graph_edges(spark, FOLDER).collect()
    n = Counter(r.kind for r in edges)
    assert {r.kind: r.n_edges for r in recall.graph_report(spark, FOLDER).collect()} == {k: n[k] for k in recall.KINDS}
    assert n["keyword"] == recall.edge_keyword(spark, FOLDER).count() and n["mutual_topk"] == recall.edge_mutual_topk(spark, FOLDER).count()
    assert n["replacement"] == recall.claim_transitions(spark, FOLDER).agg(F.sum("n_replaced")).first()[0]
    sizes = {r.start_event_id: r.n_events for r in episodes.p5_sessions(spark, FOLDER).collect()}
    ends = [r.src if r.src.startswith("episode:") else r.dst for r in edges if r.kind == "episode_member"]
    assert Counter(e.removeprefix("episode:") for e in ends) == sizes
    reached = {r.node for r in recall.ppr(spark, FOLDER).collect()}
    assert {e for r in edges if r.kind == "keyword" and {r.src, r.dst} & reached for e in (r.src, r.dst)} <= reached


def test_pagerank_converges_and_keeps_dangling_mass(spark):
    from anamnesis.operators import graph

    names = [f"n{i}" for i in range(30)]
    edges = [(names[i], names[i + 1], 1.0 + i % 3) for i in range(29)] + [("n0", "n9", 4.0)]
    mass = {"n0": 0.4, "n5": 0.1, "alone": 0.5}
    way = {}
    for a, b, w in edges:
        way.setdefault(a, {})[b] = w
        way.setdefault(b, {})[a] = w
    rank, rounds = dict(mass), 0
    while True:
        new = {n: 0.5 * (mass.get(n, 0) + sum(s for x, s in rank.items() if x not in way) * mass.get(n, 0)) for n in [*names, "alone"]}
        for n, s in rank.items():
            for to, w in way.get(n, {}).items():
                new[to] += 0.5 * s * w / sum(way[n].values())
        change, rank, rounds = sum(abs(new[n] - rank.get(n, 0)) for n in new), new, rounds + 1
        if change <= 1e-6:
            break
    steps = graph.transitions(spark.createDataFrame(edges, "src string, dst string, weight double"))
    got = {r.node: r.score for r in graph.pagerank(steps, spark.createDataFrame(list(mass.items()), "node string, mass double")).collect()}
    assert rounds > 4 and got == pytest.approx({n: s for n, s in rank.items() if s > 0}, abs=1e-12) and sum(got.values()) == pytest.approx(1.0)


def test_gap_states_follow_the_profile(spark, tmp_path):
    from anamnesis.plans import evaluation

    held = "session_id string, profile_id string, event_id string, created_at string, previous_user_created_at string, content string, previous_user_content string, cosine_similarity double"
    row = lambda e, profile, now, content="so": ("s", profile, e, f"2024-01-01T{now}Z", "2024-01-01T00:00:00Z", content, "so", 0.9)
    rows = [row("a", "kiosk", "00:12:00"), row("b", "kiosk", "00:13:00"), row("c", "classroom", "00:44:00"), row("d", "classroom", "00:46:00"), row("e", "none", "00:31:00"), row("f", "classroom", "00:01:00", "A New Topic, please")]
    spark.createDataFrame(rows, held).write.parquet(f"{tmp_path}/boundary_inputs.parquet")
    limits = [("kiosk", 1, 30), ("kiosk", 2, 12), ("classroom", 2, 45)]
    spark.createDataFrame(limits, "profile_id string, config_version int, episode_gap_minutes int").write.parquet(f"{tmp_path}/memory_configs.parquet")
    last = lambda f: {r[0]: r[-1] for r in f(spark, str(tmp_path)).collect()}
    below, above = "below_threshold", "greater_than_threshold"
    assert last(evaluation.gap_state) == {"a": "equal_to_threshold", "b": above, "c": below, "d": above, "e": above, "f": below}
    assert last(evaluation.boundary_class) == {"a": "none", "b": "gap", "c": "none", "d": "gap", "e": "gap", "f": "cue"}
    assert last(evaluation.boundary_votes) == {"a": False, "b": True, "c": False, "d": True, "e": True, "f": True}


@needs_data
def test_case_scores_against_plain_python(spark):
    from anamnesis.plans import evaluation as E

    ranked = {}
    for r in E._ranking(spark, FOLDER).where("rank <= 10").orderBy("id", "rank").collect():
        ranked.setdefault(r.id, []).append(r)
    marks = re.compile(r"[!-/:-@\[-`{-~]")
    plain = lambda t: " ".join(w for w in marks.sub(" ", t.lower()).split() if w not in ("a", "an", "the"))
    want = {}
    for c in E._cases(spark, FOLDER).collect():
        top = ranked.get(c.id, [])
        said, ids = plain(top[0].content) if top else "", {r.evidence for r in top}
        refused = said == "no answer"
        right = refused if c.expected_answer is None else said == plain(c.expected_answer)
        of = lambda kind, v: v if c.question_class == kind else None  # noqa: B023, E731
        met = lambda a: len(ids & set(a or ()))  # noqa: B023, E731
        want[c.id] = (right, of("temporal", right), of("conflict_update", right), refused, of("no_answer", refused), met(c.gold_evidence), met(c.stale_evidence) > 0 if c.stale_evidence else None, of("no_answer", met(c.negative_evidence) > 0))
    assert {r.id: tuple(r[x] for x in E.SCORES) for r in E.eval_score(spark, FOLDER).collect()} == want
