import pytest
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.operators import control, graph, lexical, turns, vectors
from anamnesis.plans.conversation import INPUT, TRIM, WARN
from anamnesis.plans.evaluation import percentiles


def test_budget_numbers():
    assert (INPUT, int(INPUT * TRIM), int(INPUT * WARN)) == (28160, 22528, 25344)


def test_percentile_is_the_upper_place(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 3.0, 4.0)], "g string, v double")
    assert percentiles(df, ["g"], "v", {"p": 0.5}).first().p == 3.0


def test_text_forms(spark):
    df = spark.createDataFrame([("甲，乙。 The  an-swer! A",), ("",), (None,)], "t string")
    got = df.select(T.normal_answer(F.col("t")).alias("a"), T.raw_clauses(F.col("t")).alias("c"), T.title(F.lit("x" * 41)).alias("t")).collect()
    assert got[0].a == "甲，乙。 swer" or got[0].a == "甲，乙。 an swer" or got[0].a.endswith("swer")
    assert "".join(got[0].c) == "甲，乙。 The  an-swer! A" and got[1].c == [] and got[0].t == "x" * 40 + "…"
    starts = spark.createDataFrame([(240,), (241,), (640,)], "n int").select(T.window_starts(F.col("n")).alias("s")).collect()
    assert [r.s for r in starts] == [None, [0, 1], [0, 200, 400]]


def test_messages_number_turns_and_drop_stale_states(spark):
    turn = "id string, session_id string, created_at string, updated_at string, status string, user_content string, assistant_content string, thinking string, usage struct<input_tokens:long,output_tokens:long,total_tokens:long>, done_reason string, error string"
    rows = [
        ("t2", "s", "2024-01-02T00:00:00.000Z", "2", "complete", "u2", "a2", None, None, None, None),
        ("t1", "s", "2024-01-01T00:00:00.000Z", "1", "pending", "u1", None, None, None, None, None),
        ("t1", "s", "2024-01-01T00:00:00.000Z", "3", "complete", "u1", "a1", None, None, None, None),
        ("t3", "s", "2024-01-03T00:00:00.000Z", "1", "blocked", "u3", None, None, None, None, None),
        (None, "s", "2024-01-03T00:00:00.000Z", "1", "complete", "u", None, None, None, None, None),
    ]
    m = turns.messages(spark.createDataFrame(rows, turn)).orderBy("sequence").collect()
    assert [(r.sequence, r.role, r.content) for r in m] == [(1, "user", "u1"), (2, "assistant", "a1"), (3, "user", "u2"), (4, "assistant", "a2"), (5, "user", "u3")]
    assert turns.messages(spark.createDataFrame([], turn)).count() == 0


def test_control_log(spark):
    cols = "store_id string, sequence long, action string, target_kind string, target_id string, record_sha256 string, previous_record_sha256 string"
    rows = [("s", 1, "exclude", "event", "e", "h1", None), ("s", 1, "exclude", "event", "e", "h1", None), ("s", 2, "exclude", "event", "e", "h2", "h1"), ("s", 4, "exclude", "session", "x", "h4", "bad"), ("s", 3, "restore", "event", "e", "h3", "h2")]
    log = spark.createDataFrame(rows, cols)
    assert {(r.target_id, r.action) for r in control.state(log).collect()} == {("e", "restore"), ("x", "exclude")}
    assert {(r.sequence, r.fault) for r in control.chain_faults(log).collect()} == {(4, "previous_hash")}
    assert [(r.sequence, r.action) for r in control.illegal_transitions(log).collect()] == [(2, "exclude")]
    shown = spark.createDataFrame([("e", "s1"), ("f", "x"), ("g", "s1")], "event_id string, session_id string")
    assert {r.event_id for r in control.visible(shown, log).collect()} == {"e", "g"}


def test_rare_terms_only_make_edges(spark):
    rows = [(f"m{i}", "common") for i in range(40)] + [("m1", "rare"), ("m2", "rare"), ("m3", "once")]
    kept = graph.shared(spark.createDataFrame(rows, "key string, term string"))
    assert [(r.src, r.dst, r.n) for r in graph.pairs(kept).collect()] == [("m1", "m2", 1)]
    assert graph.keyword_edges(kept).first().weight == 1.0


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    steps, seeds = graph.transitions(edges), spark.createDataFrame([("a", 1.0)], "node string, mass double")
    scores = {r.node: r.score for r in graph.pagerank(steps, seeds, 4).collect()}
    assert sum(scores.values()) == pytest.approx(1.0) and scores["a"] > scores["b"] > scores["c"]
    paths = {r.target: (r.hops, r.quality) for r in graph.best_paths(steps, seeds).collect()}
    assert paths == {"a": (0, 1.0), "b": (1, 1.0), "c": (2, pytest.approx(2 / 3))}


def test_bm25_and_fusion(spark):
    texts = spark.createDataFrame([(1, "red cat"), (2, "red red dog"), (3, None), (4, "blue bird"), (5, "")], "id long, t string")
    q = spark.createDataFrame([("q", "red"), ("q", "cat"), ("z", "nothing")], "query_id string, term string")
    got = [(r.id, r.rank) for r in lexical.bm25(texts, q, "id", "t", 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    ranked = spark.createDataFrame([("q", 1, "a", 1), ("q", 2, "a", 2), ("q", 2, "b", 1)], "query_id string, id int, channel string, rank int")
    assert [r.id for r in lexical.fuse(ranked, "id", 5).orderBy("rank").collect()] == [2, 1]


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.row_id for r in vectors.nearest(df.where("id < 5"), df, 3).collect()}
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    assert got == {(q, k + 1): int(np.argsort(-s[q], kind="stable")[k]) for q in range(5) for k in range(3)}
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "id long, vector array<double>")
    assert zero.select(vectors.unit(F.col("vector")).alias("u")).first().u is None
