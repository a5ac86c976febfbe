"""Queries that find nothing in the given tables, on tables with planted faults."""

from anamnesis.plans import conversation, evaluation, evidence

RECORD = "store_id string, sequence long, action string, target_kind string, target_id string, previous_record_sha256 string, record_sha256 string"


def test_control_log(spark, tmp_path):
    good = [("s", i, a, "event", "e", f"h{i - 1}" if i > 1 else None, f"h{i}") for i, a in ((1, "exclude"), (2, "restore"), (3, "exclude"))]
    bad = [("t", 1, "restore", "event", "e", None, "t1"), ("t", 2, "exclude", "event", "e", "other", "t2"), ("t", 4, "exclude", "event", "e", "t2", "t4")]
    rows = [*good, *good, *bad]
    spark.createDataFrame(rows, RECORD).write.parquet(f"{tmp_path}/control_records.parquet")
    assert sorted((r.store_id, r.sequence) for r in conversation.control_violations(spark, str(tmp_path)).collect()) == [("t", 1), ("t", 4)]
    assert sorted((r.sequence, r.fault) for r in conversation.control_chain(spark, str(tmp_path)).collect()) == [(2, "previous_hash"), (4, "sequence_gap")]


def test_evidence_of_two_contents_and_odd_roles(spark, tmp_path):
    message = lambda e, c, role="user": f"named_struct('role', '{role}', 'speaker', 'x', 'content', '{c}', 'evidence', named_struct('external_id', '{e}', 'source_session_id', 's', 'has_answer', true))"
    case = lambda *ms: f"array(named_struct('external_id', 's', 'occurred_at', 'x', 'messages', array({', '.join(ms)})))"
    spark.sql(f"select {case(message('e1', 'a'), message('e2', 'b'))} sessions union all select {case(message('e1', 'z'), message('e3', 'c', 'tool'))}").write.parquet(f"{tmp_path}/eval_cases.parquet")
    got = {r.evidence: (r.n_contents, r.n_odd_roles) for r in evaluation.evidence_audit(spark, str(tmp_path)).collect()}
    assert got == {"e1": (2, 0), "e3": (1, 1)}


def test_revisions_of_two_sources_and_odd_names(spark, tmp_path):
    name = "rev_" + "0a" * 32
    rows = [("a", True, [name, "rev_short"]), ("b", True, [name]), ("c", False, ["odd"])]
    spark.createDataFrame(rows, "source_id string, enabled boolean, active_revisions array<string>").write.parquet(f"{tmp_path}/source_states.parquet")
    assert {r.revision_id: r.n_sources for r in evaluation.revision_conflicts(spark, str(tmp_path)).collect()} == {name: 2, "rev_short": 1}


def test_two_events_of_one_number_and_prefixes(spark, tmp_path):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda s, e, q, mark, c, h=None: (s, e, q, mark, c, h or sha(c))
    rows = [row("a", "a1", 1, 2, "x"), row("a", "a1", 1, 2, "x"), row("a", "a2", 1, 2, "y"), row("b", "b1", 1, 1, "x", "wrong"), row("c", "c1", 1, 1, "x"), row("c", "c2", 2, 1, "y"), row("d", "d1", 1, None, "x")]
    spark.createDataFrame(rows, "session_id string, event_id string, sequence long, watermark_before long, content string, content_sha256 string").write.parquet(f"{tmp_path}/boundary_inputs.parquet")
    assert [tuple(r) for r in evidence.sequence_duplicates(spark, str(tmp_path)).collect()] == [("a", 1, 2)]
    assert {r.session_id: r.state for r in evidence.prefix_validity(spark, str(tmp_path)).collect()} == {"a": "valid", "b": "changed", "c": "stale", "d": "missing"}


def test_percentiles_against_sorted_lists(spark):
    import math
    import random

    rng = random.Random(6)
    rows = [(g, rng.choice([0.0, 0.0, 1.0, rng.random(), -rng.random() * 50, rng.random() * 9000])) for g in "ab" for _ in range(500)] + [("a", None), ("c", 7.0), ("d", None)]
    got = evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    want = {}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (v[math.ceil((len(v) - 1) * 0.5)], v[math.ceil((len(v) - 1) * 0.95)], len(v))
    assert {r.g: (r.p50, r.p95, r.n) for r in got} == want


def test_pagerank_of_each_query(spark):
    from anamnesis.operators import graph

    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("d", "e", 1.0), ("x", "y", 1.0), ("b", "a", 1.0)]
    seeds = [("q1", "a", 1.0), ("q2", "x", 0.5), ("q2", "alone", 0.5), ("q3", "lost", 1.0)]
    got = {}
    for r in graph.pagerank_by_query(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "query_id string, node string, mass double")).collect():
        got.setdefault(r.query_id, {})[r.node] = r.score
    assert set(got["q1"]) == {"a", "b", "c"} and set(got["q2"]) == {"x", "y", "alone"} and got["q3"] == {"lost": 1.0}
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in got.values())
    # a <-> b (weight 2), b <-> c (weight 2), restart 0.5: solved by hand.
    a = got["q1"]["a"]
    b = got["q1"]["b"]
    assert abs(a - (0.5 + 0.25 * b)) < 1e-5 and abs(b - 0.5 * (a + got["q1"]["c"])) < 1e-5
