import json

from pyspark.sql import functions as F

from anamnesis.sources import files
from anamnesis.streaming.sessions import advance


def test_documents_take_both_kinds_in_any_case(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, text in (("x.TXT", "one\ntwo"), ("a b/y.md", "三"), ("z.pdf", "no")):
        (tmp_path / name).write_text(text)
    got = {r.document_key: r.content for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"x.TXT": "one\ntwo", "a b/y.md": "三"}


def test_sessions_know_their_file(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"id": "s1", "turns": [{"id": "t1", "user_content": "hi", "usage": {"input_tokens": 3}}, {"id": "t2"}]}))
    (tmp_path / "s2.json").write_text(json.dumps({"id": "other", "turns": []}))
    df = files.sessions(spark, str(tmp_path))
    assert {r.id: r.named for r in df.collect()} == {"s1": True, "other": False}
    assert [(r.session_id, r.turn_no, r.id) for r in files.session_turns(df).collect()] == [("s1", 0, "t1"), ("s1", 1, "t2")]


def test_evaluation_sets(spark, tmp_path):
    p = tmp_path / "lm.json"
    p.write_text(json.dumps([{"question_id": "q_abs", "question_type": "temporal", "question": "?", "answer": "a", "haystack_dates": ["d1"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}]]}]))
    r = files.long_memory(spark, str(p)).first()
    assert r.question_class == "no_answer" and r.sessions[0].external_id == "s1" and r.sessions[0].messages[0].has_answer
    p = tmp_path / "bench.json"
    conversation = {"speaker_a": "A", "session_10": [{"speaker": "A", "dia_id": "D10:1", "text": "late"}], "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "early", "blip_caption": "a cat"}], "session_2_date_time": "1 May"}
    p.write_text(json.dumps([{"sample_id": "c", "conversation": conversation, "qa": [{"question": "?", "category": 5, "adversarial_answer": "b", "evidence": ["D2:1"]}]}]))
    q, m = files.conversation_benchmark(spark, str(p))
    assert (q.first().question_class, q.first().expected_answer) == ("no_answer", "b")
    assert [(r.session_no, r.content, r.occurred_at) for r in m.orderBy("session_no").collect()] == [(2, "early [a cat]", "1 May"), (10, "late", None)]


def test_writers_add_only_what_is_new(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    for write, name in ((files.write_new, "p"), (files.append_results, "j")):
        path = str(tmp_path / name)
        assert write(rows.dropDuplicates(), path, "k") == 2
        assert write(rows.union(spark.createDataFrame([("c", 3)], "k string, v int")).dropDuplicates(), path, "k") == 1


def test_a_stage_moves_only_its_own_watermark(spark):
    units = spark.createDataFrame([("s", 1), ("s", 2), ("t", 5)], "session_id string, sequence long")
    marks = spark.createDataFrame([("s", "facts", 1), ("s", "vectors", 2), ("u", "facts", 9)], "session_id string, stage string, through_sequence long")
    pending, moved = advance(units, marks, "facts")
    assert {tuple(r) for r in pending.collect()} == {("s", 2), ("t", 5)}
    assert {(r.session_id, r.stage, r.through_sequence) for r in moved.collect()} == {("s", "facts", 2), ("t", "facts", 5), ("u", "facts", 9), ("s", "vectors", 2)}
    assert pending.select(F.col("sequence")).count() == 2
