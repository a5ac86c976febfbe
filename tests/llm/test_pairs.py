import pytest

from anamnesis.llm.pairs import defects, flag_pairs

CASES = [
    ("What changed?", "", "complete", "stop", "empty"),
    ("What changed?", None, None, None, "empty"),
    ("What changed?", "<think></think>\u200b", "complete", "stop", "empty"),
    ("What changed?", "N/A", "failed", None, "empty"),
    ("Which of the lists should I read first?", "Both.", "complete", "stop", None),
    ("Wie viele sind noch da?", "458.", "complete", "stop", None),
    ("Where are the old notes of the team?", "I'm sorry, but I can't help with that request", "complete", "stop", "refusal"),
    ("Where are the old notes of the team?", "I can't recommend one single way, so here are the facts. The notes are in the old index.", "complete", "stop", None),
    ("¿Dónde están las notas?", "Lo siento, pero no puedo ayudar con esa petición.", "complete", "stop", "refusal"),
    ("為什么?", "很遗憾，我不能讨论这个话题。", "complete", "stop", "refusal"),
    ("Where are the old notes of the team?", "You asked: Where are the old notes of the team?", "complete", "stop", "echo"),
    ("Where are the old notes of the team?", "where are the old notes of team", "complete", "stop", "echo"),
    ("Where are the old notes of the team?", "You asked: Where are the old notes of the team?\nThey are in the second archive.", "complete", "stop", None),
    ("Where are the old notes of the team?", "They are in the second archive, next to the", "complete", "stop", "truncated"),
    ("Where are the old notes of the team?", "They are in the second archive.", "truncated", "length", "truncated"),
    ("Where are the old notes of the team?", "Look here:\n```python\nfor x in y:\n", "complete", "stop", "truncated"),
    ("Where are the old notes of the team?", "Look here:\n```python\nx = 1\n```", "complete", "stop", None),
    ("Where are the old notes of the team?", "| a | b |\n|---|---|\n| c", "complete", "stop", "truncated"),
    ("Where are the old notes of the team?", "They are here.\n- The notes\n- The lists", "complete", "stop", None),
    ("Where are the old notes of the team?", "They are in the second archive. 🙂", "complete", "stop", None),
    ("Where are the old notes of the team?", "Sorry for the wait. Die Notizen liegen jetzt in einem ruhigen Ordner, weil sie zu groß sind.", "complete", "stop", "other_language"),
    ("Please answer in German: where are the notes of the team?", "Die Notizen liegen jetzt in einem ruhigen Ordner, weil sie zu groß sind.", "complete", "stop", None),
    ("¿Qué cambió hace dos semanas?", "Las fichas se escribieron a mano y por eso hay pequeñas diferencias.", "complete", "stop", None),
    ("Where are the notes?", "我们保留了十份，把剩下的旅行计划删掉了。", "complete", "stop", "other_language"),
]


@pytest.mark.parametrize("question,answer,status,reason,want", CASES)
def test_defect(question, answer, status, reason, want):
    got = defects(question, answer, status, reason)
    assert (got[0] if got else None) == want


def test_every_defect_is_named_and_long_texts_pass():
    assert defects("Where are the notes?", "I can't help with that", "truncated", "length") == ["refusal", "truncated"]
    assert defects(None, "word " * 200_000, None, None) == ["truncated"]


def test_length_changes_nothing():
    q, no = "Where are the old notes of the team?", "I can't help with that. "
    for n in (1, 3, 5, 6, 8, 40, 4000):
        assert defects(q, no * n, None, None) == ["refusal"]
        assert defects(q, (q + " ") * n, None, None) == ["echo"]
    assert defects(q, f"{no * 40}The notes are in the second archive.", None, None) == []
    long = " ".join(f"Please look at list {i} of the {i % 97} old ones and say what it holds." for i in range(400))
    assert defects(long, long.replace("list 7 ", "lists 7 "), None, None) == ["echo"]
    assert "echo" not in defects(long, long[::-1], None, None)
    assert defects("Combien d'entrées reste-t-il dans l'espace ?", "Combien d'entrées dans l'espace ?", None, None) == ["echo"]


def test_empty_and_cut_off_are_both_named():
    assert defects("Why?", " ", "truncated", "length") == ["empty", "truncated"]
    assert defects("Why?", "Both, I think.", "complete", "stop", "stream closed") == ["truncated"]
    assert defects("Why?", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", None, None) == ["truncated"]


def test_edit_distance_against_the_plain_table():
    import random

    from anamnesis.llm.pairs import _distance, _near

    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(1, 30)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 30))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.9)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert _distance(a, b) == row[-1]
        for most in (0, 1, 2, 5):
            assert _near(a, b, most) == (row[-1] <= most)


def test_frame(spark):
    schema = "turn_id string, question string, answer string, status string, reason string, error string, defects string"
    df = spark.createDataFrame([("a", None, None, None, None, None, "clash"), ("a", None, None, None, None, None, "clash"), ("b", "q", "Yes.", "complete", "stop", None, None), (None, "q", "", None, None, None, None)], schema)
    assert sorted((r.turn_id or "", r.defects) for r in flag_pairs(df).collect()) == [("", ["empty"]), ("a", ["empty"]), ("a", ["empty"])]
    assert flag_pairs(df.limit(0)).count() == 0
