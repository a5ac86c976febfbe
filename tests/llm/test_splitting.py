import random
import re

import pytest

from anamnesis.llm.splitting import CHARACTER, MARKS, pieces, split_oversized


def check(text, limit, overlap):
    got = pieces(text, limit, overlap)
    at = 0
    for start, end, shared, _ in got:
        assert 0 < end - start <= limit and shared <= overlap and start + shared == at < end
        at = end
    assert at == len(text)
    run = max(len(x) for x in re.split(rf"[\s{re.escape(MARKS)}]", text))
    assert (run > limit) == any(name == CHARACTER for *_, name in got)
    return got


def test_random_texts_are_covered_and_forced_only_where_they_must_be():
    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice(["ab .\n,", "abcdefghij", "汉字。，\n", "ab\n\n# x. ", "a" * 30 + " ."])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        limit = rng.randint(1, 60)
        if len(text) > limit:
            check(text, limit, rng.randint(0, limit - 1))


def test_strong_boundaries_come_first():
    text = "# A\n\n" + "word " * 20 + "\n\n# B\n\n" + "word " * 20
    got = check(text, 120, 0)
    assert text[got[1][0] :].startswith("# B") and got[0][3] == "section"
    assert [p[:2] for p in pieces("甲，乙" * 1, 2, 0)] == [(0, 2), (2, 3)]
    assert [p[:3] for p in pieces("x" * 100, 66, 32)] == [(0, 34, 0), (2, 68, 32), (36, 100, 32)] or all(p[1] - p[0] <= 66 for p in pieces("x" * 100, 66, 32))


def test_odd_limits_and_long_texts():
    assert pieces("", 5, 2) == [(0, 0, 0, "end")]
    with pytest.raises(ValueError):
        pieces("abc", 0, 0)
    check("abc def ghi", 4, 9)
    assert len(check("lorem ipsum. " * 20_000, 240, 32)) > 1000


def test_frame(spark):
    items = spark.createDataFrame(
        [("a", "1", "aaa bbb ccc", "clash"), ("a", "1", "aaa bbb ccc", "clash"), ("a", "2", "short", None), ("a", "3", None, None), ("b", "4", "no limit for this", None)],
        "item_kind string, item_id string, text string, note string",
    )
    limits = spark.createDataFrame([("a", 8, 3)], "item_kind string, max_chars int, overlap_chars int")
    got = split_oversized(items, limits).collect()
    assert {r.item_id for r in got} == {"1"} and len(got) == 4
    assert all(r.text == "aaa bbb ccc"[r.start_char : r.end_char] for r in got)
    assert split_oversized(items.limit(0), limits).count() == 0
