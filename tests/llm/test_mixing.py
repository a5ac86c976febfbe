import random

import numpy as np
import pytest

from anamnesis.llm import mixing
from anamnesis.llm.tokens import encoding


def test_classifier_tells_held_out_texts_apart():
    rng = random.Random(1)
    words = {"log": "error trace panic stack retry".split(), "memo": "dear team minutes agenda lunch".split()}
    make = lambda c: " ".join(rng.choice(words[c] + ["the", "a", "of"]) for _ in range(30))
    w = mixing.train([(make(c), c) for c in words for _ in range(40)] + [("x", "unknown")], list(words))
    ids = lambda t: encoding().encode_ordinary(t)
    p = mixing._posterior(np.stack([mixing.features(ids(make(c))) for c in words for _ in range(20)]), w)
    assert (p.argmax(1) == np.repeat([0, 1], 20)).mean() > 0.95
    assert np.allclose(mixing._posterior(np.stack([mixing.features([])]), mixing.train([], ["a", "b"])), 0.5)


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, source string, n_tokens long, m array<double>, cap int")


def test_shares_and_caps_hold(spark):
    rng, rows = random.Random(2), []
    for i in range(3000):
        s = rng.choice([0, 0, 0, 0, 1, 2])
        m = [1.0 if k == s else 0.0 for k in range(3)] if rng.random() < 0.9 else [0.2, 0.3, 0.5]
        rows.append((i, None if m[0] == 0.2 else "abc"[s], rng.randint(5, 400), m, [1, 3, 2][int(np.argmax(m))]))
    rows += [(9000, "unlisted", 100, [0.0, 0.0, 0.0], 0), (9000, "unlisted", 100, [0.0, 0.0, 0.0], 0)]
    shares = np.array([0.5, 0.3, 0.2])
    got, target = mixing.mix(frame(spark, rows), shares)
    got = got.collect()
    assert all(0 <= r.copies <= r.cap for r in got) and not any(r.copies for r in got if r.item_id == 9000)
    total = sum(np.array(r.m) * r.copies * r.n_tokens for r in got)
    assert np.abs(total / total.sum() - shares).max() < 0.005
    assert abs(total.sum() / target.sum() - 1) < 0.01


def test_nothing_and_one_source(spark):
    got, target = mixing.mix(frame(spark, []), np.array([0.5, 0.5]))
    assert got.count() == 0 and target.sum() == 0
    got, _ = mixing.mix(frame(spark, [(1, "a", 10, [1.0], 2), (2, "a", 10, [1.0], 2)]), np.array([1.0]))
    assert sorted(r.copies for r in got.collect()) == [2, 2]


def test_members_fold_copies_and_keep_unlabelled(spark):
    rows = [(1, "same text", None), (2, "same text", "a"), (3, "other", "z"), (4, None, "a"), (5, "", "a"), (6, "free", None)]
    df = spark.createDataFrame(rows, "item_id long, text string, source string")
    got = {r.item_id: (r.source, r.m) for r in mixing.members(df, ["a", "b"], mixing.train([], ["a", "b"])).collect()}
    # Without training the stored source is all the evidence there is.
    assert set(got) == {2, 3, 6} and got[2][1] == pytest.approx([0.999, 0.001]) and got[3] == ("z", [0.0, 0.0]) and got[6] == (None, [0.5, 0.5])
    assert mixing.members(df.limit(0), ["a"], mixing.train([], ["a"])).count() == 0


def test_a_stored_source_is_evidence_and_not_all_of_it(spark):
    sample = [("error trace panic stack retry", "log")] * 20 + [("dear team minutes agenda lunch", "memo")] * 20
    w = mixing.train(sample, ["log", "memo"])
    df = spark.createDataFrame([(1, "error trace panic stack retry", "log"), (2, "error trace panic stack retry again", "memo"), (3, "error trace panic stack", None)], "item_id long, text string, source string")
    m = {r.item_id: r.m for r in mixing.members(df, ["log", "memo"], w).collect()}
    assert m[1][0] > 0.999 > m[2][1] and m[3][0] > 0.8 and all(sum(x) == pytest.approx(1) for x in m.values())
