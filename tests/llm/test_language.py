import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import language as L
from anamnesis.llm.byte_cnn import LENGTH, ByteCNN, windows

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_found string"


def test_windows_cover_every_byte():
    texts = [b"", b"a", bytes(range(1, 65)), bytes(range(200)), b"z" * 129]
    x, owner = windows(texts, 32)
    assert x.shape[1] == LENGTH and set(owner) == set(range(5))
    for i, t in enumerate(texts):
        seen = x[owner == i]
        assert bytes(seen[0])[: len(t)].rstrip(b"\0") == t[:LENGTH].rstrip(b"\0")
        assert bytes(seen[-1]).rstrip(b"\0") == t[-LENGTH:].rstrip(b"\0")


def direct(net, x):
    """The layers one after the other, as in training."""
    return net._softmax(np.maximum(net._pooled(x)[0], 0) @ net.out + net.out_bias)


def test_looked_up_pairs_give_the_same_probabilities():
    net, rng = ByteCNN(tuple("abcdefgh")), np.random.default_rng(4)
    x = rng.integers(0, 256, (300, LENGTH)).astype(np.uint8)
    x[5, 3:] = 0
    x[6] = 0
    x[7, -2:] = 9  # only the shorter filters reach the last places with their last bytes
    assert np.abs(net.probabilities(x) - direct(net, x)).max() < 2e-3 and net.probabilities(x[:0]).shape == (0, 8)


def test_gradients_equal_differences():
    net, rng = ByteCNN(("a", "b", "c")), np.random.default_rng(1)
    net.embedding, net.filters = net.embedding.astype(float), [f.astype(float) for f in net.filters]
    x, y = rng.integers(1, 256, (3, LENGTH)).astype(np.uint8), np.array([0, 1, 2])
    loss = lambda: -np.log(direct(net, x)[np.arange(3), y]).mean()
    grads = net._gradients(x, y)
    for p, g in ((net.filters[1], grads[2]), (net.embedding, grads[0])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step, held = 1e-4, p[at]
        p[at] = held + step
        up = loss()
        p[at] = held - step
        down = loss()
        p[at] = held
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05)


def test_sentences_leave_out_what_has_no_language():
    text = "# A heading here\nuser: The notes are kept in the old index.\n```\nfor x in y: print(x)\n```\n[915842] 0xcad5067a jashudfyr.velnur:100\n| a | b |\n我们保留了661份，把剩下的删掉了。 (\"les notes\")\nles notes"
    assert [w for *_, w in L.sentences(text)] == ["The notes are kept in the old index.", "我们保留了661份，把剩下的删掉了。"] or [w[:9] for *_, w in L.sentences(text)] == ["The notes", "我们保留了 份，把"]
    assert L.sentences("") == [] and L.sentences("0000 ---\n\n") == []


def test_labels(spark):
    want = {"EN": "en", "en_US": "en", "zh-Hans": "zh", "German": "de", "français": "fr", "Portuguese": "pt", "ja-JP": "ja", "chinese (simplified)": "zh", "it": "other", "mul": None, "und": None, "?": None, "": None, " ": None, None: None, "en,fr": None}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", L.label_language(F.col("l")).alias("x"))
    assert {r.l: r.x for r in df.collect()} == want


@pytest.fixture(scope="module")
def net(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 0")
    return L.fit(docs)


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 1 and text <> ''")
    named = docs.withColumn("named", L.label_language(F.col("lang"))).where(F.col("named").isin(*L.LANGUAGES)).select("text", "named").collect()
    found = L.classify(net, [r.text for r in named])
    right = [r.named in {s[2] for s in f} for r, f in zip(named, found) if f]
    assert np.mean(right) > 0.85  # the rest are labels that are wrong


def test_stretches_and_frame(spark, net):
    de = "Die Notizen liegen jetzt in einem ruhigen Ordner, weil sie zu groß geworden sind. "
    en = "The meeting minutes were moved to the old index because the notes had grown too large. "
    got = L.classify(net, [de + en + en, "", de * 2000])
    assert [s[2] for s in got[0]] == ["de", "en"] and got[0][1][0] == len(de) - 1 or got[0][1][0] == len(de)
    short = L.classify(net, [f"{de}{en}"[:-2].replace(". ", " "), de[:-2]])
    assert [s[2] for s in short[1]] == ["de"] and set(s[2] for s in short[0]) <= {"de", "en"}
    assert got[1] == [] and [s[2] for s in got[2]] == ["de"] and all(0 <= s[3] <= 1 for g in got for s in g)
    df = spark.createDataFrame([(1, de, "en", "clash"), (1, de, "en", "clash"), (2, None, None, None), (3, "", "de", None)], SCHEMA)
    assert [(r.doc_id, r.lang_found) for r in L.segments(df, net).collect()] == [(1, "de"), (1, "de")]
    assert L.segments(df.limit(0), net).count() == 0
    assert L.fit(df.limit(0)).classes == L.LANGUAGES
