import random

import pytest
from pyspark.sql import functions as F

from anamnesis.llm import packing, tokens
from anamnesis.llm.packing import Packer, pack


def test_bounded_windows_waste_little():
    rng = random.Random(3)
    sizes = [rng.choice([1, 5, 40, 130, 300, 511, 512]) for _ in range(4000)]
    p, closed, most = Packer(512, 32), [], 0
    for i, s in enumerate(sizes):
        closed += p.put(s, (i, s))
        most = max(most, len(p.room))
    closed += p.rest()
    assert most <= 32 and sorted(i for _, items in closed for i, _ in items) == list(range(4000))
    assert all(sum(s for _, s in items) <= 512 for _, items in closed)
    assert sum(sizes) / (512 * len(closed)) > 0.97


def test_tokenizer_round_trip():
    text = "Grüße, 世界! don't  stop\n"
    ids = tokens.encoding().encode_ordinary(text)
    assert tokens.encoding().decode(ids) == text and tokens.count(text) == len(ids) and tokens.count(None) == tokens.count("") == 0


def test_many_partitions_merge_in_small_tasks_and_stay_full(spark, monkeypatch):
    """96 partitions over three levels: no merge takes more than FAN * OPEN windows, and little space is left."""
    monkeypatch.setattr(packing, "FAN", 4)
    taken, held = [], packing.cut

    def watched(df):
        df = held(df)
        if "into" in df.columns:
            taken.append(df.groupBy("container_kind", "task").count().agg(F.max("count"), F.count(F.lit(1))).first())
        return df

    monkeypatch.setattr(packing, "cut", watched)
    rng = random.Random(8)
    rows = [(i, "word " * rng.choice([1, 3, 9, 20, 33, 50, 63])) for i in range(6000)]
    df = spark.createDataFrame(rows, "item_id long, text string").repartition(96)
    got = pack(df, [("k", 64)], most_open=8).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(taken) == 4 and all(most <= 4 * 8 for most, _ in taken) and [n for _, n in taken] == [24, 6, 2, 1]
    total = sum(tokens.count(t) for _, t in rows)
    assert sum(r.n for r in got) == total and max(r.n for r in got) <= 64
    whole = Packer(64, len(rows))  # all items at once, largest first
    n_whole = sum(len(whole.put(n, n)) for n in sorted((tokens.count(t) for _, t in rows), reverse=True)) + len(whole.rest())
    assert len(got) <= 1.06 * n_whole


@pytest.mark.parametrize("fan", [64, 2])
def test_frame(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), "clash") for i in range(80)] + [(90, None, "x"), (91, "", "x"), (92, "long " * 700, "x"), (5, "word word", "again")]
    df = spark.createDataFrame(rows, "item_id long, text string, container_id string").repartition(4)
    got = pack(df, [("small", 64), ("large", 256)], most_open=4).collect()
    for kind, capacity in (("small", 64), ("large", 256)):
        mine = [r for r in got if r.container_kind == kind]
        used, whole = {}, {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            whole.setdefault(r.item_id, []).append((r.part_no, r.token_start, r.n_tokens))
        assert max(used.values()) <= capacity and not {90, 91} & whole.keys()
        assert set(whole) == {i for i, t, _ in rows if t}
        total = sum(tokens.count(t) for _, t, _ in rows)
        assert sum(used.values()) == total and len(used) <= total / capacity * 1.25 + 1
        for i, parts in whole.items():
            if i == 5:
                continue
            parts.sort()
            size = tokens.count(dict((a, b) for a, b, _ in rows)[i])
            assert [p[1] for p in parts] == list(range(0, size, capacity)) and sum(p[2] for p in parts) == size
    assert pack(df.limit(0), [("small", 64)]).count() == 0 and pack(df, []).count() == 0
    assert df.where(F.col("text").isNull()).count() == 1
