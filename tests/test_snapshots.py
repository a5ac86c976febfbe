import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import snapshots

SCHEMA = "source string, ordinal long, key string, content string, label string, block string"


def brute(rows, last):
    held = {}
    for s, o, k, c, *_ in rows:
        if s is None or o is None or k is None:
            continue
        at = held.setdefault((s, o), {})
        at[k] = min(at.get(k, c or ""), c or "") if k in at else c or ""
    out = set()
    for s, n in last.items():
        for o in range(1, n + 1):
            a, b = held.get((s, o - 1), {}), held.get((s, o), {})
            out |= {(s, o, k, "added") for k in b.keys() - a.keys()} | {(s, o, k, "removed") for k in a.keys() - b.keys()}
            out |= {(s, o, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


@pytest.mark.parametrize("mean,largest,block", [(64, 2048, 256), (3, 4, 2), (1, 1, 3)])
def test_changes_equal_brute_force(spark, monkeypatch, mean, largest, block):
    monkeypatch.setattr(snapshots, "MEAN_CHUNK", mean)
    monkeypatch.setattr(snapshots, "LARGEST", largest)
    monkeypatch.setattr(snapshots, "BLOCK", block)
    rng, rows, last = random.Random(mean), [], {}
    for s in ("a", "b"):
        now = {f"k{i}": "0" for i in range(60)}
        for o in range(7):
            for _ in range(5):
                k = f"k{rng.randrange(70)}"
                if rng.random() < 0.4:
                    now.pop(k, None)
                else:
                    now[k] = rng.choice([None, "0", "1", "2"])
            snap = {} if (s, o) == ("b", 3) else now  # an empty snapshot
            rows += [(s, o, k, c, "clash", "clash") for k, c in snap.items()]
            rows += [(s, o, k, c, "again", None) for k, c in list(snap.items())[:5]]
            last[s] = o
    rows += [(None, 1, "k", "c", None, None), ("a", None, "k", "c", None, None), ("a", 1, None, "c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    spans = spark.createDataFrame(list(last.items()), "source string, last_ordinal long")
    got = [tuple(r) for r in snapshots.changes(df, spans).select("source", "ordinal", "key", "change").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, last)


def test_nothing_gives_nothing(spark):
    df, spans = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "source string, last_ordinal long")
    assert snapshots.changes(df, spans).count() == 0


def test_only_rows_of_unmatched_chunks_are_joined(spark, monkeypatch):
    met = []
    held = snapshots.cut
    monkeypatch.setattr(snapshots, "cut", lambda df: met.append(held(df)) or met[-1])
    rows = [("a", o, f"{i:04d}", "x" if (o, i) != (1, 500) else "y", None, None) for o in (0, 1) for i in range(1000)]
    spans = spark.createDataFrame([("a", 1)], "source string, last_ordinal long")
    got = snapshots.changes(spark.createDataFrame(rows, SCHEMA), spans).collect()
    assert [tuple(r) for r in got] == [("a", 1, "0500", "changed")]
    assert 2 <= met[0].where("ordinal = 1").count() < 1000  # what no next snapshot holds is left out after it


def test_binary_contents_and_odd_keys(spark):
    rows = [("a", 0, "k\x00", bytearray(b"\xff\x00")), ("a", 1, "k\x00", bytearray(b"\xff\x01")), ("a", 0, "é" * 9000, None), ("a", 1, "é" * 9000, bytearray(b""))]
    df = spark.createDataFrame(rows, "source string, ordinal long, key string, content binary")
    got = snapshots.changes(df, spark.createDataFrame([("a", 1)], "source string, last_ordinal long")).collect()
    assert [tuple(r) for r in got] == [("a", 1, "k\x00", "changed")]
