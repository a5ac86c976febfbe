import random
from collections import defaultdict

from pyspark.sql import functions as F

from anamnesis.operators.sessions import cut_tree, gap_tree

SCHEMA = "s string, e string, sec long, nano int, q long, entity string, gap int"


def brute(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = set()
    for s, events in by.items():
        events.sort(key=lambda r: (r[2], r[3], r[4] is not None, r[4] or 0, r[1]))
        first, n = events[0], 1
        for a, b in zip(events, events[1:]):
            if b[2] - a[2] - (b[3] < a[3]) > limit:
                out.add((s, first[1], a[1], n))
                first, n = b, 1
            else:
                n += 1
        out.add((s, first[1], events[-1][1], n))
    return out


def test_one_tree_serves_every_setting_at_any_partitioning(spark):
    rng, rows = random.Random(5), []
    for s, n in (("hot", 900), ("one", 1), ("two", 2), ("few", 30)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 5, 30, 30, 31, 3600])
            rows.append((s, f"{s}{i}", t, rng.choice([0, 0, 7]), rng.choice([None, 1, 2]), "clash", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            nodes = gap_tree(df, "s", "e", F.struct("sec", "nano"), "q").toPandas()
            for limit in (0, 4, 30, 31, 4000):
                got = nodes[(nodes.gap <= limit) & (nodes.parent_gap > limit)]
                found = list(zip(got.entity, got.first_event, got.last_event, got.n_events))
                assert len(found) == len(set(found)) and set(found) == brute(rows, limit)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_ties_and_nothing(spark):
    at = F.struct("sec", "nano")
    rows = [("a", "x", 10, 0, 1, None, None), ("a", "y", 10, 0, 1, None, None), (None, "n", 1, 0, 1, None, None), ("a", None, 1, 0, 1, None, None), ("a", "z", None, 0, 1, None, None)]
    got = cut_tree(gap_tree(spark.createDataFrame(rows, SCHEMA), "s", "e", at, "q"), F.lit(0)).collect()
    assert [(r.first_event, r.last_event, r.n_events) for r in got] == [("x", "y", 2)]
    assert gap_tree(spark.createDataFrame([], SCHEMA), "s", "e", at, "q").count() == 0


def test_fraction_is_dropped_and_equal_gaps_stay(spark):
    rows = [("a", "x", 0, 0, 1, None, None), ("a", "y", 1800, 900, 2, None, None), ("a", "z", 3601, 900, 3, None, None)]
    nodes = gap_tree(spark.createDataFrame(rows, SCHEMA), "s", "e", F.struct("sec", "nano"), "q")
    assert {(r.first_event, r.last_event) for r in cut_tree(nodes, F.lit(1800)).collect()} == {("x", "y"), ("z", "z")}


def test_gaps_that_are_equal_or_only_rise_or_fall(spark):
    """Equal gaps leave few segments open; those that must stay open go through many small groups."""
    from anamnesis.operators import sessions

    n, parts, sizes = 4000, 16, []
    shapes = {"equal": lambda i: 60, "rising": lambda i: i, "falling": lambda i: n - i, "valley": lambda i: abs(n // 2 - i), "hill": lambda i: n - abs(n // 2 - i)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    held, kept = sessions._merged, {}

    def merged(pieces):
        sizes.append({r[0]: r[1] for r in pieces.groupBy("chunk").count().collect()})
        return held(pieces)

    sessions._merged = merged
    try:
        for name, gap in shapes.items():
            t, rows = 0, []
            for i in range(n):
                t += gap(i)
                rows.append((name, f"{name}{i:05d}", t, 0, i, None, None))
            nodes = gap_tree(spark.createDataFrame(rows, SCHEMA), "s", "e", F.struct("sec", "nano"), "q").toPandas()
            for limit in (0, 59, 60, 1000, 2500, 3999):
                got = nodes[(nodes.gap <= limit) & (nodes.parent_gap > limit)]
                assert set(zip(got.entity, got.first_event, got.last_event, got.n_events)) == brute(rows, limit)
            kept[name] = sizes.pop()
    finally:
        sessions._merged = held
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(kept["equal"].values()) <= 4 * parts
    assert max(kept["rising"].values()) <= 2 * n // parts and len(kept["rising"]) > parts // 2
    assert max(kept["falling"].values()) <= 2 * n // parts
