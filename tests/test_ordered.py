import random

from pyspark.sql import functions as F

from anamnesis.operators.ordered import neighbours, ordinal

SCHEMA = "g string, t long, id string, v string"


def rows():
    rng = random.Random(2)
    out = [("hot", rng.randrange(5000), f"h{i:04d}", rng.choice([None, "x", "y"])) for i in range(400)]
    return out + [("cold", 3, "c", "z"), (None, 1, "n1", "a"), (None, 2, "n2", None)]


def test_ordinal_and_neighbours_equal_a_plain_scan(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    bucket = F.floor(F.col("t") / 100)
    number = {r.id: r.ordinal for r in ordinal(df, ["g"], bucket, ["t", "id"]).collect()}
    near = {r.id: (r.value_before, r.value_after) for r in neighbours(df, ["g"], bucket, ["t", "id"], F.col("v")).collect()}
    assert len(number) == len(near) == len(data)
    for g in ("hot", "cold", None):
        scan = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(scan):
            before = [x[3] for x in scan[:i] if x[3] is not None]
            after = [x[3] for x in scan[i + 1 :] if x[3] is not None]
            assert number[r[2]] == i
            assert near[r[2]] == (before[-1] if before else None, after[0] if after else None)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordinal(df, ["g"], F.col("t"), ["t"]).count() == 0
    assert neighbours(df, ["g"], F.col("t"), ["t"], F.col("v")).count() == 0
