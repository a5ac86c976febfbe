"""Vectors: norms, pools and exact nearest neighbours in blocks.

Search deals rows and queries out to blocks of about BLOCK vectors, whatever their numbers; a pair of
blocks multiplies two matrices and gives out only its k best per query, so what is shuffled is vectors
x blocks of the other side, never pairs. Vectors are widened to double before products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import width

#: Vectors of a side, about, that a task of the search holds at once.
BLOCK = 8192


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; null for a zero or non-finite one."""
    n = norm(v)
    return F.when((n > 0) & (n < F.lit(float("inf"))), F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pooled(rows: DataFrame, group: str, vector: str, weight: Column) -> DataFrame:
    """(group, pos, value): each group's weighted mean of unit vectors, at length one again."""
    flat = rows.select(group, weight.cast("double").alias("_w"), F.posexplode(unit(F.col(vector))).alias("pos", "x"))
    summed = flat.groupBy(group, "pos").agg(F.sum(F.col("_w") * F.col("x")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(group)))
    return summed.select(group, "pos", F.round(F.col("x") / length, 6).alias("value"))


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k rows most similar to each query, itself left out.

    queries: (id, vector), rows: (id, vector), unit vectors of one dimension. Ties go to the smaller id.
    """
    row_blocks = max(width(rows.sparkSession), math.ceil(rows.count() / BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = rows.select(mine(row_blocks).alias("rows_of"), every(query_blocks).alias("queries_of"), "id", "vector")
    asked = queries.select(every(row_blocks).alias("_r"), mine(query_blocks).alias("_q"), "id", "vector")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "row_id", "similarity"]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "row_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        r = r.sort_values("id")
        ids, m = r["id"].to_numpy(), np.stack(r["vector"].to_numpy()).astype(float)
        out = []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            s = np.round(np.stack(part["vector"].to_numpy()).astype(float) @ m.T, 6)
            s[part["id"].to_numpy()[:, None] == ids] = -np.inf
            take = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for i, qid in enumerate(part["id"]):
                out += [(qid, ids[j], s[i, j]) for j in take[i] if np.isfinite(s[i, j])]
        return pd.DataFrame(out, columns=names)

    got = asked.groupBy("_r", "_q").cogroup(held.groupBy("rows_of", "queries_of")).applyInPandas(best, "query_id long, row_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
