"""Postings, document frequency, BM25 and rank fusion as joins and aggregations.

BM25 is Okapi's with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Every term of a
query counts, however frequent. Scores are rounded to six digits, so that the order of summing can't
change a rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import tokens
from anamnesis.session import cut, width

K1, B = 1.2, 0.75
#: Most queries and texts, about, that a task of BM25 holds at once.
QUERY_BLOCK, TEXT_BLOCK = 16384, 4096


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): a term's count in each text, counted within the row, so nothing is shuffled."""
    t = texts.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("_t"))
    return (
        t.select(key, F.size("_t").alias("length"), F.explode(F.array_sort("_t")).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    )


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def statistics(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, df, total): texts that hold each asked term, and in the row without a term all texts with their words' number.

    words: (tokens), one row for each text. One pass, which is combined on the map side.
    """
    flat = words.where(F.size("tokens") > 0).select(
        F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("tokens").alias("length")
    )
    found = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total"))
    return found.where("term is null").unionByName(found.join(asked.select("term").distinct(), "term", "left_semi"))


def bm25(texts: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k best texts of every query, over every term of it.

    texts: one row for each key; other columns are ignored, null texts left out. queries: (query_id,
    term), distinct. A null or empty query has no terms and no result. Ties go to the smaller key.

    A frequent term meets every query that has it, so neither pairs nor postings are shuffled: texts
    are dealt out to blocks as lists of their tokens' hashes (64 bits), queries with their weights go
    to every block, and each block adds up its scores and gives out its k best per query.
    """
    words = texts.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("tokens"))
    stats = cut(statistics(words, queries))
    whole = stats.where("term is null").first()
    n, mean = (whole["df"], whole["total"] / whole["df"]) if whole else (0, 1.0)
    query_blocks = math.ceil(queries.agg(F.countDistinct("query_id")).first()[0] / QUERY_BLOCK) or 1
    text_blocks = max(width(texts.sparkSession), math.ceil(n / TEXT_BLOCK))
    every = lambda m, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(name)
    idf = stats.where("term is not null").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = (
        queries.join(idf, "term")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct(F.xxhash64("term").alias("code"), "idf")).alias("t"))
        .select("query_id", F.col("t.code").alias("code"), F.col("t.idf").alias("idf"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("_q"))
        .select("*", every(text_blocks, "_t"))
    )
    held = words.where(F.size("tokens") > 0).select(
        key, F.transform("tokens", lambda x: F.xxhash64(x)).alias("codes"), F.pmod(F.xxhash64(key), F.lit(text_blocks)).alias("_tp"), every(query_blocks, "_qp")
    )
    kinds = dict(queries.dtypes)["query_id"], dict(texts.dtypes)[key]

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": q["query_id"][:0], key: d[key][:0], "score": pd.Series(dtype="float64")})
        if not len(q) or not len(d):
            return nothing
        d = d.sort_values(key)
        length = d["codes"].str.len().to_numpy()
        codes, owner = np.concatenate(d["codes"].to_numpy()), np.repeat(np.arange(len(d)), length)
        known, first = np.unique(np.concatenate(q["code"].to_numpy()), return_index=True)
        weight = np.concatenate(q["idf"].to_numpy())[first]
        at = np.searchsorted(known, codes)
        met = known[np.minimum(at, len(known) - 1)] == codes
        pair, tf = np.unique(at[met] * len(d) + owner[met], return_counts=True)
        term, doc = pair // len(d), pair % len(d)
        part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        start, keys = np.searchsorted(term, np.arange(len(known) + 1)), d[key].to_numpy()
        ids, hits, scores = [], [], []
        for query, mine in zip(q["query_id"], q["code"]):
            spans = [slice(start[c], start[c + 1]) for c in np.searchsorted(known, mine)]
            s = np.bincount(np.concatenate([doc[x] for x in spans]), np.concatenate([part[x] for x in spans]), len(d))
            hit = np.flatnonzero(s)
            s = np.round(s[hit], 6)
            if len(hit) > k:  # ties of the last place stay until they are in order
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                hit, s = hit[near], s[near]
            take = np.lexsort((hit, -s))[:k]
            ids += [query] * len(take)
            hits.append(hit[take])
            scores.append(s[take])
        return pd.DataFrame({"query_id": ids, key: keys[np.concatenate(hits)], "score": np.concatenate(scores)}) if ids else nothing

    got = asked.groupBy("_q", "_t").cogroup(held.groupBy("_qp", "_tp")).applyInPandas(best, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(ranked: DataFrame, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, channel, rank): (query_id, key, score, rank)."""
    s = ranked.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
