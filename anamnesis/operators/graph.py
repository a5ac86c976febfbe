"""Edges between messages, their folding, and recall by personalised PageRank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import cut

#: Fixed values of the reference: texts that a shared term may have, and PageRank's restart.
LEAST_DF, MOST_DF, RESTART = 2, 32, 0.5
#: The reference's end of PageRank: the summed change that is small enough, and the most rounds.
TOLERANCE, MOST_ROUNDS = 1e-6, 50


def shared(posted: DataFrame) -> DataFrame:
    """Terms of (key, term) that between LEAST_DF and MOST_DF keys hold: the bound of every self join on terms."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(LEAST_DF, MOST_DF))
    return posted.join(df, "term").select("key", "term")


def pairs(kept: DataFrame) -> DataFrame:
    """(src, dst, n): keys that share n of the kept terms, src < dst. A term gives at most 32 * 31 / 2 pairs."""
    a, b = kept.select(F.col("key").alias("src"), "term"), kept.select(F.col("key").alias("dst"), "term")
    return a.join(b, "term").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def keyword_edges(kept: DataFrame) -> DataFrame:
    """(src, dst, weight): the shared share of both texts' kept terms."""
    size = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    p = pairs(kept)
    both = p.join(size.select(F.col("key").alias("src"), F.col("size").alias("a")), "src").join(
        size.select(F.col("key").alias("dst"), F.col("size").alias("b")), "dst"
    )
    return both.select("src", "dst", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("weight"))


def folded(edges: DataFrame) -> DataFrame:
    """One edge per (kind, unordered pair), weights added up."""
    return edges.groupBy("kind", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.round(F.sum("weight"), 9).alias("weight"), F.count(F.lit(1)).alias("n_parts")
    )


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): undirected edges both ways, with each node's weights scaled to one."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    w = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = w.groupBy("src").agg(F.sum("weight").alias("total"))
    return w.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))


def pagerank(steps: DataFrame, seeds: DataFrame, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, score) of the nodes that seeds (node, mass) reach; the masses add up to one, and so do the scores.

    It ends when the scores' summed change is at most tolerance, or after so many rounds. What nodes
    without edges hold, which can only be seeds, goes back to the seeds. A round is two joins and one
    aggregation, written to the checkpoint folder, which also survives the loss of an executor.
    """
    out = steps.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    mass = F.coalesce("mass", F.lit(0.0))
    score = cut(out.join(seeds, "node", "full_outer").select("node", mass.alias("mass"), F.coalesce("out", F.lit(False)).alias("out"), mass.alias("score"), F.lit(0.0).alias("before")))
    for _ in range(rounds):
        dangling = score.agg(F.sum(F.when(~F.col("out"), F.col("score")))).first()[0] or 0.0
        moved = score.where("score > 0").join(steps, score["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("in"))
        given = RESTART * F.col("mass") + (1 - RESTART) * (F.coalesce("in", F.lit(0.0)) + dangling * F.col("mass"))
        score = cut(score.join(moved, "node", "left").select("node", "mass", "out", given.alias("score"), F.col("score").alias("before")))
        if (score.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) <= tolerance:
            break
    return score.where("score > 0").select("node", "score")


def _rank_one(graph: pd.DataFrame, seeds: pd.DataFrame, rounds: int, tolerance: float) -> tuple[list, np.ndarray]:
    """Nodes and scores of one small graph of undirected edges; what nodes without edges hold goes back to the seeds."""
    nodes = sorted({*graph["src"], *graph["dst"], *seeds["node"]})
    at = {x: i for i, x in enumerate(nodes)}
    a, b = (np.array([at[x] for x in graph[c]], int) for c in ("src", "dst"))
    src, dst, w = np.concatenate((a, b)), np.concatenate((b, a)), np.tile(graph["weight"].to_numpy(float), 2)
    out = np.bincount(src, w, len(nodes))
    mass = np.bincount([at[x] for x in seeds["node"]], seeds["mass"].to_numpy(float), len(nodes))
    p, score = w / np.maximum(out[src], 1e-300), mass
    for _ in range(rounds):
        new = RESTART * mass + (1 - RESTART) * (np.bincount(dst, score[src] * p, len(nodes)) + score[out == 0].sum() * mass)
        change, score = np.abs(new - score).sum(), new
        if change <= tolerance:
            break
    return nodes, score


def pagerank_by_query(edges: DataFrame, seeds: DataFrame, hops: int = 2, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(query_id, node, score): PageRank from each query's own seeds, on the edges within so many hops of them.

    edges: (src, dst, weight), undirected; seeds: (query_id, node, mass), the masses of a query add up to
    one. Seeds are few and degrees are bounded (shared terms by MOST_DF), so a query's graph is small
    and one task may hold it; the graphs are found by joins and queries are dealt out to the tasks.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    met = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    near = seeds.select("query_id", "node").distinct()
    for _ in range(hops - 1):
        near = near.unionByName(near.join(met, near["node"] == met["src"]).select("query_id", F.col("dst").alias("node"))).distinct()
    held = near.join(met, near["node"] == met["src"]).select("query_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()
    asked = seeds.select(F.col("query_id").alias("of"), "node", "mass")
    kind = dict(seeds.dtypes)["query_id"]

    def rank(graph: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"query_id": graph["query_id"][:0], "node": graph["src"][:0], "score": pd.Series(dtype="float64")})
        nodes, score = _rank_one(graph, mine, rounds, tolerance)
        return pd.DataFrame({"query_id": mine["of"].iat[0], "node": nodes, "score": score})

    return held.groupBy("query_id").cogroup(asked.groupBy("of")).applyInPandas(rank, f"query_id {kind}, node string, score double").where("score > 0")


def best_paths(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(target, seed, hops, quality): the best path of at most two hops from any seed to each node.

    A path's quality is its seed's mass times the probabilities along it; ties go to fewer hops, then
    to the smaller seed.
    """
    zero = seeds.select(F.col("node").alias("seed"), F.col("node").alias("target"), F.lit(0).alias("hops"), F.col("mass").alias("quality"))
    hop = lambda paths, n: (
        paths.join(steps, paths["target"] == steps["src"])
        .where("dst <> seed")
        .groupBy("seed", F.col("dst").alias("target"))
        .agg(F.max(F.col("quality") * F.col("p")).alias("quality"))
        .select("seed", "target", F.lit(n).alias("hops"), "quality")
    )
    one = hop(zero, 1)
    every = zero.unionByName(one).unionByName(hop(one, 2)).withColumn("quality", F.round("quality", 9))
    w = Window.partitionBy("target").orderBy(F.desc("quality"), "hops", "seed")
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
