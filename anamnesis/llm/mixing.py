"""A mix of sources with target shares of the total size, by soft membership.

Every text belongs to the sources by the posterior of a classifier that is trained on labelled texts;
a stored source is evidence for it, right with probability TRUST, and not the whole of it. A text
without one has the classifier's posterior alone. Each distinct text i has a size t, a
membership m over the sources and a rate r, how often it is taken, from 0 to its cap. The rates
minimise the squared distance between the expected totals, sum of r t m, and the targets, by projected
gradient steps: r <- clip(r - m . G^-1 (totals - targets)), where G = sum of t m m' scales the step.
A step is one aggregation of as many sums as there are sources; rates are never stored, as the few
numbers of each step say how every rate came about. Rates are then rounded to whole copies and
what the rounding missed is made up for by texts drawn by their hash.

A text's features are the counts of its tokens and of pairs of them, of the tokenizer that also sizes it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.tokens import RANKS, encoding
from anamnesis.session import cut, spread

#: Bound of the classifier's training sample.
TEXTS_PER_SOURCE = 250
FEATURES = 4096
EPOCHS = 60
#: How likely a stored source is the right one, before the text is looked at.
TRUST = 0.999
#: Texts whose features a task holds at once.
HELD = 512
#: Most gradient steps, and the relative distance at which they end.
STEPS, NEAR = 30, 1e-9
#: Rounds that make up for rounding: by drawn texts, then by single ones.
REPAIRS, SINGLES = 5, 6


def features(ids: Sequence[int]) -> np.ndarray:
    """Hashed token ids and pairs of neighbours as a normed vector of square roots of counts."""
    a = np.asarray(ids, np.int64)
    pairs = (a[:-1] * 1_000_003 + a[1:] * 7919 + 1) % 2_147_483_647
    got = np.sqrt(np.bincount(np.concatenate((a, pairs)) % FEATURES, minlength=FEATURES)).astype(np.float32)
    return got / max(1e-9, float(np.linalg.norm(got)))


def _posterior(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(sample: list[tuple[str, str]], classes: Sequence[str], ranks: str = RANKS) -> np.ndarray:
    """Weights of a softmax regression, fitted with equal weight for each class; no sample gives even posteriors."""
    weights = np.zeros((FEATURES + 1, len(classes)), np.float32)
    sample = sorted(s for s in sample if s[1] in classes)
    if not sample:
        return weights
    x = np.stack([features(encoding(ranks).encode_ordinary(t)) for t, _ in sample])
    y = np.array([list(classes).index(c) for _, c in sample])
    share = 1 / np.maximum(1, np.bincount(y, minlength=len(classes)))[y]
    share = (share / share.sum())[:, None]
    velocity = np.zeros_like(weights)
    for _ in range(EPOCHS):
        p = _posterior(x, weights)
        p[np.arange(len(y)), y] -= 1
        p = (p * share).astype(np.float32)
        velocity = 0.9 * velocity - 20 * np.vstack([x.T @ p + 1e-6 * weights[:-1], p.sum(0)])
        weights += velocity
    return weights


def fit(texts: DataFrame, classes: Sequence[str], ranks: str = RANKS) -> np.ndarray:
    """Train on TEXTS_PER_SOURCE labelled texts of each class, by the hash of the id. texts: (item_id, text, source)."""
    labelled = texts.where(F.col("source").isin(list(classes)) & (F.char_length("text") > 0))
    w = Window.partitionBy("source").orderBy(F.xxhash64("item_id"), "item_id")
    ids = labelled.select("item_id", "source").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TEXTS_PER_SOURCE)
    # At most TEXTS_PER_SOURCE ids of each class: small enough to broadcast, so no text is shuffled.
    rows = labelled.join(F.broadcast(ids.select("item_id")), "item_id", "left_semi").select("text", "source").collect()
    return train([(r[0], r[1]) for r in rows], classes, ranks)


def members(texts: DataFrame, classes: Sequence[str], weights: np.ndarray, ranks: str = RANKS) -> DataFrame:
    """(item_id, source, n_tokens, m) of every distinct text that has tokens.

    m is the membership over the classes; its sum is one, but a text of an unlisted source has none.
    Of equal texts the one with a source, then with the least id, stands for all. Null and empty
    texts are left out; other columns are ignored; empty input gives no rows.
    """
    at, k = {c: i for i, c in enumerate(classes)}, len(classes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), HELD):
                part = b.iloc[i : i + HELD]
                ids = [encoding(ranks).encode_ordinary(t) for t in part["text"]]
                m = _posterior(np.stack([features(x) for x in ids]), weights).astype(float)
                for row, source in zip(m, part["source"]):
                    if source is None or source != source:
                        continue
                    row *= np.full(k, (1 - TRUST) / max(1, k - 1))
                    if source in at:
                        row[at[source]] *= TRUST * max(1, k - 1) / (1 - TRUST)
                        row /= row.sum()
                    else:
                        row[:] = 0
                yield pd.DataFrame({"text_key": part["text_key"], "item_id": part["item_id"], "source": part["source"], "n_tokens": [len(x) for x in ids], "m": m.tolist()})

    # Sized where they are read: what is shuffled to fold equal texts is their hash, never a text.
    sized = (
        spread(texts.where(F.char_length("text") > 0), "item_id")
        .select("item_id", "source", "text", F.sha2("text", 256).alias("text_key"))
        .mapInPandas(rows, "text_key string, item_id long, source string, n_tokens long, m array<double>")
    )
    first = F.min(F.struct(F.col("source").isNull().alias("no"), "item_id", "source", "n_tokens", "m")).alias("f")
    return sized.groupBy("text_key").agg(first).select("f.item_id", "f.source", "f.n_tokens", "f.m").where("n_tokens > 0")


def _rate(history: np.ndarray, m: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates after all steps; a step takes away the membership's part of it and keeps the rate within 0 and the cap."""
    rate = np.zeros(len(m))
    for step in history:
        rate = np.clip(rate - m @ step, 0, cap)
    return rate


def _reached(held: DataFrame, history: np.ndarray, k: int) -> np.ndarray:
    """Expected totals at the rates after all steps: k sums of each partition, added up."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k)
        for b in batches:
            if len(b):
                m = np.stack(b["m"].to_numpy())
                total += (_rate(history, m, b["cap"].to_numpy(float)) * b["n_tokens"].to_numpy(float)) @ m
        yield pd.DataFrame({"i": np.arange(k, dtype=np.int32), "total": total})

    rows = held.select("n_tokens", "m", "cap").mapInPandas(part, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    got = np.zeros(k)
    for r in rows:  # one row per source
        got[r["i"]] = r["total"]
    return got


def _array(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _totals(df: DataFrame, taken: Column, k: int) -> np.ndarray:
    row = df.agg(*[F.sum(taken * F.col("n_tokens") * F.col("m")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([float(x or 0.0) for x in row])


def rates(held: DataFrame, shares: np.ndarray) -> tuple[Column, np.ndarray, list[float]]:
    """(rate of a row, target totals, relative distance after each step).

    held: (n_tokens, m, cap). The total is the greatest that every source can fill within its caps.
    """
    k = len(shares)
    pair = [(i, j) for i in range(k) for j in range(i, k)]
    m, t = F.col("m"), F.col("n_tokens")
    row = held.agg(*[F.sum(t * m[i] * m[j]) for i, j in pair], *[F.sum(t * m[i] * F.col("cap")) for i in range(k)]).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(pair, row):
        gram[i, j] = gram[j, i] = float(x or 0.0)
    room = np.array([float(x or 0.0) for x in row[len(pair) :]])
    wanted = shares > 0
    total = float((room[wanted] / shares[wanted]).min()) if wanted.any() else 0.0
    target = shares * total
    inverse = np.linalg.pinv(gram, rcond=1e-10)
    history: list[np.ndarray] = [-(inverse @ target)]  # the first step, from rates of 0
    distance: list[float] = []

    for _ in range(STEPS):
        gap = _reached(held, np.array(history), k) - target
        distance.append(float(np.abs(gap).sum() / max(1.0, total)))
        if distance[-1] < NEAR or (len(distance) > 3 and distance[-1] > 0.999 * distance[-3]):
            break
        history.append(inverse @ gap)
    steps = np.array(history)

    @F.pandas_udf("double")
    def rate(m: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series(_rate(steps, np.stack(m.to_numpy()), cap.to_numpy(float)) if len(m) else [], dtype="float64")

    return rate("m", "cap"), target, distance


def _uniform(seed: int) -> Column:
    """A number from 0 to 1 that follows from the id alone."""
    return F.pmod(F.xxhash64(F.col("item_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def mix(held: DataFrame, shares: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Add rate and copies, whole numbers from 0 to cap; and the target totals.

    Texts without membership get none. Where a wanted source has no texts at all, nothing can be
    mixed to the targets and every text gets 0 copies. Empty input gives an empty mix; repeated rows
    are rows of their own.

    Each repair moves texts of a source that are no larger than an eighth of what it lacks or
    has too much, drawn so that the expected move is just that.
    """
    k = len(shares)
    rate, target, _ = rates(held, shares)
    # Whole copies and a draw for the rest: totals are met in the mean.
    now = held.withColumn("rate", rate).withColumn("_top", F.array_position("m", F.array_max("m")) - 1)
    now = cut(now.withColumn("copies", F.floor("rate") + F.when(_uniform(0) < F.col("rate") - F.floor("rate"), 1).otherwise(0)))
    for step in range(1, REPAIRS + 1):
        gap = _totals(now, F.col("copies"), k) - target
        if np.abs(gap).max() <= 1e-4 * max(1.0, target.sum()):
            break
        gaps = F.element_at(_array(gap), (F.col("_top") + 1).cast("int"))
        able = F.when(gaps < 0, (F.col("copies") < F.col("cap")) & (F.col("rate") > 0)).otherwise(F.col("copies") >= 1)
        able = able & (F.array_max("m") > 0) & (F.col("n_tokens") <= F.greatest(F.abs(gaps) / 8, F.lit(1.0)))
        sums = now.where(able).groupBy("_top").agg(F.sum("n_tokens").alias("n")).collect()  # one row per source
        chance = np.zeros(k)
        for r in sums:
            chance[int(r["_top"])] = min(1.0, abs(gap[int(r["_top"])]) / float(r["n"]))
        drawn = able & (_uniform(step) < F.element_at(_array(chance), (F.col("_top") + 1).cast("int")))
        now = now.withColumn("copies", F.col("copies") + F.when(drawn, F.when(gaps < 0, 1).otherwise(-1)).otherwise(0))
        if step % 3 == 0:
            now = cut(now)
    # What is left is less than a few texts: the one that fits best, of each source.
    for _ in range(SINGLES):
        now = cut(now)
        gap = _totals(now, F.col("copies"), k) - target
        gaps = F.element_at(_array(gap), (F.col("_top") + 1).cast("int"))
        able = F.when(gaps < 0, (F.col("copies") < F.col("cap")) & (F.col("rate") > 0)).otherwise(F.col("copies") >= 1)
        off = F.abs(F.col("n_tokens") - F.abs(gaps))
        best = (
            now.where(able & (F.array_max("m") > 0) & (off < F.abs(gaps)))
            .groupBy("_top")
            .agg(F.min_by("item_id", F.struct(off, F.col("item_id"))).alias("item_id"))
            .collect()  # one row per source
        )
        if not best:
            break
        picked = F.col("item_id").isin([r["item_id"] for r in best])
        now = now.withColumn("copies", F.col("copies") + F.when(picked, F.when(gaps < 0, 1).otherwise(-1)).otherwise(0))
    return now.drop("_top"), target
