"""What changed between consecutive full snapshots.

Every snapshot is a key-sorted list of (key, digest of the record). It is parted into chunks whose
borders follow from the keys alone: a chunk begins at a key whose hash is divisible by the mean
chunk size, so that an unchanged stretch gives the same chunk in both snapshots whatever happened
before it. A chunk that the snapshot before holds too, digest for digest, is dropped; only the rows
of unmatched chunks are joined by key and classified.

Scale: all snapshots of a source are range-partitioned together by (source, block, key), so a
source of any size lies in many partitions, and a partition border cuts both snapshots of a pair at
the same key. So a chunk and the one it may match lie in one partition, sorted by snapshot and key,
and one pass compares them: it holds two snapshots of a key range, and only rows of unmatched
chunks leave it. Full rows are shuffled once. A block is BLOCK consecutive snapshots and the one
before them, so a key that a source delivers very often is cut up as well. Chunks are also cut at
LARGEST rows, as a snapshot's keys may happen to have no border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut, width

MEAN_CHUNK = 64
LARGEST = 2048
BLOCK = 256


class _Snapshot:
    """The chunks of one snapshot in one partition: first key to digest, keys and contents."""

    def __init__(self, at: tuple, largest: int):
        self.at, self.largest, self.chunks, self.last = at, largest, {}, None
        self.keys: list = []
        self.contents: list = []

    def add(self, key: str, content, border: bool) -> None:
        if key == self.last:
            return  # several rows of a key: the least content came first
        if border or len(self.keys) >= self.largest:
            self.close()
        self.keys.append(key)
        self.contents.append(content)
        self.last = key

    def close(self) -> None:
        if self.keys:
            digest = hashlib.sha256()
            for key, content in zip(self.keys, self.contents):
                k, c = key.encode("utf-8", "surrogatepass"), content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass")
                digest.update(b"%d:%d:" % (len(k), len(c)) + k + c)
            self.chunks[self.keys[0]] = digest.digest(), self.keys, self.contents
            self.keys, self.contents = [], []


def _unmatched(block: int, largest: int):
    """Rows of chunks that the snapshot before (is_now) or the next one (not is_now) lacks; input as sorted by changes.

    A row that the next snapshot lacks gets the next one's ordinal. The base of a block, its first
    ordinal less one, only stands for the snapshot before; what follows its last one is in the next block.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def give(chunks: dict, others: dict, source, ordinal: int, is_now: bool) -> None:
            for first, (digest, keys, contents) in chunks.items():
                if first not in others or others[first][0] != digest:
                    out.extend((source, ordinal, k, c, is_now) for k, c in zip(keys, contents))

        def compare(old: _Snapshot | None, new: _Snapshot | None) -> None:
            follows = old is not None and new is not None and new.at == (*old.at[:2], old.at[2] + 1)
            if old is not None and old.at[2] + 1 < (old.at[1] + 1) * block:
                give(old.chunks, new.chunks if follows else {}, old.at[0], old.at[2] + 1, False)
            if new is not None and new.at[2] >= max(1, new.at[1] * block):
                give(new.chunks, old.chunks if follows else {}, new.at[0], new.at[2], True)

        def frame() -> pd.DataFrame:
            got = pd.DataFrame(out, columns=["source", "ordinal", "key", "content", "is_now"])
            out.clear()
            return got

        old = new = None
        for b in batches:
            for *at, key, content, border in zip(b["source"].tolist(), b["block"].tolist(), b["ordinal"].tolist(), b["key"].tolist(), b["content"].tolist(), b["border"].tolist()):
                if new is None or new.at != tuple(at):
                    if new is not None:
                        new.close()
                        compare(old, new)
                    old, new = new, _Snapshot(tuple(at), largest)
                new.add(key, content, border)
            if len(out) >= 10_000:
                yield frame()
        if new is not None:
            new.close()
            compare(old, new)
            compare(new, None)
        yield frame()

    return rows


def changes(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, ordinal, key, change) of every key added, removed or changed against ordinal - 1.

    rows: (source, ordinal, key, content), the content a text or binary; rows of a null source, ordinal
    or key are left out, a null content counts as an empty one, and of several rows of a snapshot and
    key the least content counts. Other columns are ignored. spans: (source,
    last_ordinal); ordinals run from 0 without gap, and a snapshot without rows is an empty one.
    The first snapshot of a source gives no changes. Empty input gives none.
    """
    kind = dict(rows.dtypes)["content"]
    o, block = F.col("ordinal"), F.floor(F.col("ordinal") / BLOCK)
    clean = rows.where("source is not null and ordinal is not null and key is not null").select(
        F.col("source").cast("string").alias("source"),
        F.explode(F.when(o % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
        o.cast("long").alias("ordinal"),
        F.col("key").cast("string").alias("key"),
        F.coalesce("content", F.lit("").cast(kind)).alias("content"),
    )
    order = ["source", "block", "ordinal", "key", "content"]
    # Both sides of the join read it: the few rows of unmatched chunks are written once.
    met = cut(
        clean.repartitionByRange(width(rows.sparkSession), "source", "block", "key")
        .sortWithinPartitions(*order)
        .select(*order, (F.pmod(F.xxhash64("key"), F.lit(MEAN_CHUNK)) == 0).alias("border"))
        .mapInPandas(_unmatched(BLOCK, LARGEST), f"source string, ordinal long, key string, content {kind}, is_now boolean")
    )
    now = met.where("is_now").select("source", "ordinal", "key", F.col("content").alias("now"))
    before = met.where("not is_now").select("source", "ordinal", "key", F.col("content").alias("before"))
    before = before.join(spans, "source").where("ordinal <= last_ordinal").drop("last_ordinal")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return (
        now.join(before, ["source", "ordinal", "key"], "full_outer")
        .where("not (now <=> before)")
        .select("source", "ordinal", "key", change.alias("change"))
    )
