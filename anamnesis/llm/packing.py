"""Texts into containers of fixed capacity with little unused space.

Every partition packs what it reads, in one pass and without a shuffle: it keeps OPEN windows per
kind of container, puts an item into the window that it leaves the least space in, and if none has
room gives out the fullest window and opens another. What is still open at the end of a partition is
merged: those windows are items themselves, at most OPEN per partition and kind. The windows of FAN
partitions are packed again, largest first, in one task; its OPEN emptiest windows go on to the next
level, where FAN such tasks meet, and all others are given out. So no task ever merges more than
FAN * OPEN windows of a kind, however many partitions there are. Only an item over the capacity is
parted, into full containers and one rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.tokens import RANKS, count
from anamnesis.session import cut

OPEN, FAN = 128, 64

PLACED = (
    "container_kind string, capacity long, container_id string, item_id long, part_no int, "
    "token_start long, n_tokens long, is_open boolean, task long"
)
#: A window (id) and the one it went into; that one's use, and whether it goes on to the next level.
MERGED = "container_kind string, capacity long, id string, into string, used long, is_open boolean, task long"
_NAMES = [x.split()[0] for x in PLACED.split(", ")]


class Packer:
    """The open windows of one kind in one partition; gives out (window, items) as they close."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open, self.made = capacity, most_open, 0
        self.room: list[tuple[int, int]] = []  # (free space, window), sorted
        self.items: dict[int, list] = {}

    def put(self, size: int, item) -> list[tuple[int, list]]:
        """Place an item of a size from 1 to the capacity; what closes by it."""
        at = bisect_left(self.room, (size, -1))
        closed = []
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most_open:
                _, fullest = self.room.pop(0)
                closed.append((fullest, self.items.pop(fullest)))
            free, window = self.capacity, self.made
            self.made += 1
            self.items[window] = []
        self.items[window].append(item)
        if free == size:
            closed.append((window, self.items.pop(window)))
        else:
            insort(self.room, (free - size, window))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return list(self.items.items())


def _place(kinds: Sequence[tuple[str, int]], ranks: str, most_open: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = {kind: Packer(capacity, most_open) for kind, capacity in kinds}
        out: list[tuple] = []

        def give(kind: str, capacity: int, closed: list, is_open: bool) -> None:
            for window, items in closed:
                out.extend((kind, capacity, f"{task}-{window}", *item, is_open, task) for item in items)

        for b in batches:
            for item, text in zip(b["item_id"].tolist(), b["text"].tolist()):
                size = count(text, ranks)
                for kind, capacity in kinds:
                    for part, start in enumerate(range(0, size, capacity)):
                        n = min(capacity, size - start)
                        give(kind, capacity, packers[kind].put(n, (item, part, start, n)), False)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=_NAMES)
                out = []
        for kind, capacity in kinds:
            give(kind, capacity, packers[kind].rest(), True)
        yield pd.DataFrame(out, columns=_NAMES)

    return rows


def _merge(most_open: int):
    def packed(held: pd.DataFrame) -> pd.DataFrame:
        """Pack windows (container_kind, capacity, id, used, task) of one kind again, largest first."""
        held = held.sort_values(["used", "id"], ascending=[False, True])
        kind, capacity, task = held["container_kind"].iat[0], int(held["capacity"].iat[0]), int(held["task"].iat[0])
        packer, windows = Packer(capacity, len(held)), []
        for used, x in zip(held["used"].tolist(), held["id"].tolist()):
            windows += packer.put(int(used), (x, int(used)))
        windows = [(sum(u for _, u in items), [x for x, _ in items]) for _, items in [*windows, *packer.rest()]]
        windows.sort(key=lambda w: (w[0], w[1][0]))
        out = [(kind, capacity, x, f"m-{ids[0]}", used, i < most_open and used < capacity, task) for i, (used, ids) in enumerate(windows) for x in ids]
        return pd.DataFrame(out, columns=[x.split()[0] for x in MERGED.split(", ")])

    return packed


def pack(texts: DataFrame, kinds: Sequence[tuple[str, int]], ranks: str = RANKS, most_open: int = OPEN) -> DataFrame:
    """(container_kind, capacity, container_id, item_id, part_no, token_start, n_tokens) of every placed text.

    texts: (item_id, text). A null or empty text has no tokens and is placed nowhere; repeated ids
    are placed each time. kinds: (name, capacity in tokens), a small list. No kinds or no texts give no rows.
    """
    placed = cut(texts.select("item_id", "text").mapInPandas(_place(list(kinds), ranks, most_open), PLACED))
    open_ = placed.where("is_open")
    left = open_.groupBy("container_kind", "capacity", F.col("container_id").alias("id"), "task").agg(F.sum("n_tokens").alias("used"))
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    moved = None
    while True:
        tasks = -(-tasks // FAN)
        met = left.withColumn("task", F.floor(F.col("task") / FAN))
        step = cut(met.groupBy("container_kind", "capacity", "task").applyInPandas(_merge(most_open), MERGED))
        if moved is None:
            moved = step.select("container_kind", "id", "into")
        else:
            again = step.select("container_kind", F.col("id").alias("into"), F.col("into").alias("last"))
            moved = moved.join(again, ["container_kind", "into"], "left").select("container_kind", "id", F.coalesce("last", "into").alias("into"))
        if tasks == 1:
            break
        left = step.where("is_open").select("container_kind", "capacity", F.col("into").alias("id"), "task", "used").distinct()
    columns = [c for c in _NAMES if c not in ("is_open", "task")]
    done = placed.where("not is_open").select(columns)
    merged = (
        open_.withColumnRenamed("container_id", "id")
        .join(moved, ["container_kind", "id"])
        .withColumnRenamed("into", "container_id")
        .select(columns)
    )
    return done.unionByName(merged)
