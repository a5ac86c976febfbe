"""Sessions by inactivity gaps, for any number of gap settings at once.

The gaps between consecutive events of an entity form a Cartesian tree: the greatest gap is the
root, and the parent of every other node is the smaller of the nearest greater gaps to its left
and right. Events are its leaves. A node stands for the run of events that hang under it, and for
a threshold t the sessions are exactly the nodes with gap <= t < gap of the parent. The tree is
built once; a setting is a filter over its nodes.

Entities may be of any size. Events are range-partitioned by (entity, instant), so that a hot
entity lies in many partitions. Each partition is one chunk and builds its trees in one pass with
the usual stack. Only the first and last entity of a chunk can go on in another; of these the
nodes on the left and right spine are still open (the parent may lie in another chunk), everything
else is final. Of a run of equal gaps on a spine only the first and the last stay open, as all
between them is final. So the open gaps of a spine strictly rise or fall (but for such twins), and
m of them last m * m / 2 seconds at least.

Open nodes are merged across chunks without ever gathering an entity. What ends a node's run is the
nearest greater gap on either side. If it is not in the node's own chunk, it is in the nearest chunk
whose greatest gap is greater, and there it is the nearest on that chunk's spine. So each chunk is
told only the greatest gap of every chunk of the entity, finds the chunks that end its open nodes,
and a lookup by value, in buckets of BUCKET values, finds the gaps in them. Gaps that only rise or
fall over all chunks are handled by as many tasks as there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.ordered import neighbours
from anamnesis.session import cut, width

#: Parent gap of a node without parent. No real gap is as large.
ENDLESS = 2**62
#: Gap of a leaf. Every threshold from 0 on lies above it.
LEAF = -1

NODE = (
    "entity string, profile string, gap long, parent_gap long, first_event string, last_event string, "
    "first_sec long, first_nano int, last_sec long, last_nano int, n_events long"
)
#: One segment of an open chunk: the events between two neighbouring open gaps.
OPEN = ", chunk int, part int, gap_after long, lone boolean"
#: An open node of a chunk or what ends one there: role, places of its first and last event in the entity,
#: the chunks where its run ends, and the ending gaps that are known.
MATCHED = NODE + ", chunk int, role string, first_at long, last_at long, left_chunk int, right_chunk int, left_gap long, right_gap long"
_COLUMNS = [x.split()[0] for x in (NODE + OPEN).split(", ")]
_BATCH = 20_000
#: Gaps of this many consecutive values are looked up together.
BUCKET = 1024


def _whole(a: tuple, b: tuple) -> int:
    """Whole seconds from event a to event b; an event is (id, sec, nano, ordinal)."""
    return b[1] - a[1] - (b[2] < a[2])


class _Tree:
    """The stack pass over one entity in one chunk."""

    __slots__ = ("key", "left_open", "spine", "stack", "start", "last")

    def __init__(self, key: tuple, first: tuple, left_open: bool):
        self.key, self.left_open = key, left_open
        self.spine: list[tuple] = []  # popped gaps that may have a greater one in an earlier chunk
        self.stack: list[tuple] = []  # (gap, first event under it, event before it, event after it)
        self.start = self.last = first

    def _node(self, gap, parent, first, last):
        return (*self.key, gap, parent, first[0], last[0], first[1], first[2], last[1], last[2], last[3] - first[3] + 1)

    def add(self, event: tuple, gap: int, out: list) -> None:
        """The next event, gap seconds after the last one."""
        stack, last = self.stack, self.last
        if stack or not self.left_open:
            out.append(self._node(LEAF, min(stack[-1][0] if stack else ENDLESS, gap), last, last))
        first = last
        while stack and stack[-1][0] <= gap:
            top = stack.pop()
            first = top[1]
            if stack or not self.left_open:
                parent = min(stack[-1][0] if stack else ENDLESS, gap)
                if parent > top[0]:
                    out.append(self._node(top[0], parent, first, last))
            elif len(self.spine) > 1 and self.spine[-1][0] == self.spine[-2][0] == top[0]:
                self.spine[-1] = top  # of a run of equal gaps only both ends stay open
            else:
                self.spine.append(top)
        stack.append((gap, first, last, event))
        self.last = event

    def close(self, out: list) -> None:
        """No later chunk holds this entity, and no earlier one does."""
        out.append(self._node(LEAF, self.stack[-1][0] if self.stack else ENDLESS, self.last, self.last))
        while self.stack:
            top = self.stack.pop()
            parent = self.stack[-1][0] if self.stack else ENDLESS
            if parent > top[0]:
                out.append(self._node(top[0], parent, top[1], self.last))

    def segments(self) -> list[tuple]:
        """(first event, last event, gap after or None, leaf still to be given out) of what is open."""
        opened = [*self.spine, *self.stack]
        got, first = [], self.start
        for gap, _, before, after in opened:
            got.append((first, before, gap))
            first = after
        got.append((first, self.last, None))
        end = len(got) - 1
        return [
            (a, b, gap, a[3] == b[3] and ((i == 0 and self.left_open) or i == end))
            for i, (a, b, gap) in enumerate(got)
        ]


def _chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees of one partition that is sorted by entity and time."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId()
    out: list[tuple] = []
    tree, at = None, 0

    def opened() -> None:
        for i, (a, b, gap, lone) in enumerate(tree.segments()):
            out.append((*tree.key, None, None, a[0], b[0], a[1], a[2], b[1], b[2], b[3] - a[3] + 1, chunk, i, gap, lone))

    def frame() -> pd.DataFrame:
        done = pd.DataFrame([(*x, None, None, None, None) if len(x) == 11 else x for x in out], columns=_COLUMNS)
        out.clear()
        return done.astype({c: "Int64" for c in ("gap", "parent_gap", "chunk", "part", "gap_after")})

    first_entity = True
    for batch in batches:
        for entity, profile, event, sec, nano in zip(
            batch["entity"].tolist(), batch["profile"].tolist(), batch["event"].tolist(), batch["sec"].tolist(), batch["nano"].tolist()
        ):
            if tree is not None and tree.key[0] == entity:
                at += 1
                now = (event, sec, nano, at)
                tree.add(now, _whole(tree.last, now), out)
                continue
            if tree is not None:
                opened() if tree.left_open else tree.close(out)
                first_entity = False
            at = 0
            tree = _Tree((entity, profile), (event, sec, nano, 0), first_entity)
        if len(out) >= _BATCH:
            yield frame()
    if tree is not None:
        opened()
    if out:
        yield frame()


def _match(seg: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """The open nodes of one entity in one chunk, with the gaps that end their runs or the chunks that hold those.

    Beside them it gives the chunk's own spines, in which others look up the ends of theirs.
    """
    seg, about = seg.sort_values("part"), info.iloc[0]
    key, chunk = (about["owner"], about["profile"]), int(about["of_chunk"])
    ids, n = (seg["first_event"].tolist(), seg["last_event"].tolist()), seg["n_events"].to_numpy("int64")
    begin = int(about["before"]) + np.cumsum(n) - n
    firsts = list(zip(ids[0], seg["first_sec"].tolist(), seg["first_nano"].tolist(), begin.tolist()))
    lasts = list(zip(ids[1], seg["last_sec"].tolist(), seg["last_nano"].tolist(), (begin + n - 1).tolist()))
    gaps, after = [int(g) for g in seg["gap_after"].tolist()[:-1]], firsts[1:]
    if not pd.isna(about["joint"]):
        gaps.append(int(about["joint"]))
        after.append((about["next_event"], int(about["next_sec"]), int(about["next_nano"]), lasts[-1][3] + 1))
    start = (about["start_event"], int(about["start_sec"]), int(about["start_nano"]), 0)
    stop = (about["stop_event"], int(about["stop_sec"]), int(about["stop_nano"]), int(about["n_all"]) - 1)
    peaks = [(int(p["chunk"]), -1 if p["peak"] is None else int(p["peak"])) for p in about["peaks"]]
    here = next(i for i, p in enumerate(peaks) if p[0] == chunk)

    def records(others) -> tuple[list[int], list[int]]:
        """Chunks on one side, from the near to the far, that exceed all nearer ones."""
        values, chunks = [], []
        for c, peak in others:
            if not values or peak > values[-1]:
                values.append(peak)
                chunks.append(c)
        return values, chunks

    (left_v, left_c), (right_v, right_c) = records(reversed(peaks[:here])), records(peaks[here + 1 :])
    out: list[tuple] = []

    def give(role, gap, parent, first, last, left_chunk=None, right_chunk=None, left_gap=None, right_gap=None):
        out.append((*key, gap, parent, first[0], last[0], first[1], first[2], last[1], last[2], last[3] - first[3] + 1, chunk, role, first[3], last[3], left_chunk, right_chunk, left_gap, right_gap))

    # The nearest greater gap before each, and the nearest one after it that is as great.
    lower, upper, stack = [-1] * len(gaps), [-1] * len(gaps), []
    for i, g in enumerate(gaps):
        while stack and gaps[stack[-1]] <= g:
            upper[stack.pop()] = i
        lower[i] = stack[-1] if stack else -1
        stack.append(i)
    for i in stack:
        give("left", gaps[i], None, after[i], lasts[i])
    greatest = -1
    for i, g in enumerate(gaps):
        if g > greatest:
            give("right", g, None, after[i], lasts[i])
            greatest = g
        if upper[i] >= 0 and gaps[upper[i]] == g:
            continue  # the last of equal gaps stands for their node
        first, last, lc, rc, lg, rg = start, stop, None, None, ENDLESS, ENDLESS
        if lower[i] >= 0:
            first, lg = after[lower[i]], gaps[lower[i]]
        elif (k := int(np.searchsorted(left_v, g, "right"))) < len(left_v):
            lc = left_c[k]
        if upper[i] >= 0:
            last, rg = lasts[upper[i]], gaps[upper[i]]
        elif (k := int(np.searchsorted(right_v, g, "left"))) < len(right_v):
            rc = right_c[k]
        give("node", g, None, first, last, lc, rc, lg, rg)
    before = ENDLESS if pd.isna(about["joint_before"]) else int(about["joint_before"])
    for i, lone in enumerate(seg["lone"].tolist()):
        if lone:
            parent = min(gaps[i - 1] if i else before, gaps[i] if i < len(gaps) else ENDLESS)
            give("leaf", LEAF, parent, firsts[i], firsts[i])
    got = pd.DataFrame(out, columns=[x.split()[0] for x in MATCHED.split(", ")])
    return got.astype({c: "Int64" for c in ("parent_gap", "left_chunk", "right_chunk", "left_gap", "right_gap")})


def _seconds(a: str, b: str) -> Column:
    """Whole seconds from event struct a to event struct b."""
    return F.col(f"{b}.sec") - F.col(f"{a}.sec") - F.when(F.col(f"{b}.nano") < F.col(f"{a}.nano"), 1).otherwise(0)


def _merged(pieces: DataFrame) -> DataFrame:
    """Open segments of all chunks to the final nodes of their entities."""
    by = Window.partitionBy("entity").orderBy("chunk")  # one row per chunk that holds the entity
    end = lambda side: F.struct(F.col(f"{side}_event").alias("event"), F.col(f"{side}_sec").alias("sec"), F.col(f"{side}_nano").alias("nano"))
    border = (
        pieces.groupBy("entity", "chunk")
        .agg(F.first("profile").alias("profile"), F.min_by(end("first"), "part").alias("a"), F.max_by(end("last"), "part").alias("b"), F.sum("n_events").alias("n"), F.max("gap_after").alias("inner"))
        .withColumn("next", F.lead("a").over(by))
        .withColumn("prev", F.lag("b").over(by))
        .withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("joint", _seconds("b", "next"))
        .withColumn("joint_before", _seconds("prev", "a"))
    )
    whole = border.groupBy("entity").agg(
        F.sort_array(F.collect_list(F.struct("chunk", F.greatest("inner", "joint").alias("peak")))).alias("peaks"),
        F.min_by("a", "chunk").alias("start"), F.max_by("b", "chunk").alias("stop"), F.sum("n").alias("n_all"),
    )
    flat = lambda c: [F.col(f"{c}.{x}").alias(f"{c}_{x}") for x in ("event", "sec", "nano")]
    info = border.join(whole, "entity").select(F.col("entity").alias("owner"), F.col("chunk").alias("of_chunk"), "profile", "before", "joint", "joint_before", "n_all", "peaks", *flat("next"), *flat("start"), *flat("stop"))
    matched = cut(pieces.groupBy("entity", "chunk").cogroup(info.groupBy("owner", "of_chunk")).applyInPandas(_match, MATCHED))
    nodes = matched.where("role = 'node'")
    asked = lambda side: nodes.where(f"{side}_chunk is not null").select("entity", F.lit(side).alias("side"), F.col(f"{side}_chunk").alias("chunk"), "gap").distinct()
    # On the left a greater gap ends the run, on the right one that is as great.
    place = F.when((F.col("side") == "left") == F.col("end").isNotNull(), 0).otherwise(1)
    at = F.when(F.col("role") == "left", F.struct("gap", F.col("first_event").alias("event"), F.col("first_sec").alias("sec"), F.col("first_nano").alias("nano"), F.col("first_at").alias("at"))).otherwise(
        F.struct("gap", F.col("last_event").alias("event"), F.col("last_sec").alias("sec"), F.col("last_nano").alias("nano"), F.col("last_at").alias("at"))
    )
    spines = matched.where("role in ('left', 'right')").select("entity", F.col("role").alias("side"), "chunk", "gap", at.alias("end"))
    both = spines.unionByName(asked("left").unionByName(asked("right")), allowMissingColumns=True).withColumn("place", place)
    met = neighbours(both, ["entity", "side", "chunk"], F.floor(F.col("gap") / BUCKET), ["gap", "place"], F.col("end")).where("end is null")
    side = lambda name: met.where(F.col("side") == name).select("entity", F.col("chunk").alias(f"{name}_chunk"), "gap", F.col("value_after").alias(name))
    full = nodes.join(side("left"), ["entity", "left_chunk", "gap"], "left").join(side("right"), ["entity", "right_chunk", "gap"], "left")
    lg, rg = F.coalesce("left.gap", "left_gap"), F.coalesce("right.gap", "right_gap")
    first_at, last_at = F.coalesce("left.at", "first_at"), F.coalesce("right.at", "last_at")
    done = full.where(rg > F.col("gap")).select(
        "entity", "profile", "gap", F.least(lg, rg).alias("parent_gap"),
        F.coalesce("left.event", "first_event").alias("first_event"), F.coalesce("right.event", "last_event").alias("last_event"),
        F.coalesce("left.sec", "first_sec").alias("first_sec"), F.coalesce("left.nano", "first_nano").alias("first_nano"),
        F.coalesce("right.sec", "last_sec").alias("last_sec"), F.coalesce("right.nano", "last_nano").alias("last_nano"),
        (last_at - first_at + 1).alias("n_events"),
    )
    return done.unionByName(matched.where("role = 'leaf'").select(done.columns))


def gap_tree(events: DataFrame, entity: str, event: str, instant: Column, tie: str, profile: Column | None = None) -> DataFrame:
    """Nodes of the Cartesian trees of all entities' gaps, with the columns of NODE.

    events: any frame; instant: struct<sec, nano>; rows without entity, event or instant are left
    out. Events of one entity are ordered by instant, then tie (nulls first), then event id. Each row counts as one
    event: equal ids must be folded before. profile: a text that is the same for all rows of an
    entity and is carried along. Empty input gives no nodes. Nodes whose gap equals their parent's
    never form a session and are left out.
    """
    slim = events.select(
        F.col(entity).cast("string").alias("entity"),
        (F.lit(None) if profile is None else profile).cast("string").alias("profile"),
        F.col(event).cast("string").alias("event"),
        instant["sec"].alias("sec"),
        instant["nano"].alias("nano"),
        F.col(tie).alias("tie"),
    ).where("entity is not null and event is not null and sec is not null")
    order = ["entity", "sec", "nano", "tie", "event"]
    # Written once: final nodes and open segments come from one pass over the sorted events.
    chunks = cut(
        slim.repartitionByRange(width(events.sparkSession), *order)
        .sortWithinPartitions(*order)
        .drop("tie")
        .mapInPandas(_chunk, NODE + OPEN)
    )
    nodes = [x.split()[0] for x in NODE.split(", ")]
    return chunks.where("chunk is null").select(nodes).unionByName(_merged(chunks.where("chunk is not null")))


def cut_tree(nodes: DataFrame, threshold: Column) -> DataFrame:
    """The sessions that a threshold in whole seconds leaves: a gap greater than it parts."""
    return nodes.where((F.col("gap") <= threshold) & (F.col("parent_gap") > threshold))
