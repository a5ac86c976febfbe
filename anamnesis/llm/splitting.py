"""Cut oversized texts into overlapping pieces at natural boundaries.

The text is split by section; a section over the limit by paragraph, then by line, sentence, clause and
word, and a run of characters without any boundary by character. The parts so found are packed
greedily: a piece takes parts while it stays within the limit, counted with the overlap that it
begins with. The work is per text; Spark deals out the texts and keeps short ones from Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end or part a sentence. Fixed values of the data's definition.
MARKS = ".。!！?？;；，,、:："
#: (name, pattern whose matches end at a boundary), from the strongest to the weakest.
LEVELS = (
    ("section", re.compile(r"\n(?=#{1,6} )|\n(?=[^\n]+\n(?:={3,}|-{3,})\s*(?:\n|$))|\f|\n\s*\n\s*(?:[-*_]{3,}\s*\n)\s*")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n+|\r(?!\n)")),
    ("sentence", re.compile(r"[.!?;](?=\s)\s+|[。！？；]+[”’」』）)\"]*\s*")),
    ("clause", re.compile(r"[,:](?=\s)\s+|[，、：]\s*")),
    ("word", re.compile(r"\s+")),
    ("mark", re.compile(rf"[{re.escape(MARKS)}]")),
    # Last, before a mark or white space, for a run that alone fills a piece.
    ("edge", re.compile(rf"(?=[\s{re.escape(MARKS)}])")),
)
CHARACTER = "character"

PIECE = "item_kind string, item_id string, piece_no int, start_char int, end_char int, overlap_chars int, cut string, text string"


def parts(text: str, start: int, end: int, aim: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, str]]:
    """Consecutive (start, end, name of the boundary it ends at) that cover text[start:end].

    No part is over limit. Parts over aim are split further where a boundary is left.
    """
    if end - start <= aim:
        yield start, end, "end"
        return
    while level < len(LEVELS):
        name, pattern = LEVELS[level]
        if end - start <= limit and name in ("mark", "edge"):
            break  # it fits a piece of its own; better whole than cut at a mark within a word
        cuts = [p for m in pattern.finditer(text, start, end) if start < (p := m.end()) < end]
        level += 1
        if cuts:
            at = start
            for p in [*cuts, end]:
                got = list(parts(text, at, p, aim, limit, level))
                yield from got[:-1]
                yield got[-1][0], got[-1][1], name if p < end else "end"
                at = p
            return
    if end - start <= limit:
        yield start, end, "end"
        return
    at = start
    while end - at > limit:
        p = at + aim
        while p > at + 1 and p > at + aim - 16 and (unicodedata.combining(text[p]) or text[p] in "‍️"):
            p -= 1  # not between a letter and its marks
        yield at, p, CHARACTER
        at = p
    yield at, end, "end"


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, end, characters shared with the piece before, name of the boundary it ends at).

    Offsets are 0-based, half-open, in code points. An overlap is shortened only where a part that
    can not be split would not fit otherwise; one of limit or more is taken as half of the limit.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if len(text) <= limit:
        return [(0, len(text), 0, "end")]
    overlap = overlap if overlap < limit else limit // 2
    got: list[tuple[int, int, int, str]] = []
    begin, core, last = 0, 0, None  # the piece's first character, its first new one, its last part
    for s, e, name in parts(text, 0, len(text), limit - overlap, limit):
        if last is not None and e - begin > limit:
            got.append((begin, last[1], core - begin, last[2]))
            core = s
            begin = max(core - overlap, e - limit)
        last = (s, e, name)
    got.append((begin, last[1], core - begin, "end"))
    return got


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PIECE.split(", ")]
    for b in batches:
        out, size = [], 0
        for kind, item, text, limit, overlap in zip(b["item_kind"], b["item_id"], b["text"], b["max_chars"], b["overlap"]):
            for i, (s, e, shared, name) in enumerate(pieces(text, int(limit), int(overlap))):
                out.append((kind, item, i, s, e, shared, name, text[s:e]))
                size += e - s
                if size > 4_000_000:  # a batch of pieces stays small, whatever the texts
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces, with the columns of PIECE, of every item over its limit.

    items: (item_kind, item_id, text), each item once; limits: (item_kind, max_chars,
    overlap_chars), a small table. Items without text, within the limit, or of a kind without limit
    give no pieces. Repeated items give their pieces again.
    """
    over = (
        items.join(limits.withColumnRenamed("overlap_chars", "overlap"), "item_kind")
        .where("text is not null and max_chars >= 1 and char_length(text) > max_chars")
        .select("item_kind", "item_id", "text", "max_chars", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    )
    return over.mapInPandas(_rows, PIECE)
