"""Sizes of texts in tokens of a public tokenizer, whose rank file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Rank file of a byte-level BPE for many languages. Every executor must have it under this path.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count(text: str | None, ranks: str = RANKS) -> int:
    """Number of tokens; 0 for null and for the empty text."""
    return len(encoding(ranks).encode_ordinary(text)) if text else 0
