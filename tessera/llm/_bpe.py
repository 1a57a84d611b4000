"""Byte-level BPE ids of texts, by tiktoken, from a file of ranks."""

from __future__ import annotations

import base64
import functools

import numpy as np

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    """The encoding of a file of ranks; text that looks like a special token is ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text."""
    encode = encoding(path).encode_to_numpy
    return [encode(t, disallowed_special=()) for t in texts]


def count_column(path: str, column) -> np.ndarray:
    """Ids of each text of an Arrow column, one text at a time; 0 for null."""
    encode = encoding(path).encode_to_numpy
    return np.array([len(encode(x, disallowed_special=())) if (x := text.as_py()) else 0 for text in column], np.int64)
