"""Vectorised word scanning over Arrow string buffers.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII; every other ASCII character separates words. ASCII capitals count as
small letters. All words of a slice of documents are found and hashed at once,
on the UTF-8 bytes, so the cost is a few array passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
IS_WORD = ((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = (LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Regular expression of a word, for RE2 and java.util.regex.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice(NamedTuple):
    """Some rows of a batch: their bytes, and where each row begins and ends in them."""

    first: int
    count: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Slice]:
    """Consecutive rows of a string or binary column in slices of about ``most_bytes``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Slice(at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Words(NamedTuple):
    """Words of a slice: byte ranges, 64-bit hashes, and the first word of each row (with an end)."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of_row: np.ndarray


def scan(s: Slice, table: np.ndarray = IS_WORD) -> Words:
    """All words of the slice in order."""
    n = len(s.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(s.count + 1, np.int64))
    inside = table[s.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = s.bounds[(s.bounds > 0) & (s.bounds < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(begin, end, hashes(s.data, begin, end), np.searchsorted(begin, s.bounds))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """64-bit hashes of byte ranges, from one prefix sum over the bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[begin]) * powers(_BASE_INV, n + 1)[begin] + (end - begin).astype(np.uint64))


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by the place of the first word."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:m].copy()
    for i in range(1, n):
        out *= np.uint64(_BASE)
        out += word_hashes[i : i + m]
    return mix(out)
