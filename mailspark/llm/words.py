"""Words of whole Arrow text batches, as numpy arrays.

A word is a longest run of digits, ASCII letters (A-Z lower-cased) and
non-ASCII characters, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z.  All bytes of a non-ASCII character are 0x80 or more, so the
class can be decided byte by byte on UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .base import ended, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = True
IS_WORD[128:] = True
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; the last table made is kept."""
    for size, tables in _powers.items():
        if size >= n:
            return tables
    size = max(1 << 20, 1 << (int(n) - 1).bit_length())
    out = []
    for b in (_BASE, _INVERSE):
        t = np.full(size, b, dtype=np.uint64)
        t[0] = 1
        out.append(np.multiply.accumulate(t))
    _powers.clear()
    _powers[size] = tuple(out)
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of prefix sums."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * power[:len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Byte spans (in order, disjoint) as a string array."""
    size = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1                                          # a span may begin where another ends
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(kept))


class Words:
    """Words of a slice of texts.

    data: bytes (lower-cased, if so asked), each text followed by one line end; starts, ends:
    the words' spans in it; first: index of each text's first word, and one
    more; doc: the text of each word.
    """

    def __init__(self, texts: pa.Array, member: np.ndarray = IS_WORD, lower: bool = True):
        raw, self.offsets = ended(texts)
        self.data = LOWER[raw] if lower else raw
        inside = member[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else np.zeros(0, np.int64)
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]      # the last byte is a line end: every word ends
        self.n_docs = len(texts)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def strings(self) -> pa.StringArray:
        """The words themselves."""
        return strings(self.data, self.starts, self.ends)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def shingles(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``k`` consecutive words; a text of fewer words, but not none, is one run."""
    c = words.counts
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    full = np.zeros(n, dtype=np.uint64)
    for j in range(k):                                       # sums run past a text's end; those starts go below
        full[:n - j] += h[j:] * factor[j]
    room = words.first[1:][words.doc] - np.arange(n)         # words left in the text from here on
    keep = room >= k
    short = np.flatnonzero((c > 0) & (c < k))
    if len(short):
        at = words.first[:-1][short]
        total = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = c[short] > j
            total[has] += h[np.minimum(at + j, n - 1)][has] * factor[j]
        full[at] = total
        keep[at] = True
    at = np.flatnonzero(keep)
    return words.doc[at], mix(full[at])
