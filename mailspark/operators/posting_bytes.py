"""Lists of postings as bytes: their counts, then the key's columns, each in steps from one posting to the next.

A list: its length (the lowest bit tells that a key has nulls; then a flag a
column and posting follows), the counts, the columns.  Numbers are in groups
of seven bits; whole numbers, dates and times are differences to the posting before,
other values are texts: how often a value comes in a row, its length, its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Parts = tuple[np.ndarray, np.ndarray]


def _whole(t: pa.DataType) -> bool:
    return pa.types.is_signed_integer(t) or pa.types.is_date32(t) or pa.types.is_timestamp(t) or pa.types.is_boolean(t)


def _step(t: pa.DataType) -> pa.DataType:
    """The type by way of which a whole value becomes a number."""
    return pa.int32() if pa.types.is_date32(t) else pa.int8() if pa.types.is_boolean(t) else pa.int64()


def _sums(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(lengths, first) if len(first) else np.zeros(0, np.int64)


def _numbers(values: np.ndarray) -> Parts:
    """Bytes of unsigned numbers, and how many each has."""
    u = values.astype(np.uint64)
    size = np.ones(len(u), np.int64)
    for k in range(1, 10):
        more = u >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = ((u[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[at] > k + 1).astype(np.uint8) << 7)
    return out, size


def _woven(parts: list[Parts]) -> Parts:
    """The first piece of each part, the second of each, and so on."""
    size = sum(s for _, s in parts)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for data, s in parts:
        out[np.repeat(at - (np.cumsum(s) - s), s) + np.arange(len(data))] = data
        at = at + s
    return out, size


def _column(c: pa.Array, first: np.ndarray) -> Parts:
    """Bytes of a column, a piece a list."""
    starts = np.zeros(len(c), bool)
    starts[first] = True
    if _whole(c.type):
        v = c.cast(_step(c.type)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        d = np.where(starts, v, v - np.r_[v[:1], v[:-1]])
        data, size = _numbers(((d << 1) ^ (d >> 63)).view(np.uint64))
        return data, _sums(size, first)
    d = c.cast(pa.string()).cast(pa.binary()).fill_null(b"").dictionary_encode() if not pa.types.is_binary(c.type) else c.fill_null(b"").dictionary_encode()
    code = d.indices.to_numpy()
    run = np.flatnonzero(starts | np.r_[True, code[1:] != code[:-1]][:len(code)])
    value = d.dictionary.take(pa.array(code[run]))
    length = np.array([len(x) for x in d.dictionary.to_pylist()], np.int64)[code[run]]
    raw = np.frombuffer(b"".join(value.to_pylist()), np.uint8)
    data, size = _woven([_numbers(np.diff(np.r_[run, len(code)])), _numbers(length), (raw, length)])
    return data, _sums(size, np.searchsorted(run, first))


def written(first: np.ndarray, tf: np.ndarray, own: list[pa.Array]) -> pa.Array:
    """The lists that begin at ``first`` in the counts and the key's columns."""
    n = np.diff(np.r_[first, len(tf)])
    gone = [c.is_null().to_numpy(zero_copy_only=False) for c in own]
    nulls = _sums(sum(g.astype(np.int64) for g in gone), first) > 0
    counts, size = _numbers(tf)
    parts = [_numbers(n * 2 + nulls)]
    for g in gone:
        parts.append((g[np.repeat(nulls, n)].astype(np.uint8), n * nulls))
    parts += [(counts, _sums(size, first)), *(_column(c, first) for c in own)]
    data, size = _woven(parts)
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _read_numbers(raw: np.ndarray, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers from a place on, and the place after them."""
    part = raw[at:at + 10 * n]
    ends = np.flatnonzero(part < 128)[:n]
    stop = int(ends[-1]) + 1
    starts = np.r_[0, ends[:-1] + 1]
    shift = np.arange(stop) - np.repeat(starts, ends + 1 - starts)
    return np.add.reduceat((part[:stop] & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), starts), at + stop


def read(raw: bytes, types: list[pa.DataType]) -> tuple[np.ndarray, list[pa.Array]]:
    """Counts and key columns of a list."""
    b = np.frombuffer(raw, np.uint8)
    head, at = _read_numbers(b, 0, 1)
    n, nulls = int(head[0]) >> 1, bool(int(head[0]) & 1)
    gone = []
    for _ in types:
        gone.append(b[at:at + n].astype(bool) if nulls else None)
        at += n * nulls
    tf, at = _read_numbers(b, at, n)
    own = []
    for t, g in zip(types, gone):
        if _whole(t):
            u, at = _read_numbers(b, at, n)
            d = (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)
            own.append(pa.array(np.cumsum(d), pa.int64(), mask=g).cast(_step(t)).cast(t))
            continue
        values: list[bytes] = []
        while len(values) < n:
            (often, length), at = _read_numbers(b, at, 2)
            values += [raw[at:at + int(length)]] * int(often)
            at += int(length)
        values = values if g is None else [None if x else v for v, x in zip(values, g)]
        c = pa.array(values, pa.binary())
        own.append(c if pa.types.is_binary(t) else c.cast(pa.string()).cast(t))
    return tf.astype(np.int64), own
