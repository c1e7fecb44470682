"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining.

Seeds are runs of five words, thinned by winnowing: of every four
consecutive runs of a document the one with the smallest hash is a seed, so two
documents that share eight words in a row share a seed.  A seed joins each
document that has it with the first such document (the smallest id); a passage
that thousands share gives one match a seed and place, never a pair of
every two.  Each place of a seed is joined with its first place in that
document, so every copy of a passage is found, also within one document (from
50 words behind the first copy's beginning on).  The seeds of one passage may so lead to several documents of which
none has all of it; therefore each run of 50 words that two documents share
joins those that have it with the first that has all 50.  Only runs whose
seeds are all shared (by a filter of fixed size, which lets every match pass)
are looked at, and of adjacent runs with one source every sixteenth is kept.

The matches of a document with one earlier document are chained: a chain
ascends in both, each seed adds its words, each gap costs by its length; a
Fenwick tree over the places in the earlier document gives the best
predecessor.  In the report over a whole corpus a chain of a single seed, as most accidental ones are, is first
screened: the 45 words on either side are compared, by one byte a word, with
those of the other document up to two places aside, and the chain goes on if
some 50 words with the seed in them may agree enough.  Chains are then aligned word by word: gaps between seeds by
their longest common subsequence, ends by extension until mismatches outweigh
matches.  An alignment first sees 48 words of the earlier document on either
side; where these do not decide its end it is done again with more.  An
aligned chain of 50 words or more, of which 80% agree, is a repeated passage;
one that agrees less is cut at its widest gap, and its parts are tried.
The first document that has it keeps it.

Runs travel packed, dealt by their hash to a fixed number of buckets; chains travel a row a pair of documents, with
the earlier document's words around them once.

Cases: null and empty texts, and texts of fewer than 50 words, have no
passages; a passage that repeats in its own document has that document as its
source; rows that repeat a doc_id are one document (passages refer to any of its rows), but each
text is cut by its own passages; rows with a null id are left alone; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import near, prepare, staged, text_slices
from .words import Words, shingles

SEED = 5
WINNOW = 4                               # a power of two
MIN_WORDS = 50
SIMILARITY = 0.8
#: Cost of one word of a gap (of either document), in words matched.
GAP = 1 / 16
#: Words around a chain that its first alignment gets; chains that need more get 64 times as many, again and again.
MARGIN = 48
#: An extension ends when mismatches put it this far below its best.
DROP = 6
#: Words beside a lone seed that are looked at before it is aligned, places aside that they may match at, and
#: matches that 50 words with the seed need (fewer than a passage must have).
BESIDE, ASIDE, SCREEN = 45, 2, 38
#: Documents whose matches with one document travel in one row.
TOGETHER = 128
#: Bits of the filter of shared seeds that the tasks get (8 MB; a power of two).
FILTER_BITS = 1 << 26


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each n (a power of two) consecutive values."""
    while n > 1:
        n //= 2
        x = pick(x[:len(x) - n], x[n:])
    return x


def _winnowed(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs are seeds, by the runs' texts and hashes and the texts' numbers of runs."""
    if len(h) < WINNOW:
        return np.zeros(0, np.int64)
    least = _slide(h, WINNOW, np.minimum)                    # of the window that starts here
    least[doc[:len(least)] != doc[WINNOW - 1:]] = 0          # a window lies in one text
    pad = np.zeros(WINNOW - 1, np.uint64)
    most = _slide(np.concatenate((pad, least, pad)), WINNOW, np.maximum)
    return np.flatnonzero((most == h) & (size[doc] >= WINNOW))


def seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, word place) of the winnowed seeds."""
    w = Words(texts)
    doc, h = shingles(w, w.hashes(), SEED)
    size = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(size) - size
    at = _winnowed(doc, h, size)
    return doc[at], h[at], at - first[doc[at]]


def _filter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash, both in the part of its bucket."""
    part = FILTER_BITS // BUCKETS
    first = (h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
    return first, first // part * part + (h & np.uint64(part - 1)).astype(np.int64)


def wide(texts: pa.Array, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, word place) of the runs of MIN_WORDS words whose seeds the filter ``shared`` holds."""
    w = Words(texts)
    hashes = w.hashes()
    doc, h = shingles(w, hashes, SEED)
    at = _winnowed(doc, h, np.bincount(doc, minlength=len(texts)))
    p, q = _filter_places(h[at])
    odd = np.zeros(len(w.starts) + 1, np.int64)              # seeds not shared, up to a word
    first_run = np.searchsorted(doc, doc[at])
    odd[w.first[doc[at]] + at - first_run + 1] = 1 - (shared[p >> 6] >> (p & 63) & 1 & shared[q >> 6] >> (q & 63))
    odd = np.cumsum(odd)
    doc, h = shingles(w, hashes, MIN_WORDS)
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    start = w.first[doc] + place
    # a run's outer seeds depend on the words around it
    stop = np.minimum(start + MIN_WORDS - SEED + 1 - (WINNOW - 1), len(w.starts))
    keep = (w.counts[doc] >= MIN_WORDS) & (odd[stop] == odd[np.minimum(start + WINNOW - 1, len(w.starts))])
    return doc[keep], h[keep], place[keep]


def chains(xs: list[int], ys: list[int]) -> list[tuple[list[int], list[int]]]:
    """Collinear chains of matches (x ascending), best first, as lists of x and y."""
    n = len(xs)
    if n == 1:
        return [(xs, ys)]
    places = sorted(set(ys))
    rank = {y: i + 1 for i, y in enumerate(places)}
    size = len(places) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * size       # prefix maxima of score + cost of place
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for j in range(n):
        x, y = xs[j], ys[j]
        if waiting and xs[waiting[0]] < x:                   # matches of one x do not follow each other
            for i in waiting:
                k, value = rank[ys[i]], (score[i] + GAP * (xs[i] + ys[i]), i)
                while k < size:
                    if value > tree[k]:
                        tree[k] = value
                    k += k & -k
            waiting = []
        k, best = rank[y] - 1, (0.0, -1)
        while k > 0:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        score[j] = SEED
        if best[1] >= 0:
            i = best[1]
            new = min(SEED, x - xs[i], y - ys[i])            # words that the seed adds
            s = best[0] - GAP * (x + y) + new + GAP * 2 * new
            if s > SEED:
                score[j], before[j] = s, i
        waiting.append(j)
    used = [False] * n
    out = []
    for j in sorted(range(n), key=lambda j: -score[j]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        if path:
            path.reverse()
            out.append(([xs[i] for i in path], [ys[i] for i in path]))
    return out


def matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words of an optimal alignment of two short word rows that agree."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 2:
            return same
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    # longest common subsequence by bits: a place of b is 0 where the subsequence of a's beginning grows
    ones = (1 << len(b)) - 1
    row = ones
    for x in a:
        here = row & int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little")
        row = (row + here | row - here) & ones
    return len(b) - row.bit_count()


def _run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, bool]:
    """(words, matches, score) of the best common beginning of two word rows, word against word; whether more of b could tell."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, 0, len(b) < len(a)
    upto = min(n, 256)
    while True:                                              # longer stretches only where the first did not end it
        same = a[:upto] == b[:upto]
        total = np.cumsum(np.where(same, 1, -2))
        low = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total >= DROP)
        if len(low) or upto == n:
            break
        upto = min(n, upto * 8)
    if len(low):
        total = total[:low[0]]
    more = not len(low) and len(b) <= len(a)
    if not len(total) or total.max() <= 0:
        return 0, 0, 0, more
    k = int(total.argmax()) + 1
    return k, int(same[:k].sum()), int(total[k - 1]), more


def _runs_of(a, b, p, q, la, lb, step, limit=1 << 14):
    """``_run`` of many word rows at once: those of a and b from p and q on (step -1: backwards), of la and lb words.

    Last: whether the first ``limit`` words do not decide it.
    """
    la, lb = np.maximum(la, 0), np.maximum(lb, 0)
    most = np.minimum(la, lb)
    n = np.minimum(most, limit)
    col = np.arange(max(int(n.max(initial=0)), 1))
    inside = col < n[:, None]
    if len(a) and len(b):
        same = np.take(a, p[:, None] + step * col, mode="clip") == np.take(b, q[:, None] + step * col, mode="clip")
    else:
        same = np.zeros(inside.shape, bool)
    total = np.cumsum(same * np.int16(3) - np.int16(2), axis=1, dtype=np.int16)
    low = (np.maximum(np.maximum.accumulate(total, axis=1), 0) - total >= DROP) & inside
    ended = low.any(axis=1)
    undecided = ~ended & (n < most)
    n = np.where(ended, low.argmax(axis=1), n)
    total[col >= n[:, None]] = -1
    k = total.argmax(axis=1)
    score = total[np.arange(len(k)), k].astype(np.int64)
    good = score > 0
    k = np.where(good, k + 1, 0)
    # each match counts 1, each other word -2
    return k, np.where(good, (score + 2 * k) // 3, 0), np.where(good, score, 0), ~ended & (lb <= la) & (la > 0), undecided


#: Words that an extension leaves out of either row in a step aside, and words after them that are looked at first.
STEPS = np.array([(0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (1, 2), (2, 1)])
NEARBY = 64


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, bool]:
    """(words of a, words of b, matches) of their best common beginning; up to two words may be left out at a time.

    Last: whether b ended before that was decided.
    """
    x = y = good = 0
    while True:
        k, same, _, more = _run(a[x:], b[y:])
        x, y, good = x + k, y + k, good + same
        if more:
            return x, y, good, True
        best = (4, 0, 0)                                     # a step aside must gain more
        _, _, gains, unsure, undecided = _runs_of(a, b, x + STEPS[:, 0], y + STEPS[:, 1], len(a) - x - STEPS[:, 0], len(b) - y - STEPS[:, 1], 1, NEARBY)
        for (i, j), gain, open_, far in zip(STEPS.tolist(), gains.tolist(), unsure.tolist(), undecided.tolist()):
            if far:
                _, _, gain, open_ = _run(a[x + i:], b[y + j:])
            more |= open_
            if gain - i - j > best[0]:
                best = (gain - i - j, i, j)
        if best[0] == 4 or more:
            return x, y, good, more
        x, y = x + best[1], y + best[2]


def extensions(a, b, p, q, la, lb, step):
    """``extension`` of many word rows at once, given as for ``_runs_of``: words of a, of b, matches, and whether b ended before that was decided."""
    x, y, good = (np.zeros(len(p), np.int64) for _ in range(3))
    open_ = np.zeros(len(p), bool)
    left = np.arange(len(p))
    while len(left):
        def run(i, j):
            u, v = x[left] + i, y[left] + j
            return _runs_of(a, b, p[left] + step * u, q[left] + step * v, la[left] - u, lb[left] - v, step)
        k, same, _, more, _ = run(0, 0)
        x[left] += k
        y[left] += k
        good[left] += same
        open_[left[more]] = True                             # it ends here, whatever steps aside may gain
        left = left[~more]
        best, di, dj, unsure = np.full(len(left), 4), np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        for i, j in STEPS.tolist():
            _, _, gain, more, _ = run(i, j)
            unsure |= more
            better = gain - i - j > best
            best, di, dj = np.where(better, gain - i - j, best), np.where(better, i, di), np.where(better, j, dj)
        open_[left[unsure]] = True
        on = (best > 4) & ~unsure
        left = left[on]
        x[left] += di[on]
        y[left] += dj[on]
    return x, y, good, open_


def align(a: np.ndarray, b: np.ndarray, shift: int, xs: np.ndarray, ys: np.ndarray, ends=None):
    """(start, stop, other start, other stop, matches, before, behind) of a chain.

    b holds the other document's words from ``shift`` on; before, behind: whether words ahead of b's or after them are needed.
    ends: words of either document and matches before the first seed and after the last, where they are known and decided.
    """
    ys = ys - shift
    x, y = int(xs[0]), int(ys[0])
    back, behind, good, before = (*ends[:3], False) if ends else extension(a[:x][::-1], b[:y][::-1])
    start, other = x - back, y - behind
    good += SEED
    if len(xs) > 1:
        dx, dy = np.diff(xs), np.diff(ys)
        good += int(np.minimum(np.minimum(dx, dy), SEED).sum())       # a seed that overlaps the one before adds the words that it goes on
        for i in np.flatnonzero((np.minimum(dx, dy) >= SEED) & (np.maximum(dx, dy) > SEED)).tolist():
            good += matches(a[xs[i] + SEED:xs[i + 1]], b[ys[i] + SEED:ys[i + 1]])
    x, y = int(xs[-1]) + SEED, int(ys[-1]) + SEED
    on, beyond, more, after = (*ends[3:6], False) if ends else extension(a[x:], b[y:])
    return start, x + on, other + shift, y + beyond + shift, good + more, before, after


def widened(a: np.ndarray, b: np.ndarray, shift: int, start: int, stop: int, o: int, p: int, good: int):
    """A short alignment with words around it, word against word, up to MIN_WORDS: where most of them agree."""
    need, o, p = MIN_WORDS - (stop - start), o - shift, p - shift
    left, right = min(need, start, o), min(need, len(a) - stop, len(b) - p)
    if left + right >= need:
        before = np.concatenate(([0], np.cumsum(a[start - left:start][::-1] == b[o - left:o][::-1])))
        behind = np.concatenate(([0], np.cumsum(a[stop:stop + right] == b[p:p + right])))
        e = np.arange(need - right, left + 1)                # words before
        total = before[e] + behind[need - e]
        k = int(total.argmax())
        e, good = int(e[k]), good + int(total[k])
        start, stop, o, p = start - e, stop + need - e, o - e, p + need - e
    return start, stop, o + shift, p + shift, good


#: Buckets of hashes (a power of two); bytes of text whose runs are dealt to them at once, and that are hashed at once.
BUCKETS, PACK_BYTES, HASH_BYTES = 1 << 10, 8 << 20, 1 << 18


def _packed(of):
    """Rows (bucket, ids, hashes, places) of the runs that ``of`` picks from some texts, by the hash's first bits."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)

    def pack(held):
        ids_ = pa.concat_arrays([i for i, _, _ in held])
        h, place = (np.concatenate([r[k] for r in held]) for k in (1, 2))
        bucket = (h >> shift).astype(np.int16)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(size)
        upto = np.concatenate(([0], np.cumsum(size[some]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.ListArray.from_arrays(pa.array(upto), ids_.take(pa.array(order))),
            _binaries(h[order], size[some]), _binaries(place[order].astype("<i4"), size[some])], ["bucket", "ids", "hashes", "places"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a, b, texts in text_slices(batch, "text", HASH_BYTES):
                doc, h, place = of(texts)
                if len(h):
                    held.append((column_ids(batch, "id").slice(a, b - a).take(pa.array(doc)), h, place))
                size += texts.nbytes
                if held and size >= PACK_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)
    return run


def _ranks(values: pa.Array) -> np.ndarray:
    """A number of each value, in the values' order."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[coded.indices.to_numpy(zero_copy_only=False)]


def _met(table: pa.Table) -> pa.Table:
    """The runs of one bucket to rows (id, ref, x, y, bits): each later place with the first such; and the bucket (x) with the bits of its runs of several places."""
    ids_ = pa.concat_arrays([c.flatten() for c in table["ids"].chunks])
    h = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.int64)
    place = np.frombuffer(b"".join(table["places"].to_pylist()), "<i4")
    order = np.argsort(h, kind="stable")                     # runs of one place only, as most are, go first
    same = h[order][1:] == h[order][:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    ids_, h, place = ids_.take(pa.array(order)), h[order], place[order]
    rank = _ranks(ids_)
    order = np.lexsort((place, rank, h))
    h, place, rank = h[order], place[order], rank[order]
    new = np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    foreign = rank != rank[first]
    hit = np.flatnonzero(foreign | (place - place[first] >= MIN_WORDS))
    part = FILTER_BITS // BUCKETS
    bits = np.zeros(part, np.uint8)
    for at in _filter_places(h[foreign | (place != place[first])].view(np.uint64)):
        bits[at % part] = 1
    n, kind = len(hit), ids_.type
    return pa.table({"id": pa.concat_arrays([ids_.take(pa.array(order[hit])), pa.nulls(1, kind)]),
                     "ref": pa.concat_arrays([ids_.take(pa.array(order[first[hit]])), pa.nulls(1, kind)]),
                     "x": pa.array(np.append(place[hit], table["bucket"][0].as_py()), pa.int32()),
                     "y": pa.array(np.append(place[first[hit]], 0), pa.int32()),
                     "bits": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())])})


def _shared_filter(parts: DataFrame):
    """A broadcast Bloom filter of fixed size, of its parts by bucket (x, bits)."""
    got = parts.toArrow()                                    # BUCKETS rows, FILTER_BITS bits in all
    table = np.zeros((BUCKETS, FILTER_BITS // BUCKETS // 64), np.int64)
    for k, bits in zip(got["x"].to_pylist(), got["bits"].to_pylist()):
        table[k] = np.frombuffer(bits, "<i8")
    return parts.sparkSession.sparkContext.broadcast(table.ravel())


def _matches(docs: DataFrame, of) -> DataFrame:
    """(id, ref, x, y) of the runs with an earlier place, with the first such; and of each bucket (x) the bits of its runs of several places.

    One shuffle of packed runs; a bucket of hashes meets in one group (20 bytes a run and place).
    """
    kind = dict(docs.dtypes)["id"]
    return (docs.mapInArrow(_packed(of), f"bucket int, ids array<{kind}>, hashes binary, places binary")
            .groupBy("bucket").applyInArrow(_met, f"id {kind}, ref {kind}, x int, y int, bits binary"))


#: Chains of one document with another: how many seeds each has, and all their places (little-endian 32-bit numbers).
PAIR = "id {0}, ref {0}, ns binary, xs binary, ys binary"


def _bytes(values) -> bytes:
    return np.asarray(values, "<i4").tobytes()


def _binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binaries of the next ``size`` values (or rows of values) each."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size * (values.nbytes // max(len(values), 1)), out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _ints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array of binaries of 32-bit numbers, and how many each row has."""
    arr = pc.fill_null(arr, b"")
    size = pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.frombuffer(b"".join(arr.to_pylist()), "<i4").astype(np.int64), size


def _chainer(id_type):
    """Rows (id, ref, x, y) in order of (id, ref, x, y) to a row a pair (id, ref) with its chains of one seed, and one with its others."""
    def flush(key, xs, ys, out):
        got = chains(xs, ys)
        for alone in (False, True):
            if some := [c for c in got if (len(c[0]) == 1) == alone]:
                out.append((*key, alone, _bytes([len(cx) for cx, _ in some]), _bytes([x for cx, _ in some for x in cx]),
                            _bytes([y for _, cy in some for y in cy])))

    def table(out):
        cols = list(zip(*out)) or [()] * 6
        kinds = (id_type, id_type, pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "ref", "lone", "ns", "xs", "ys"])

    def run(batches):
        key, xs, ys, out = None, [], [], []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            new = np.ones(n, bool)                           # rows of another pair than the row before
            new[1:] = np.logical_or(*(pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (batch.column(0), batch.column(1))))
            keep = new.copy()                                # a run of either length
            keep[1:] |= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            first = np.concatenate(([0], np.cumsum(keep)))[np.append(at, n)].tolist()
            x, y = x[keep].tolist(), y[keep].tolist()
            ids_, refs = (batch.column(k).take(pa.array(at)).to_pylist() for k in (0, 1))
            for k, own in enumerate(zip(ids_, refs)):
                a, b = first[k], first[k + 1]
                if own == key:                               # goes on from the batch before
                    a += xs[-1] == x[a] and ys[-1] == y[a]
                    xs += x[a:b]
                    ys += y[a:b]
                    continue
                if key is not None:
                    flush(key, xs, ys, out)
                key, xs, ys = own, x[a:b], y[a:b]
                if len(out) >= 1000:
                    yield table(out)
                    out = []
        if key is not None:
            flush(key, xs, ys, out)
        yield table(out)
    return run


def _word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """A 32-bit number of each word, and where each text's words begin."""
    w = Words(texts)
    return (w.hashes() >> np.uint64(32)).astype(np.uint32), w.first, w


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte of each word (never 0), and where each text's words begin."""
    number, first, _ = _word_numbers(texts)
    return (number % np.uint32(255) + 1).astype(np.uint8), first


def _beside(code: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray, before: int, behind: int) -> np.ndarray:
    """Bytes of the words from ``before`` words ahead of a place to ``behind`` after it, a row a place; 0 outside the text."""
    where = (first[doc] + at)[:, None] + np.arange(-before, behind)
    inside = (where >= first[doc][:, None]) & (where < first[doc + 1][:, None])
    return np.where(inside, code[np.clip(where, 0, max(len(code) - 1, 0))], 0).astype(np.uint8) if len(code) else \
        np.zeros(where.shape, np.uint8)


def _chains_of(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, pa.StructArray]:
    """Pairs of the rows a to b: the row of each, and their fields."""
    lists = batch.column(batch.schema.get_field_index("chains")).slice(a, b - a)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


#: Seeds or chains whose words are compared at once, and words that travel in one batch, about.
AT_ONCE, SENT_WORDS = 2000, 1 << 20


def _groups(size: np.ndarray, limit: int):
    """(start, stop) of runs of rows that hold about ``limit`` in all."""
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")), start + 1)
        yield start, stop
        start = stop


def _coder(batches):
    """Rows (ref, text, pairs with lone seeds that lead to it) to a row a pair, with a byte of each word around each seed."""
    for batch in batches:
        for a, b, texts in text_slices(batch, "text"):
            code, first = _codes(texts)
            doc, pairs = _chains_of(batch, a, b)
            ref = column_ids(batch, "ref").slice(a, b - a)
            y, size = _ints(pairs.field("ys"))
            own, upto = np.repeat(doc, size), np.concatenate(([0], np.cumsum(size)))
            for p, q in _groups(size, AT_ONCE):
                around = [_beside(code, first, own[k:min(k + AT_ONCE, upto[q])], y[k:min(k + AT_ONCE, upto[q])], BESIDE + ASIDE, BESIDE + SEED + ASIDE)
                          for k in range(upto[p], upto[q], AT_ONCE)]
                part = pairs.slice(p, q - p)
                yield pa.RecordBatch.from_arrays([part.field("id"), ref.take(pa.array(doc[p:q])), part.field("xs"), part.field("ys"),
                                                  _binaries(np.concatenate(around), size[p:q])], ["id", "ref", "xs", "ys", "around"])


def may_agree(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether some MIN_WORDS words in a row of ``own`` match ``other`` at SCREEN places, each up to ASIDE places aside."""
    same = np.zeros(own.shape, bool)
    for d in range(2 * ASIDE + 1):
        same |= own == other[:, d:d + own.shape[1]]
    same &= own != 0
    total = np.zeros((len(own), own.shape[1] + 1), np.int16)
    np.cumsum(same, axis=1, out=total[:, 1:])
    return (total[:, MIN_WORDS:] - total[:, :-MIN_WORDS]).max(axis=1) >= SCREEN


def _screen(batches):
    """Rows (id, text, pairs with lone seeds and the words around them in their source) to a row a pair, with the seeds that may begin a passage."""
    width = 2 * BESIDE + SEED + 2 * ASIDE
    for batch in batches:
        for a, b, texts in text_slices(batch, "text"):
            code, first = _codes(texts)
            doc, pairs = _chains_of(batch, a, b)
            id_ = column_ids(batch, "id").slice(a, b - a)
            (x, size), (y, _) = _ints(pairs.field("xs")), _ints(pairs.field("ys"))
            own, upto = np.repeat(doc, size), np.concatenate(([0], np.cumsum(size)))
            for p, q in _groups(size, AT_ONCE):
                part = pairs.slice(p, q - p)
                other = np.frombuffer(b"".join(part.field("around").to_pylist()), np.uint8).reshape(-1, width)
                kept = np.concatenate([may_agree(_beside(code, first, own[k:k + AT_ONCE][:upto[q] - k], x[k:k + AT_ONCE][:upto[q] - k], BESIDE, BESIDE + SEED),
                                                 other[k - upto[p]:k - upto[p] + AT_ONCE]) for k in range(upto[p], upto[q], AT_ONCE)])
                left = np.bincount(np.repeat(np.arange(q - p), size[p:q])[kept], minlength=q - p)
                some = np.flatnonzero(left)
                if len(some):
                    xs, ys = (_binaries(v[upto[p]:upto[q]][kept].astype("<i4"), left[some]) for v in (x, y))
                    yield pa.RecordBatch.from_arrays([
                        id_.take(pa.array(doc[p:q][some])), part.field("ref").take(pa.array(some)),
                        _binaries(np.ones(left.sum(), "<i4"), left[some]), xs, ys], ["id", "ref", "ns", "xs", "ys"])


def _dealt(chained: DataFrame, *fields: str) -> DataFrame:
    """ref, part, chains: the matches of at most about TOGETHER documents with one document in a row."""
    parts = chained.groupBy("ref").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    return (chained.join(parts, "ref").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            .groupBy("ref", "part").agg(F.collect_list(F.struct(*fields)).alias("chains")))


def _cutter(margin: int):
    """Rows (ref, text, pairs of several documents with it) to a row a pair, with the earlier document's words around its chains.

    Words that lie around several chains travel once: froms, sizes: where each stretch of words begins, and how many they are; total: all words of the text.
    """
    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                number, first, _ = _word_numbers(texts)
                doc, pairs = _chains_of(batch, a, b)
                ref = column_ids(batch, "ref").slice(a, b - a)
                (n, n_chains), (y, _) = _ints(pairs.field("ns")), _ints(pairs.field("ys"))
                total = np.diff(first)[doc]
                pair, stop = np.repeat(np.arange(len(doc)), n_chains), np.cumsum(n)
                lo, hi = (np.clip(v, 0, total[pair]) + (pair << 32) for v in (y[stop - n] - margin, y[stop - 1] + SEED + margin))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.concatenate((np.ones(min(len(lo), 1), bool), lo[1:] > hi[:-1])))
                own, frm = lo[new] >> 32, lo[new] & 0xFFFFFFFF
                size = hi[np.append(new[1:], len(hi)) - 1] - lo[new] if len(new) else np.zeros(0, np.int64)
                parts = np.bincount(own, minlength=len(doc))          # stretches of a pair
                words = np.bincount(own, size, minlength=len(doc)).astype(np.int64)
                upto = np.concatenate(([0], np.cumsum(parts)))
                for p, q in _groups(words, SENT_WORDS):
                    s, t = upto[p], upto[q]
                    begin = first[doc[own[s:t]]] + frm[s:t]
                    at = np.arange(size[s:t].sum()) + np.repeat(begin - (np.cumsum(size[s:t]) - size[s:t]), size[s:t])
                    part = pairs.slice(p, q - p)
                    yield pa.RecordBatch.from_arrays([
                        part.field("id"), ref.take(pa.array(doc[p:q])), part.field("ns"), part.field("xs"), part.field("ys"),
                        _binaries(frm[s:t].astype("<i4"), parts[p:q]), _binaries(size[s:t].astype("<i4"), parts[p:q]),
                        pa.array(total[p:q], pa.int32()), _binaries(number[at], words[p:q])],
                        ["id", "ref", "ns", "xs", "ys", "froms", "sizes", "total", "words"])
    return run


def may_widen(a, b, start, stop, o, p, good, room, o_room, la, lb):
    """Whether each of many short alignments may become a passage when ``widened``: those of a[start:stop] and b[o:p].

    room, o_room: words before the alignments; la, lb: words after them.
    """
    need = MIN_WORDS - (stop - start)
    left, right = np.minimum(need, np.minimum(room, o_room)), np.minimum(need, np.minimum(la, lb))
    col = np.arange(MIN_WORDS)
    sums = []
    for u, v, n, step in ((start - 1, o - 1, left, -1), (stop, p, right, 1)):
        same = np.take(a, u[:, None] + step * col, mode="clip") == np.take(b, v[:, None] + step * col, mode="clip")
        total = np.zeros((len(u), MIN_WORDS + 1), np.int16)
        np.cumsum(same & (col < n[:, None]), axis=1, out=total[:, 1:])
        sums.append(total)
    e = np.arange(MIN_WORDS + 1)                             # words before
    fits = (e >= (need - right)[:, None]) & (e <= left[:, None])
    total = sums[0] + np.take_along_axis(sums[1], np.clip(need[:, None] - e, 0, MIN_WORDS), axis=1)
    return np.where(fits, total, -MIN_WORDS).max(axis=1) + good >= SIMILARITY * MIN_WORDS


def found(number: np.ndarray, rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Repeated passages of one document, by its word numbers and its chains; and the chains whose source must be seen further."""
    some = []
    for c in rows:
        other = np.frombuffer(c["words"], np.uint32)
        xs, ys = np.frombuffer(c["xs"], "<i4"), np.frombuffer(c["ys"], "<i4")
        x, y = xs[:, None] + np.arange(SEED), ys[:, None] - c["shift"] + np.arange(SEED)
        # seeds of another text under the same id do not hold here
        held = (x[:, -1] < len(number)) & (y[:, -1] < len(other))
        held[held] = (number[x[held]] == other[y[held]]).all(axis=1)
        if held.any():
            some.append((c["ref"], xs[held], ys[held], c["shift"], c["more"], other, {}))
    got, unsure = _found(number, sorted(some, key=lambda c: -len(c[1])))
    return got, [{"ref": ref, "xs": _bytes(xs), "ys": _bytes(ys)} for ref, xs, ys in unsure]


def _judged(number: np.ndarray, other: np.ndarray, shift: int, more: bool, xs: np.ndarray, ys: np.ndarray, ends=None):
    """What a chain is: a passage (start, stop, other start, other stop, matches), none (None), open (the source must be seen further; True),
    or so many seeds after which it is to be cut."""
    start, stop, o, p, good, before, behind = align(number, other, shift, xs, ys, ends)
    if before and shift or behind and more:
        return True
    if stop - start < MIN_WORDS:
        start, stop, o, p, good = widened(number, other, shift, start, stop, o, p, good)
    if stop - start < MIN_WORDS:
        return None
    if good >= SIMILARITY * max(stop - start, p - o):
        return start, stop, o, p, good
    return int((np.diff(xs) + np.diff(ys)).argmax()) + 1 if len(xs) > 1 else None


def _found(number: np.ndarray, chained) -> tuple[list[dict], list[tuple]]:
    """As ``found``, of chains (ref, xs, ys, shift, more, words of ref from shift on, known), the longest first.

    known: what ``_judged`` says of the chain's parts, by their first and last seed, as far as it was asked.
    """
    out, unsure = [], []
    at: dict[tuple, list[dict]] = {}                         # passages by document and by 64 words
    for ref, xs, ys, shift, more, other, known in chained:
        tries = [(0, len(xs))]
        while tries:
            a, b = tries.pop()
            x, y, last_x, last_y = int(xs[a]), int(ys[a]), int(xs[b - 1]), int(ys[b - 1])
            if any(r["start"] <= x and last_x + SEED <= r["stop"] and r["ref_start"] <= y and last_y + SEED <= r["ref_stop"]
                   for r in at.get((ref, x >> 6), ())):
                continue                                     # within a passage found
            said = known[a, b] if (a, b) in known else _judged(number, other, shift, more, xs[a:b], ys[a:b])
            if said is True:
                unsure.append((ref, xs[a:b], ys[a:b]))
            elif isinstance(said, tuple):
                out.append(dict(zip(("start", "stop", "ref", "ref_start", "ref_stop", "n_same"), (*said[:2], ref, *said[2:]))))
                for k in range(said[0] >> 6, (said[1] >> 6) + 1):
                    at.setdefault((ref, k), []).append(out[-1])
            elif said:
                tries += [(a, a + said), (a + said, b)]
    return sorted(out, key=lambda r: (r["start"], -r["stop"])), unsure


def _found_in(number: np.ndarray, first: np.ndarray, doc: np.ndarray, pairs: pa.StructArray, margin: int):
    """``_found`` of each of some texts (word numbers, and where each text's begin), by the pairs of each: text, passages, unsure chains."""
    (n, n_chains), (x, _), (y, _) = (_ints(pairs.field(c)) for c in ("ns", "xs", "ys"))
    (frm, parts), (size, _) = (_ints(pairs.field(c)) for c in ("froms", "sizes"))
    words = np.frombuffer(b"".join(pairs.field("words").to_pylist()), np.uint32)
    total = pairs.field("total").to_numpy(zero_copy_only=False).astype(np.int64)
    refs = pairs.field("ref").to_pylist()
    pair, stop = np.repeat(np.arange(len(doc)), n_chains), np.cumsum(n)
    lo, hi = np.clip(y[stop - n] - margin, 0, total[pair]), y[stop - 1] + SEED + margin
    more = hi < total[pair]
    hi = np.minimum(hi, total[pair])
    stretch = np.searchsorted((np.repeat(np.arange(len(doc)), parts) << 32) + frm, (pair << 32) + lo, side="right") - 1
    base = (np.cumsum(size) - size - frm)[stretch]           # of the earlier document's first word among all words sent
    home, room = first[doc[pair]], np.diff(first)[doc[pair]]
    # seeds of another text under the same id do not hold here
    own = np.repeat(np.arange(len(n)), n)
    held = (x + SEED <= room[own]) & (y + SEED <= hi[own])
    for k in range(SEED):
        at = np.flatnonzero(held)
        held[at] = number[home[own[at]] + x[at] + k] == words[base[own[at]] + y[at] + k]
    x, y, left = x[held], y[held], np.bincount(own[held], minlength=len(n))
    stop = np.cumsum(left)
    some = np.flatnonzero(left)
    known: list[dict] = [{} for _ in range(len(n))]
    begin = stop - left

    def view(c):
        return words[base[c] + lo[c]:base[c] + hi[c]]
    # chains of few words around them together; then the parts of those that are to be cut, and so on
    wave = [(c, begin[c], stop[c]) for c in some.tolist()] if margin <= MARGIN else []
    while wave:
        then = []
        for p in range(0, len(wave), AT_ONCE):
            c, s, t = np.array(wave[p:p + AT_ONCE]).T
            x0, y0, x1, y1 = x[s], y[s], x[t - 1] + SEED, y[t - 1] + SEED
            back, behind, good, open_ = extensions(number, words, home[c] + x0 - 1, base[c] + y0 - 1, x0, y0 - lo[c], -1)
            unsure = open_ & (lo[c] > 0)
            rest = np.flatnonzero(~unsure)
            d = c[rest]
            after = np.zeros((3, len(c)), np.int64)
            *after[:, rest], open_ = extensions(number, words, home[d] + x1[rest], base[d] + y1[rest], room[d] - x1[rest], hi[d] - y1[rest], 1)
            unsure[rest] |= open_ & more[d]
            # most lone seeds stay short and agree too little around them
            none = np.zeros(len(c), bool)
            d = np.flatnonzero((t - s == 1) & ~unsure & (x1 - x0 + back + after[0] < MIN_WORDS))
            k, u, v = c[d], x0[d] - back[d], x1[d] + after[0][d]
            o, e = y0[d] - behind[d], y1[d] + after[1][d]
            none[d] = ~may_widen(number, words, home[k] + u, home[k] + v, base[k] + o, base[k] + e, good[d] + SEED + after[2][d],
                                 u, o - lo[k], room[k] - v, hi[k] - e)
            for k, u, v, far, no, *ends in zip(*(v.tolist() for v in (c, s, t, unsure, none, back, behind, good, *after))):
                said = None if no else far or _judged(number[home[k]:home[k] + room[k]], view(k), int(lo[k]), bool(more[k]), x[u:v], y[u:v], ends)
                known[k][u - int(begin[k]), v - int(begin[k])] = said
                if type(said) is int:
                    then += [(k, u, u + said), (k, u + said, v)]
        wave = then
    order = some[np.lexsort((y[begin[some]], x[begin[some]], -n[some], doc[pair[some]]))]
    by_doc = doc[pair[order]]
    for p, q in _groups_of(by_doc):
        k = int(by_doc[p])
        yield k, *_found(number[first[k]:first[k + 1]], (
            (refs[pair[c]], x[begin[c]:stop[c]], y[begin[c]:stop[c]], int(lo[c]), bool(more[c]), view(c), known[c])
            for c in order[p:q].tolist()))


def _groups_of(values: np.ndarray):
    """(start, stop) of the runs of equal values."""
    at = np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))
    yield from zip(at.tolist(), np.append(at[1:], len(values)).tolist())


def _aligner(id_type, margin: int):
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ref", id_type), ("ref_start", pa.int32()),
                      ("ref_stop", pa.int32()), ("n_same", pa.int32())])
    chain = pa.struct([("ref", id_type), ("ns", pa.binary()), ("xs", pa.binary()), ("ys", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                number, first, _ = _word_numbers(texts)
                some, got, open_ = [], [], []
                for k, own, unsure in _found_in(number, first, *_chains_of(batch, a, b), margin):
                    if own or unsure:
                        by_ref: dict = {}
                        for ref, xs, ys in unsure:
                            by_ref.setdefault(ref, []).append((xs, ys))
                        some.append(k)
                        got.append(own)
                        open_.append([{"ref": ref, "ns": _bytes([len(xs) for xs, _ in cs]), "xs": _bytes(np.concatenate([xs for xs, _ in cs])),
                                       "ys": _bytes(np.concatenate([ys for _, ys in cs]))} for ref, cs in by_ref.items()])
                yield pa.RecordBatch.from_arrays([
                    column_ids(batch, "id").slice(a, b - a).take(pa.array(some, pa.int64())),
                    column_ids(batch, "h").slice(a, b - a).take(pa.array(some, pa.int64())),
                    pa.array(np.diff(first)[some], pa.int64()), pa.array(got, pa.list_(span)),
                    pa.array(open_, pa.list_(chain))], ["id", "h", "n_words", "passages", "unsure"])
    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", screen: bool = False) -> DataFrame:
    """(id, h, n_words, passages) of the documents that repeat an earlier one or themselves, staged; h: hash of the text.

    screen: lone seeds are screened before they are aligned, which costs two more joins with the texts and pays
    where most seeds are accidental.
    passages: array of (start, stop, ref, ref_start, ref_stop, n_same), in words, half open.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    kind, id_type = dict(docs.dtypes)["id"], to_arrow_type(docs.schema["id"].dataType)
    hits = staged(_matches(docs, seeds), "seeds")
    sent = _shared_filter(hits.filter("bits is not null").select("x", "bits"))
    hits = hits.filter("bits is null").select("id", "ref", "x", "y")
    whole = _matches(docs, lambda texts: wide(texts, sent.value)).filter("bits is null")
    whole = (whole.groupBy("id", "ref", (F.col("y") - F.col("x")).alias("shift"), F.shiftright("x", 4).alias("part"))
             .agg(F.min("x").alias("x")).select("id", "ref", "x", (F.col("x") + F.col("shift")).alias("y")))
    hits = hits.unionByName(whole)
    pair = PAIR.format(kind)
    chained = staged(hits.repartition("id").sortWithinPartitions("id", "ref", "x", "y")
                     .mapInArrow(_chainer(id_type), f"id {kind}, ref {kind}, lone boolean, ns binary, xs binary, ys binary"), "chains")
    texts = docs
    if screen:
        coded = (_dealt(chained.filter("lone"), "id", "xs", "ys").join(docs.select(F.col("id").alias("ref"), "text"), "ref")
                 .select("ref", "text", "chains").mapInArrow(_coder, f"id {kind}, ref {kind}, xs binary, ys binary, around binary"))
        lone = staged(coded.groupBy("id").agg(F.collect_list(F.struct("ref", "xs", "ys", "around")).alias("chains")).join(docs, "id")
                      .select("id", "text", "chains").mapInArrow(_screen, pair), "screened")
        chained = chained.filter("not lone").drop("lone").unionByName(lone)
        # few documents are left: the others' texts stay where they are
        texts = near(docs, "id", chained.select("id").distinct())
        sources = near(docs.select(F.col("id").alias("ref"), "text"), "ref", chained.select("ref").distinct())
    else:
        sources = docs.select(F.col("id").alias("ref"), "text")
    margin, out = MARGIN, None
    while True:
        sides = (_dealt(chained, "id", "ns", "xs", "ys").join(sources, "ref").select("ref", "text", "chains")
                 .mapInArrow(_cutter(margin), f"{pair}, froms binary, sizes binary, total int, words binary"))
        each = sides.groupBy("id").agg(F.collect_list(F.struct("ref", "ns", "xs", "ys", "froms", "sizes", "total", "words")).alias("chains"))
        got = staged(each.join(texts, "id").select("id", F.xxhash64("text").alias("h"), "text", "chains").mapInArrow(
            _aligner(id_type, margin), f"id {kind}, h long, n_words long, passages array<struct<start:int,stop:int,ref:{kind},"
                               f"ref_start:int,ref_stop:int,n_same:int>>, unsure array<struct<ref:{kind},ns:binary,xs:binary,ys:binary>>"), "passages")
        own = got.filter("size(passages) > 0").drop("unsure")
        out = own if out is None else out.unionByName(own)
        chained = got.select("id", F.explode("unsure").alias("c")).select("id", "c.*").distinct()
        if chained.isEmpty():                                # at the latest when the margin is the longest text
            break
        margin *= 64
    if margin > MARGIN:
        out = out.groupBy("id", "h", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("passages"))).alias("passages"))
    return out


def report(docs: DataFrame) -> DataFrame:
    """A row for each passage of an earlier document: doc_id, start, stop (words, half open), ref_doc_id, ref_start, ref_stop, n_same.

    Passages with their own document as source are in ``passages`` and cut by ``deduplicated``; they have no row here.
    """
    return (passages(docs, screen=True).select(F.col("id").alias("doc_id"), F.explode("passages").alias("p")).filter("p.ref <> doc_id")
            .select("doc_id", "p.start", "p.stop", F.col("p.ref").alias("ref_doc_id"), "p.ref_start", "p.ref_stop", "p.n_same").distinct())


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some stretches of its words, and without what stands between a stretch's words."""
    w = Words(pa.array([text], pa.string()))
    raw = text.encode()
    out, at, upto = [], 0, 0
    for a, b in sorted(spans):
        a, b = max(a, upto), min(b, len(w.starts))
        if a >= b:
            continue
        out.append(raw[at:w.starts[a]])
        # signs behind the last word go with it, up to the next word
        at = int(w.starts[b]) if b < len(w.starts) else len(raw)
        upto = b
    out.append(raw[at:])
    return b"".join(out).decode()


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from all documents but the first; n_chars, if there, follows the text."""
    spark = docs.sparkSession
    prepare(spark)
    spans = (passages(docs).dropDuplicates(["id", "h"])       # rows of one id and text have the same passages
             .select(F.col("id").alias("_llm_id"), F.col("h").alias("_llm_h"), F.transform("passages", lambda p: F.struct(p["start"], p["stop"])).alias("_llm_spans")))

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: None if t is None or s is None else without(t, [(x["start"], x["stop"]) for x in s]))

    joined = docs.join(spans, (docs["doc_id"] == spans["_llm_id"]) & (F.xxhash64(docs["text"]) == spans["_llm_h"]), "left")
    new = F.when(F.col("_llm_spans").isNull(), docs["text"]).otherwise(
        cut(F.when(F.col("_llm_spans").isNotNull(), docs["text"]), F.col("_llm_spans")))
    out = joined.withColumn("_llm_text", new)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_llm_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("_llm_spans").isNull(), docs["n_chars"])
                           .otherwise(F.length("_llm_text").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            columns.append(docs[c])
    return out.select(*columns)
