"""Phrases whose words come together more often than their parts suggest.

Counts come from suffix trees cut off at a phrase's greatest length, built in
parts.  Every word of a piece starts a suffix, the next words of the piece up
to that length.  Suffixes are dealt by their first words: a prefix whose
suffixes fit a task's memory goes, with other such prefixes, to one group; a
prefix with more is lengthened by a word, its longer prefixes are counted and
dealt alike, down to whole suffixes, which are leaves.  So no group grows with
a word's frequency.  A group builds its subtrees on its own: the suffixes in
order are the leaves, with their numbers; the count of an inner node, and so
of a phrase, is the total of the leaves below it.

Each scan of the texts adds up equal suffixes of a stretch of text before they
are shuffled, a packed run of them a group.  A word stands for itself as 64
bits of its language and letters; the vocabulary is counted first, and should
two words share their bits, another hash is taken, so counts are exact.

A phrase of 2 to 3 words that occurs ``a`` times, cut into a first part with
``l`` occurrences and a rest with ``r``, scores floor(10^6 a a / (l r)) at
that cut, the least score counts.  Its own subtree knows ``l`` at every cut;
``r`` is looked up among the nodes of others.  Products are decimals of 38
digits (10^6 a a stays below 10^38 up to 10^16 occurrences).

Cases: null and empty texts have no words; a null language is ``und``; white
space in a piece separates words only; a phrase never leaves its piece; every
row counts, repeated rows as well; ties follow the phrase in byte order; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ids, merged, mix, prepare, staged, text_slices
from .words import Words, span_hashes

#: Words of the longest phrase; occurrences a candidate needs; phrases a language.
LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one around it has at least this share of its occurrences, in percent.
COVERED = 50
#: Suffixes that one group's subtrees may stand for, and most prefixes that are lengthened.
BUDGET, MOST = 1_500_000, 1_000_000
#: Bytes of text whose equal suffixes are added up before they are shuffled.
STRETCH_BYTES = 4 << 20
#: Bytes of packed suffixes in an Arrow batch.
PACKED_BYTES = 2 << 20
UNKNOWN = "und"

MEMBER = np.ones(256, dtype=bool)
MEMBER[[ord(c) for c in " \t.,;:!?\n\x0b\f\r"]] = False
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True


def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Stretch:
    """Words of a batch of texts: 64 bits each (of language and letters), and how many words of its piece follow it."""

    def __init__(self, batch: pa.RecordBatch, seed: int, strings: bool = False):
        lang = ids(batch, "lang")
        names = lang.dictionary_encode()
        which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(lang) else np.zeros(0, np.int64)
        self.langs = names.dictionary.to_pylist()
        code = np.array([int.from_bytes(_short(x, seed), "little") for x in self.langs], dtype=np.uint64)
        table = _byte_table(seed)
        keys, left, owners, texts = [], [], [], []
        for a, b, part in text_slices(batch, "text"):
            w = Words(part, MEMBER)
            if not len(w.starts):
                continue
            own = which[a:b][w.doc]
            keys.append(mix(span_hashes(w.data, w.starts, w.ends, table) ^ code[own]))
            owners.append(own)
            # a piece ends at a break or at the end of a text, which is a line end
            breaks = np.cumsum(_BREAK[w.data], dtype=np.int32)
            piece = breaks[w.starts]
            last = np.append(np.flatnonzero(piece[1:] != piece[:-1]), len(piece) - 1)
            left.append(last[np.searchsorted(last, np.arange(len(piece)))] - np.arange(len(piece)))
            if strings:
                texts.append(w.strings())
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.left = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.texts = texts


def _short(text: str, seed: int) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "little")).digest()


def _vocabulary(seed: int):
    def run(batches):
        for batch in merged(batches, STRETCH_BYTES):
            s = Stretch(batch, seed, strings=True)
            if not len(s.keys):
                continue
            words = pa.concat_arrays(s.texts)
            # equal words of one language have equal bits; unequal words of equal bits must both be kept
            t = pa.table({"lang": pa.array(s.owner), "word": words, "key": pa.array(s.keys.view(np.int64))})
            t = t.group_by(["lang", "word", "key"]).aggregate([([], "count_all")])
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.langs, pa.string()).take(t.column("lang").combine_chunks()), t.column("word").combine_chunks(),
                 t.column("key").combine_chunks(), t.column("count_all").combine_chunks()], ["lang", "word", "key", "n"])
    return run


def _in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) ^ mix(b))


class Pairs:
    """A few two-word prefixes with their counts, looked up by both words."""

    def __init__(self, k1=(), k2=(), n=()):
        k1, k2, n = np.asarray(k1, np.uint64), np.asarray(k2, np.uint64), np.asarray(n, np.int64)
        self.hash, at = np.unique(_pair(k1, k2), return_index=True)
        self.k1, self.k2, self.n = k1[at], k2[at], n[at]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it one of them, its place)"""
        if not len(self.hash):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        at = np.searchsorted(self.hash, _pair(a, b))
        at[at == len(self.hash)] = 0
        return (self.k1[at] == a) & (self.k2[at] == b), at


def _suffixes(s: Stretch, words: int, only: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes (their first words; 0 where the piece has ended), in order, and how often each occurs.

    only: words that a suffix must start with.
    """
    values, code = np.unique(s.keys, return_inverse=True)
    values, code = np.append(np.uint64(0), values), code.astype(np.uint64) + np.uint64(1)
    at = np.arange(len(code)) if only is None else np.flatnonzero(_in(values, only)[code.astype(np.int64)])
    codes = [code[at]]
    for j in range(1, words):
        own = code[np.minimum(at + j, len(code) - 1)]
        own[s.left[at] < j] = 0
        codes.append(own)
    bits = max(1, int(len(values) - 1).bit_length())
    if bits * words <= 64:
        packed = codes[0]
        for own in codes[1:]:
            packed = (packed << np.uint64(bits)) | own
        packed, times = np.unique(packed, return_counts=True)
        codes = [(packed >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1) for j in reversed(range(words))]
    elif len(at):
        order = np.lexsort(tuple(reversed(codes)))
        codes = [c[order] for c in codes]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))
        first = np.flatnonzero(new)
        codes, times = [c[first] for c in codes], np.diff(np.append(first, len(order)))
    else:
        times = np.zeros(0, np.int64)
    return [values[c.astype(np.int64)] for c in codes], times


def _runs(group: np.ndarray, words: list[np.ndarray], n: np.ndarray):
    """Arrow batches of (grp, leaves): a packed run of suffixes a group, word by word and then their numbers.

    Suffixes stay in order within a run, so that equal words stand together.
    """
    order = np.argsort(group, kind="stable")
    group = group[order]
    columns = [x[order] for x in (*words, n.astype(np.uint32))]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    held, size = [], 0
    for x, y in zip(first, np.append(first[1:], len(group))):
        held.append((int(group[x]), b"".join(c[x:y].tobytes() for c in columns)))
        size += len(held[-1][1])
        if size >= PACKED_BYTES or y == len(group):
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.int32()), pa.array([v for _, v in held], pa.binary())],
                                             ["grp", "leaves"])
            held, size = [], 0


def _unpacked(column, words: int) -> list[np.ndarray]:
    """Words and numbers of all suffixes of a group's runs, in order, with equal ones still apart."""
    runs = [x.as_buffer() for x in column]
    sizes = [len(r) // (8 * words + 4) for r in runs]
    out = [np.concatenate([np.frombuffer(r, np.uint64, n, 8 * n * j) for r, n in zip(runs, sizes)]) for j in range(words)]
    n = np.concatenate([np.frombuffer(r, np.uint32, n, 8 * n * words) for r, n in zip(runs, sizes)]).astype(np.int64)
    order = np.lexsort(tuple(reversed(out)))
    return [*(x[order] for x in out), n[order]]


def _second_words(sent):
    """Two-word prefixes that begin with a word of more suffixes than fit, dealt by both words."""
    def run(batches):
        seed, heavy, groups = sent.value
        for batch in merged(batches, STRETCH_BYTES):
            s = Stretch(batch, seed)
            if len(s.keys):
                (a, b), n = _suffixes(s, 2, heavy)
                if len(a):
                    yield from _runs((_pair(a, b) % np.uint64(groups)).astype(np.int32), [a, b], n)
    return run


def _more_than(fits: int):
    def run(table: pa.Table) -> pa.Table:
        a, b, n = _unpacked(table.column("leaves"), 2)
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(n, first)
        first, total = first[total > fits], total[total > fits]
        return pa.table({"k1": a[first].view(np.int64), "k2": b[first].view(np.int64), "n": total})
    return run


def _dealt(sent):
    """Suffixes by the group of their prefix: one packed run a stretch and group."""
    def run(batches):
        seed, heavy, heavy_pairs, groups = sent.value
        for batch in merged(batches, STRETCH_BYTES):
            s = Stretch(batch, seed)
            if not len(s.keys):
                continue
            (a, b, c), n = _suffixes(s, LONGEST)
            prefix = a.copy()
            more = _in(a, heavy)
            prefix[more] = _pair(a[more], b[more])
            most = more & heavy_pairs.find(a, b)[0]
            prefix[most] = _pair(prefix[most], c[most])
            group = (mix(prefix) % np.uint64(groups)).astype(np.int32)
            del s, prefix, more, most
            yield from _runs(group, [a, b, c], n)
    return run


NODES = "k1 long, k2 long, k3 long, a long, l1 long, l2 long"


def _subtrees(sent):
    """Nodes of a group's subtrees that stand for phrases: words, count, and counts of their first one and two words.

    Where a prefix was lengthened, the counts of its own nodes lie in several
    groups: the node of a single word is known from the vocabulary, that of
    two words from their count.
    """
    def run(table: pa.Table) -> pa.Table:
        heavy, heavy_n, pairs, least = sent.value
        a, b, c, n = _unpacked(table.column("leaves"), LONGEST)
        new1 = np.append(True, a[1:] != a[:-1])
        new2 = new1 | np.append(True, b[1:] != b[:-1])
        new3 = new2 | np.append(True, c[1:] != c[:-1])
        total = []
        for new in (new1, new2, new3):
            at = np.flatnonzero(new)
            total.append((at, np.add.reduceat(n, at)))
        one = np.repeat(total[0][1], np.diff(np.append(total[0][0], len(n))))
        two = np.repeat(total[1][1], np.diff(np.append(total[1][0], len(n))))
        more = _in(a, heavy)
        if more.any():
            one[more] = heavy_n[np.searchsorted(heavy, a[more])]
        split, at = pairs.find(a, b)
        split &= more
        if split.any():
            two[split] = pairs.n[at[split]]
        at2 = total[1][0][(b[total[1][0]] != 0) & ~split[total[1][0]] & (two[total[1][0]] >= least)]
        at3 = total[2][0][(c[total[2][0]] != 0) & (total[2][1] >= least)]
        n3 = total[2][1][(c[total[2][0]] != 0) & (total[2][1] >= least)]
        k = [np.concatenate([x[at2], x[at3]]).view(np.int64) for x in (a, b, c)]
        k[2][:len(at2)] = 0
        return pa.table({"k1": k[0], "k2": k[1], "k3": k[2], "a": np.concatenate([two[at2], n3]),
                         "l1": np.concatenate([one[at2], one[at3]]), "l2": np.concatenate([np.zeros(len(at2), np.int64), two[at3]])})
    return run


def nodes(docs: DataFrame, vocabulary: DataFrame, seed: int, total: int, budget: int = BUDGET, least: int = LEAST) -> DataFrame:
    """k1, k2, k3, a, l1, l2 of every phrase of two (k3 = 0) or three words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    groups = max(1, math.ceil(total / budget))
    fits = max(budget // 4, total // MOST)                   # suffixes that a shared group takes from one prefix
    heavy = _sorted(vocabulary.filter(F.col("n") > fits).select("key", "n"))
    pairs = Pairs()
    split = None
    if len(heavy[0]):
        sent = spark.sparkContext.broadcast((seed, heavy[0], groups))
        second = (docs.mapInArrow(_second_words(sent), "grp int, leaves binary")
                  .groupBy("grp").applyInArrow(_more_than(fits), "k1 long, k2 long, n long"))
        t = second.toArrow()                                 # total / fits rows at most
        k1, k2, n = (t.column(i).to_numpy() for i in range(3))
        pairs = Pairs(k1.view(np.uint64), k2.view(np.uint64), n)
        real = pairs.k2 != 0
        if real.any():
            one = heavy[1][np.searchsorted(heavy[0], pairs.k1[real])]
            none = np.zeros(real.sum(), np.int64)
            split = spark.createDataFrame(pa.table({"k1": pairs.k1[real].view(np.int64), "k2": pairs.k2[real].view(np.int64), "k3": none,
                                                    "a": pairs.n[real], "l1": one, "l2": none}))
    sent = spark.sparkContext.broadcast((seed, heavy[0], pairs, groups))
    known = spark.sparkContext.broadcast((*heavy, pairs, least))
    out = docs.mapInArrow(_dealt(sent), "grp int, leaves binary").groupBy("grp").applyInArrow(_subtrees(known), NODES)
    return out if split is None else out.unionByName(split.filter(F.col("a") >= least))


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (in order) and counts of the few words that are lengthened."""
    t = df.toArrow()
    key, n = (t.column(i).to_numpy() for i in range(2))
    key = key.view(np.uint64)
    order = np.argsort(key)
    return key[order], n[order]


def _score(a: str, left: str, right: str):
    """floor(10^6 a a / (left right)), exact."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * cast(1000000 as decimal(7,0)))"
                  f" div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:
        words = staged(docs.mapInArrow(_vocabulary(seed), "lang string, word string, key long, n long")
                       .groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "vocabulary")
        # 0 marks a piece's end; two words of equal bits would be one
        if words.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1 or key = 0").isEmpty():
            break
        seed += 1
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    total = words.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found = staged(nodes(docs, words.select("key", "n"), seed, total, budget, least), "phrases")
    often = words.filter(F.col("n") >= least)
    two = found.filter("k3 = 0")
    three = found.filter("k3 <> 0")
    one = often.select(F.col("key").alias("last"), F.col("n").alias("r1"))
    # the rest of a pair is a word; the rests of three are two words (cut after the first) and one
    pairs = two.join(one, two.k2 == one.last).select(
        "k1", "k2", "k3", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), _score("a", "l1", "r1").alias("score"))
    rest = two.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("a").alias("r2"))
    triples = (three.join(rest, (three.k2 == rest.q1) & (three.k3 == rest.q2)).join(one, three.k3 == one.last)
               .withColumn("s1", _score("a", "l1", "r2")).withColumn("s2", _score("a", "l2", "r1"))
               .select("k1", "k2", "k3", "a", F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
                       F.when(F.col("s1") <= F.col("s2"), F.col("r2")).otherwise(F.col("r1")).alias("r"),
                       F.least("s1", "s2").alias("score")))
    around = (three.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "a")
              .unionByName(three.select(F.col("k2").alias("p1"), F.col("k3").alias("p2"), "a"))
              .groupBy("p1", "p2").agg(F.max("a").alias("longer")))
    kept = (pairs.join(around, (pairs.k1 == around.p1) & (pairs.k2 == around.p2), "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a"))).drop("p1", "p2", "longer"))
    scored = kept.unionByName(triples)
    lang = often.select(F.col("key").alias("k1"), "lang", F.col("word").alias("w1"))
    # all that may tie with the last phrase, before their words are looked up
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = staged(scored.join(lang, "k1").withColumn("place", F.rank().over(ahead)).filter(F.col("place") <= top).drop("place"), "ranked")
    spelt = (best.join(often.select(F.col("key").alias("k2"), F.col("word").alias("w2")), "k2")
             .join(often.select(F.col("key").alias("k3"), F.col("word").alias("w3")), "k3", "left")
             .withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (spelt.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .join(F.broadcast(per_lang.select("lang", F.col("lang_n").alias("n"))), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
