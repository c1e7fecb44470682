"""Language-model scoring by subword lattice likelihood.

The model is a unigram model over an existing vocabulary of pieces: a text's
probability is the sum over all its segmentations into pieces of the product
of the pieces' probabilities, found by a log-space forward recursion.  Texts
are lower-cased (A-Z) and split at white space; a word is led by the
vocabulary's space sign, and one end event closes a text.  Pieces never reach
across words, so a text's lattice is its words' lattices in a row, and each
distinct word of the corpus needs one recursion.  Byte pieces stand everywhere,
so every text has a probability.

The vocabulary's own scores (of a merge-type model: its ranks) give the first
weights, falling with rank.  Forward-backward passes over the distinct training
words replace them by expected counts.  A word that training has seen is one
more piece of its lattice, weighing its count less a discount; what the
discounts free goes to the paths through pieces:

    P(word) = (max(c - D, 0) + (D * kinds + 1/2) * lattice(word)) / (N + 1)
    P(end) = (ends + 1/2) / (N + 1)

On Spark: texts are taken in chunks of a bounded size; a chunk holds its
distinct words and, for each text, the numbers of its words.  Chunks are
written to the shared folder.  Distinct words of all chunks are counted and
scored once and joined back to the chunks that have them: at most one row a
word and chunk moves, so no common word is a hot key, and nothing larger than
the vocabulary comes to the driver.

Learning counts only texts whose crc32(id) mod 7 is not 2.

Cases: null and empty texts have the end event alone; rows that repeat an id
are counted and scored row by row; a null id counts as learnt from; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import merged, prepare, staged, text_slices
from .quality import remainder
from .words import _BYTE, IS_SPACE, Words, _power_tables

SPACE = "▁".encode()
ROUNDS = 2
DISCOUNT = 0.7
#: Weight of the first distribution among the expected counts, in events.
PRIOR = 5_000.0
#: Text of a chunk, in bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 5 << 20
_PACK = "zstd"
#: Bytes of words whose lattices are built at once.
LATTICE_BYTES = 400_000


class Pieces:
    """The vocabulary as byte strings, found by hash: entry k is a piece, the first 256 the bytes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size())
                 if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        plain.sort(key=lambda i: -m.get_score(i))
        texts = [m.id_to_piece(i).encode() for i in plain]
        self.size = 256 + len(texts)
        rank = np.concatenate((np.full(256, 4.0 * len(texts)), np.arange(len(texts)) + 10.0))
        self.first = -np.log(rank)
        self.first -= np.log(np.exp(self.first).sum())
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for k, t in enumerate(texts):
            by_size.setdefault(len(t), []).append((t, 256 + k))
        self.tables = {}
        for n, own in by_size.items():
            h = _hash(np.frombuffer(b"".join(t for t, _ in own), np.uint8), np.arange(len(own)) * n, n)
            order = np.argsort(h)
            may = np.zeros(1 << 18, bool)
            may[(h >> np.uint64(46)).astype(np.int64)] = True
            self.tables[n] = (h[order], np.array([k for _, k in own])[order], may)

    def edges(self, data: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all pieces in the bytes; rest: bytes of the word from each place on."""
        sums = _sums(data)
        _, inverse = _power_tables(len(data) + 1)
        live = np.arange(len(data))
        starts, sizes, pieces = [live], [np.ones(len(live), np.int64)], [data.astype(np.int64)]
        for n in sorted(self.tables):
            live = live[rest[live] >= n]
            if not len(live):
                break
            keys, number, may = self.tables[n]
            h = (sums[live + n] - sums[live]) * inverse[live] * _SPREAD
            own = may[(h >> np.uint64(46)).astype(np.int64)]
            at, h = live[own], h[own]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), n))
            pieces.append(number[k[hit]])
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=out[1:])
    return out


def _hash(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    _, inverse = _power_tables(len(data) + 1)
    s = _sums(data)
    return (s[starts + n] - s[starts]) * inverse[starts] * _SPREAD


class Lattice:
    """Lattices of some words: bytes led by the space sign, one node more than bytes each."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        data = np.frombuffer(b"".join(SPACE + w for w in words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + len(SPACE)
        end = np.cumsum(size)
        rest = np.repeat(end, size) - np.arange(len(data))
        starts, sizes, self.piece = pieces.edges(data, rest)
        word = np.repeat(np.arange(len(words)), size)
        self.a = starts + word[starts]                       # nodes: a word's bytes and its end
        self.b = self.a + sizes
        first = end - size + np.arange(len(words))
        self.origin, self.final = first, end + np.arange(len(words))
        self.n_nodes = len(data) + len(words)
        self.reach = starts - (end - size)[word[starts]] + sizes
        self.left = rest[starts]

    def _pass(self, weight, key, source, target, begin):
        """Log sums along edges in the order of key; all edges of one target share its key."""
        out = np.full(self.n_nodes, -np.inf)
        out[begin] = 0
        total = np.zeros(self.n_nodes)
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        source, target, weight = source[order], target[order], weight[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(key)))) if len(key) else [0]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            t = target[i:j]
            x = out[source[i:j]] + weight[i:j]
            np.maximum.at(out, t, x)
            top = out[t]
            np.add.at(total, t, np.exp(x - top))
            out[t] = top + np.log(total[t])
        return out

    def forward(self, logp: np.ndarray) -> np.ndarray:
        return self._pass(logp[self.piece], self.reach, self.a, self.b, self.origin)

    def likelihood(self, logp: np.ndarray) -> np.ndarray:
        """Natural log probability of each word."""
        return self.forward(logp)[self.final]

    def expected(self, logp: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece, each word counting ``times``."""
        w = logp[self.piece]
        alpha = self.forward(logp)
        beta = self._pass(w, self.left, self.b, self.a, self.final)
        word = np.searchsorted(self.final, self.a)           # the first word end at or after the node
        total = alpha[self.final][word]
        return np.bincount(self.piece, weights=np.exp(alpha[self.a] + w + beta[self.b] - total) * times[word], minlength=size)


_vocabularies: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _vocabularies:
        _vocabularies[path] = Pieces(path)
    return _vocabularies[path]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (chunk, ids, counts, words, times, low, high): times: uses of a word in training texts."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        # numbers of chunks: unique among the tasks whose output is kept
        number_of = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in merged(batches, CHUNK_BYTES):
            learn = column_ids(batch, "learn").to_numpy(zero_copy_only=False)
            for a, b, texts in text_slices(batch, "text", 2 * CHUNK_BYTES, batch.num_rows):
                w = Words(texts, ~IS_SPACE)
                coded = w.strings().dictionary_encode()
                number = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
                times = np.bincount(number[learn[a:b][w.doc]], minlength=len(coded.dictionary))
                # words in falling number of uses: numbers of common words are small and pack well
                order = np.argsort(-np.bincount(number, minlength=len(coded.dictionary)), kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                number = place[number]
                packed = [pa.compress(x.astype("<u2").tobytes(), _PACK, asbytes=True) for x in (number & 0xFFFF, number >> 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([next(number_of)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), column_ids(batch, "id").slice(a, b - a)),
                    pa.array([w.counts.tolist()], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order))),
                    pa.array([times[order].tolist()], pa.list_(pa.int32())),
                    pa.array([packed[0]]), pa.array([packed[1]])],
                    ["chunk", "ids", "counts", "words", "times", "low", "high"])
    learn = F.coalesce(remainder(id_col, 7) != 2, F.lit(True)).alias("learn")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learn).mapInArrow(
        run, f"chunk long, ids array<{kind}>, counts array<int>, words array<string>, times array<int>, low binary, high binary")


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probability of each piece, from counted words (word, c)."""
    spark = prepare(words.sparkSession)
    logp = first = vocabulary(path).first
    known = words.filter("c > 0").select("word")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)            # one number a piece

        def run(batches, sent=sent):
            v = vocabulary(path)
            total = np.zeros(v.size)
            for batch in merged(batches, LATTICE_BYTES):
                own = [x.encode() for x in batch.column(0).to_pylist()]
                total += Lattice(own, v).expected(sent.value, np.ones(len(own)), v.size)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])
        rows = known.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = PRIOR * np.exp(first)
        for r in rows:                                       # at most one row a piece
            n[r["piece"]] += r["n"]
        logp = np.log(n / n.sum())
    return logp


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    table = staged(chunks(docs, id_col, text_col), "chunks")
    pairs = table.select("chunk", F.posexplode(F.arrays_zip("words", "times")).alias("place", "w")).select(
        "chunk", "place", F.col("w.words").alias("word"), F.col("w.times").cast("long").alias("times"))
    counted = staged(pairs.groupBy("word").agg(F.sum("times").alias("c")), "words")
    ends = docs.filter(F.coalesce(remainder(id_col, 7) != 2, F.lit(True))).select(id_col).count()
    size = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens, kinds = size["n"] + ends, size["v"] + (1 if ends else 0)
    sent = spark.sparkContext.broadcast(fit(counted, path, rounds))
    seen_words, free = tokens + 1.0, DISCOUNT * size["v"] + 0.5
    end_score = float(np.log10((ends + 0.5) / seen_words))

    def words(batches):
        v = vocabulary(path)
        for batch in merged(batches, LATTICE_BYTES):
            own = [x.encode() for x in batch.column(0).to_pylist()]
            p = Lattice(own, v).likelihood(sent.value)
            c = batch.column(1).to_numpy()
            p = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 1e-300)), np.log(free) + p) - np.log(seen_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p / np.log(10), pa.float64())], ["word", "c", "p"])

    rated = counted.select("word", "c").mapInArrow(words, "word string, c long, p double")
    values = pairs.select("chunk", "place", "word").join(rated, "word").select(F.col("chunk").alias("of"), "place", "c", "p")
    base_end = float(np.log10((ends + 1) / (tokens + kinds + 1)))
    below = float(np.log10(tokens + kinds + 1))
    known_end = 1 if ends else 0

    def finish(key, left, right):
        row = left.to_pylist()[0]
        n = np.array(row["counts"], np.int64)
        c, p = np.zeros(right.num_rows), np.zeros(right.num_rows)
        place = right.column("place").to_numpy()
        c[place] = right.column("c").to_numpy()
        p[place] = right.column("p").to_numpy()
        raw = [np.frombuffer(pa.decompress(row[x], int(n.sum()) * 2, _PACK), "<u2").astype(np.int64) for x in ("low", "high")]
        number = raw[0] | raw[1] << 16
        doc = np.repeat(np.arange(len(n)), n)
        add = lambda x: np.bincount(doc, weights=x[number], minlength=len(n)) if len(number) else np.zeros(len(n))
        m = len(n)
        return pa.table({
            "id": pa.array(row["ids"], left.schema.field("ids").type.value_type), "n_tokens": pa.array(n + 1),
            "n_known": pa.array(add((c > 0).astype(float)).round().astype(np.int64) + known_end),
            "train_tokens": pa.array(np.full(m, tokens), pa.int64()),
            "base_score": pa.array(add(np.log10(c + 1)) - n * below + base_end), "score": pa.array(add(p) + end_score)})
    # a chunk without any word has no partner on the right: full outer, as cogroup does
    return table.select("chunk", "ids", "counts", "low", "high").groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(
        finish, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(docs, path).select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")
