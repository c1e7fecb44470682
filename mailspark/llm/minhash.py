"""Near-duplicate documents by ProbMinHash.

A document is a weighted set: its shingles of five words, each weighing its
share of the document's shingles.  Every shingle sends arrivals of a Poisson
process whose rate is its weight to random registers; a register keeps the
earliest.  A shingle stops as soon as its next arrival is later than the
latest register, so most send one arrival.  Two documents share a register
with probability equal to their probability Jaccard similarity

    J_P = sum over common d of 1 / sum over d' of max(x[d'] / x[d], y[d'] / y[d]).

Registers (cut to one byte) are banded; documents that share a band are
candidates; candidates are verified by exact J_P >= 0.8.

Documents with the same words in the same order are one class text and enter
once.  Within a band's bucket all are first verified against its most central
document, the one with most company in all its buckets.  What then still lies
in another component is compared with the bucket block by block on the
registers alone, in numpy; only pairs of different components whose registers
agree often enough (4.2 standard deviations below 0.8) leave the task, once
for each pair, and are verified in turn.  So a bucket is never expanded into
its pairs, and no link between components is lost.

Cases: null and empty texts, or texts without words, are classes of their own;
texts of one to four words are one shingle; rows that repeat a doc_id give one row
(should their texts differ, a link of any of them counts); rows with a null id are not documents (``deduplicated``
judges both row by row); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids, mix, near, prepare, staged, text_slices
from .components import components
from .words import Words, shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6                                 # a pair at 0.8 shares some band with probability 0.99994
REGISTERS = 512                          # all serve the estimate, the first BANDS * ROWS are banded
#: Registers that agree in a pair worth verifying: 0.8 less 4.2 standard deviations.
AGREE = int(REGISTERS * (SIMILARITY - 4.2 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))
#: Documents of a bucket that one task compares at once.
BLOCK = 1024
_LOW48 = np.uint64((1 << 48) - 1)


def weighted(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and (doc, shingle, count) of the distinct shingles of each text."""
    w = Words(texts)
    h = w.hashes()
    doc, s = shingles(w, h, SHINGLE)
    key, n = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (s & _LOW48), return_counts=True)
    return w, h, (key >> np.uint64(48)).astype(np.int64), key & _LOW48, n.astype(np.float64)


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int,
               registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_docs x registers) of weighted shingles."""
    total = np.bincount(doc, weights=count, minlength=n_docs)
    rate = count / total[doc]
    when = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    live = np.arange(len(doc))
    clock = np.zeros(len(doc))
    turn = 0
    while len(live):
        x = mix(shingle[live] + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        y = mix(x + np.uint64(0x632BE59BD9B4E019))
        clock = clock - np.log((x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / rate[live]
        slot = doc[live] * registers + (y % np.uint64(registers)).astype(np.int64)
        np.minimum.at(when, slot, clock)
        won = when[slot] == clock
        who[slot[won]] = shingle[live][won]
        late = when.reshape(n_docs, registers).max(axis=1)
        go = clock < late[doc[live]]
        live, clock = live[go], clock[go]
        turn += 1
    return who.reshape(n_docs, registers)


def cut(registers: np.ndarray) -> np.ndarray:
    """One byte of each register."""
    return (mix(registers) >> np.uint64(56)).astype(np.uint8)


def bands(registers: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket of each band of cut registers; a bucket's number modulo n_bands is its band."""
    out = np.zeros((len(registers), n_bands), np.uint64)
    for b in range(n_bands):
        x = np.full(len(registers), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(0x100000001B3) + registers[:, b * rows + r])
        x = (x >> np.uint64(1)) // np.uint64(n_bands) * np.uint64(n_bands) + np.uint64(b)
        out[:, b] = np.where(x < np.uint64(1 << 63), x, x - np.uint64(n_bands))
    return out


def _sketcher(id_col, text_col):
    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                w, h, doc, s, n = weighted(texts)
                sig = cut(signatures(doc, s, n, len(texts)))
                buckets = bands(sig)
                some = w.counts > 0
                # order-sensitive 128-bit fingerprint of the word sequence
                place = (np.arange(len(h)) - w.first[:-1][w.doc]).astype(np.uint64)
                fp = []
                for salt in (0x51ED270B, 0xC2B2AE35):
                    v = mix(h ^ mix(place * np.uint64(2) + np.uint64(salt)))
                    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
                    fp.append(pa.array((c[w.first[1:]] - c[w.first[:-1]]).view(np.int64)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)),
                    pa.array(buckets[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids(batch, id_col).slice(a, b - a), pa.array(w.counts, pa.int64()), *fp, lists,
                     pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["id", "n_words", "fp1", "fp2", "bands", "sig"])
    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, fp1, fp2, bands, sig) of each document row with an id."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(
        _sketcher(id_col, text_col), f"id {kind}, n_words long, fp1 long, fp2 long, bands array<long>, sig binary")


def probability_jaccard(xk: np.ndarray, xn: np.ndarray, yk: np.ndarray, yn: np.ndarray) -> float:
    """J_P of two weighted sets given as sorted keys and counts."""
    if not len(xk) or not len(yk):
        return 0.0
    common, i, j = np.intersect1d(xk, yk, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = xn / xn.sum(), yn / yn.sum()
    # u = y/x of a common shingle: others count by x if their ratio is u at most, else by y/u
    u, at = np.unique(y[j] / x[i], return_inverse=True)
    by_x = np.cumsum(np.bincount(at, weights=x[i], minlength=len(u)))
    y_all = np.bincount(at, weights=y[j], minlength=len(u))
    above = y.sum() - y[j].sum() + y_all.sum() - np.cumsum(y_all)
    # shingles of x alone have ratio 0, those of y alone an infinite one
    s = by_x + (x.sum() - x[i].sum()) + above / u
    return float((x[i] / s[at]).sum())


def similarity(texts: pa.Array, others: pa.Array) -> np.ndarray:
    """J_P of texts[i] and others[i]."""
    sides = []
    for t in (texts, others):
        _, _, doc, s, n = weighted(t)
        sides.append((np.searchsorted(doc, np.arange(len(t) + 1)), s, n))
    (xf, xs, xn), (yf, ys, yn) = sides
    return np.array([probability_jaccard(xs[xf[i]:xf[i + 1]], xn[xf[i]:xf[i + 1]], ys[yf[i]:yf[i + 1]], yn[yf[i]:yf[i + 1]])
                     for i in range(len(texts))], np.float64)


def _verifier(batches):
    for batch in batches:
        other = pc.fill_null(ids(batch, "other"), "")
        for a, b, texts in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [ids(batch, "a").slice(a, b - a), ids(batch, "b").slice(a, b - a),
                 pa.array(similarity(texts, other.slice(a, b - a)))], ["a", "b", "jp"])


def verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(a, b, jp) of candidate pairs (a, b), by the texts (id, text)."""
    kind = dict(pairs.dtypes)["a"]
    one = texts.select(F.col("id").alias("a"), "text")
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
    return staged(pairs.join(two, "b").join(one, "a").select("a", "b", "text", "other")
                  .mapInArrow(_verifier, f"a {kind}, b {kind}, jp double"), name)


def agreeing(rest_ids, rest_of, rest_sig, ids, of, sig, band: int) -> list[tuple[int, int]]:
    """Index pairs (rest, member) of different components that agree in AGREE registers and share no band before this."""
    out = []
    for a in range(0, len(rest_ids), 32):
        same = rest_sig[a:a + 32, None, :] == sig[None, :, :]
        i, j = np.nonzero((same.sum(axis=2, dtype=np.uint16) >= AGREE) & (rest_of[a:a + 32, None] != of[None, :]))
        if len(i):
            shared = same[i, j, :BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2)
            own = shared.argmax(axis=1) == band
            out += zip((i[own] + a).tolist(), j[own].tolist())
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of one bucket block: its rest rows against its member rows."""
    ids_, sig = table.column("id").to_pylist(), table.column("sig").to_pylist()
    _, of = np.unique(np.array(table.column("component").to_pylist()), return_inverse=True)
    rest = table.column("rest").to_numpy().astype(bool)
    sig = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, REGISTERS)
    r, m = np.flatnonzero(rest), np.flatnonzero(~rest)
    pairs = agreeing(r, of[r], sig[r], m, of[m], sig[m], table.column("bucket")[0].as_py() % BANDS)
    # two rest rows meet twice, each as the other's member: once is enough
    twice = table.column("twice").to_numpy().astype(bool)
    pairs = [(i, j) for i, j in pairs if not twice[m[j]] or ids_[r[i]] > ids_[m[j]]]
    return pa.table({"a": pa.array([ids_[r[i]] for i, _ in pairs], table.schema.field("id").type),
                     "b": pa.array([ids_[m[j]] for _, j in pairs], table.schema.field("id").type)})


def _across(members: DataFrame, comp: DataFrame, table: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components within a bucket."""
    kind = dict(members.dtypes)["id"]
    where = members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = where.filter("id = pivot").select("bucket", F.col("component").alias("head"))
    where = staged(where.join(heads, "bucket").withColumn("rest", F.col("component") != F.col("head")), "placed")
    mixed = where.filter("rest").groupBy("bucket").agg(F.count("*").alias("n_rest"))
    here = where.join(mixed, "bucket")
    sigs = table.join(here.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("sig").alias("sig"))
    here = here.join(sigs, "id").select(
        "bucket", "id", "component", "sig", "rest",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_rest") / BLOCK).cast("int").alias("rest_blocks"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "id", "component", "sig"]
    left = here.filter("rest").select(*columns, F.lit(1).alias("rest"), F.lit(1).alias("twice"), own("rest_blocks").alias("i"),
                                      every("blocks").alias("j"))
    right = here.select(*columns, F.lit(0).alias("rest"), F.col("rest").cast("int").alias("twice"), own("blocks").alias("j"),
                        every("rest_blocks").alias("i"))
    pairs = left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(_compare, f"a {kind}, b {kind}")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) of every document: its class is the smallest id that links reach."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = staged(sketches(docs, "id"), "sketches")
    one = (table.groupBy("id").agg(F.min(F.struct("fp1", "fp2", "n_words")).alias("f"))
           .select("id", "f.fp1", "f.fp2", "f.n_words"))
    # documents of one word sequence: the smallest id stands for them
    rep = staged(one.join(one.filter("n_words > 0").groupBy("fp1", "fp2", "n_words").agg(F.min("id").alias("rep")),
                          ["fp1", "fp2", "n_words"], "left")
                 .select("id", F.coalesce("rep", "id").alias("rep"), (F.col("n_words") > 0).alias("some")), "texts")
    alone = rep.filter("some and id = rep").select("id")
    spread = table.join(alone, "id", "left_semi").select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(spread.join(sizes, "bucket"), "buckets")
    central = members.groupBy("id").agg(F.sum("n").alias("company"))
    pivots = members.join(central, "id").groupBy("bucket").agg(F.max(F.struct("company", "id"))["id"].alias("pivot"))
    members = staged(members.join(pivots, "bucket"), "pivots")
    texts = docs.filter(F.col("id").isNotNull())
    within = members.select("id").distinct()
    texts = staged(near(texts, "id", within).join(within, "id", "left_semi"), "bucket-texts")
    first = verified(members.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(),
                     texts, "links")
    linked = first.filter(F.col("jp") >= SIMILARITY).select("a", "b")
    comp = staged(components(linked, "a", "b", "near"), "near-components")
    second = verified(_across(members, comp, table), texts, "cross-links").filter(F.col("jp") >= SIMILARITY).select("a", "b")
    if not second.isEmpty():
        # components join: link their ids
        joined = (second.join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
                  .join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                  .select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).distinct())
        top = components(joined, "ca", "cb", "joined")
        loose = second.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti")
        comp = comp.unionByName(loose.select("id", F.col("id").alias("component")))
        comp = staged(comp.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
                      .select("id", F.coalesce("top", "component").alias("component")), "all-components")
    return (rep.join(comp.select(F.col("id").alias("rep"), F.col("component").alias("of")), "rep", "left")
            .select("id", F.coalesce("of", "rep").alias("class_id"))
            .withColumn("kept", F.col("id") == F.col("class_id")))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class.

    Where ids are null or repeat, a document is an id and a text: of rows equal in both one stays, and rows that
    share only the id are judged by their own texts.
    """
    unsure = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if unsure.isEmpty():
        drop = classes(docs).filter(~F.col("kept")).select(F.col("id").alias("_llm_copy_id"))
        return docs.join(drop, docs["doc_id"] == drop["_llm_copy_id"], "left_anti")
    # ids of one width, in their order; two hashes of the text
    own = F.col("doc_id").cast("string")
    key = F.concat_ws(":", F.lpad(own, F.greatest(F.length(own), F.lit(20)), F.lit("0")), F.hex(F.xxhash64("text")), F.hex(F.hash("text")))
    rows = staged(docs.withColumn("_llm_key", key).dropDuplicates(["_llm_key"]), "documents")
    drop = classes(rows, "_llm_key").filter(~F.col("kept")).select(F.col("id").alias("_llm_copy"))
    return rows.join(drop, F.col("_llm_key") == F.col("_llm_copy"), "left_anti").drop("_llm_key")
