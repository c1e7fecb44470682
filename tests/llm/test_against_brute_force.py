"""Registered queries over whole small tables against plain Python on the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mailspark.llm import html_text, lattice_lm, licenses, minhash, quality, sentencepiece_bpe
from mailspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(t[c] for c in columns)))


def words(text):
    return WORD.findall((text or "").translate(LOW))


def run(spark, prefix):
    return QUERIES[next(k for k in QUERIES if k.startswith(prefix))](spark, SF).collect()


@pytest.fixture(scope="module")
def docs():
    return rows("documents", "doc_id", "text")


def components(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_embeddings(spark):
    vecs = rows("embeddings", "vec_id", "embedding")
    x = np.array([v for _, v in vecs], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in vecs]
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, "op1_")}
    assert got == {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(1))}


def test_embedding_links_in_blocks(spark, monkeypatch):
    """One crowded cell of near vectors, dealt into many small blocks."""
    from mailspark.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(24) + rng.standard_normal((150, 24)) * 0.3
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert 0 < near.sum() < 0.9 * near.size
    df = spark.createDataFrame([(i, [float(y) for y in v.astype(np.float32)]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.report(df).collect()}
    found, there = sum(got.values()), int(near.sum())
    assert all(got[i] <= n for i, n in enumerate(near.sum(1))) and found >= 0.995 * there


def jp(a, b):
    """Probability Jaccard by its definition."""
    x, y = ({k: v / sum(c.values()) for k, v in c.items()} for c in (a, b))
    both = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in both) for d in x.keys() & y.keys())


def shingle_counts(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6, rng.integers(1, 60))) for _ in range(30)]
    other = [t if rng.random() < 0.2 else t + " " + texts[i - 1] for i, t in enumerate(texts)]
    got = minhash.similarity(pa.array(texts), pa.array(other))
    assert got == pytest.approx([jp(shingle_counts(a), shingle_counts(b)) for a, b in zip(texts, other)])


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 300, 400)]
    for share in (0.02, 0.1):
        two = [f"x{i}" if rng.random() < share else b for i, b in enumerate(base)]
        _, _, doc, s, n = minhash.weighted(pa.array([" ".join(base), " ".join(two)]))
        sig = minhash.signatures(doc, s, n, 2, registers=3000)
        assert (sig[0] == sig[1]).mean() == pytest.approx(jp(shingle_counts(" ".join(base)), shingle_counts(" ".join(two))), abs=0.04)


def test_near_duplicates(spark, docs):
    sets = {i: shingle_counts(t) for i, t in docs}
    have = defaultdict(list)
    for i, c in sets.items():
        for s in c:
            have[s].append(i)
    pairs = {(a, b) for own in have.values() for a in own for b in own if a < b}
    few = [(a, b) for a, b in pairs if 2 * len(sets[a].keys() & sets[b].keys()) > max(len(sets[a]), len(sets[b]))]
    comp = components(sets, [(a, b) for a, b in few if jp(sets[a], sets[b]) >= 0.8])
    assert {r["doc_id"]: r["class_id"] for r in run(spark, "op4_")} == comp and any(a != b for a, b in comp.items())


def test_a_family_whose_members_link_only_here_and_there(spark):
    """Variants of one text, many near its centre and few to each other, against all pairs."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 900, 160)]
    texts = []
    for i in range(160):
        t = list(base)
        for j in rng.choice(len(t), rng.integers(0, 9), replace=False):
            t[j] = f"x{rng.integers(10_000)}"
        texts.append((i, " ".join(t)))
    sets = {i: shingle_counts(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and jp(sets[a], sets[b]) >= 0.8]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.report(df).collect()} == components(sets, links)


def test_passages(spark, docs):
    """Every run of 50 words that an earlier document has lies in a passage, but for a few words; passages agree with their sources."""
    text = {i: words(t) for i, t in docs}
    first, cover = {}, {i: np.zeros(len(w), bool) for i, w in text.items()}
    for i in sorted(text):
        for j in range(len(text[i]) - 49):
            if first.setdefault(tuple(text[i][j:j + 50]), i) != i:
                cover[i][j:j + 50] = True
    got = {i: np.zeros(len(w), bool) for i, w in text.items()}
    for r in run(spark, "op2_"):
        assert r["ref_doc_id"] < r["doc_id"] and r["stop"] - r["start"] >= 50
        a, b = text[r["doc_id"]][r["start"]:r["stop"]], text[r["ref_doc_id"]][r["ref_start"]:r["ref_stop"]]
        assert len(a) == r["stop"] - r["start"] and len(b) == r["ref_stop"] - r["ref_start"]
        assert sum((Counter(a) & Counter(b)).values()) >= r["n_same"] >= 0.8 * max(len(a), len(b))
        got[r["doc_id"]][r["start"]:r["stop"]] = True
    there, missed = sum(c.sum() for c in cover.values()), sum((cover[i] & ~got[i]).sum() for i in cover)
    assert there > 0 and missed <= 0.01 * there
    assert all(got[i].any() for i in cover if cover[i].any())


def test_fuzzy_passages_in_foreign_text(spark):
    from mailspark.llm import substring

    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(80)]
    other = lambda n, k: [f"d{k}x{i}" for i in rng.integers(0, 10_000, n)]
    edited = [w for i, w in enumerate(passage) if i % 26 != 7]
    edited[40] = "changed"
    data = [(1, other(200, 1) + passage + other(90, 1)), (2, other(30, 2) + edited + other(300, 2)), (3, other(500, 3)),
            (4, other(10, 4) + passage[:30] + other(10, 4))]
    got = substring.report(spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["ref_doc_id"]) for r in got] == [(2, 1)]
    assert abs(got[0]["start"] - 30) <= 1 and abs(got[0]["stop"] - 30 - len(edited)) <= 1


def test_recall_of_fuzzy_passages(spark):
    """Passages with words replaced at random, at 80 to 95% agreement, each in foreign text."""
    from mailspark.llm import substring

    rng = np.random.default_rng(11)
    least = {(55, 0.95): 0.95, (55, 0.9): 0.95, (55, 0.8): 0.9, (80, 0.9): 0.97, (80, 0.8): 0.95, (120, 0.8): 0.97}
    data, kind = [], {}
    for n, agree in least:
        for _ in range(60):
            i = 2 * len(kind)
            passage = [f"p{i}x{k}" for k in range(n)]
            edited = list(passage)
            for k in rng.choice(n, round(n * (1 - agree)), replace=False):
                edited[k] = f"q{i}x{k}"
            data += [(i, " ".join([f"a{i}x{k}" for k in range(70)] + passage)), (i + 1, " ".join(edited + [f"b{i}x{k}" for k in range(70)]))]
            kind[i + 1] = n, agree
    got = substring.report(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(r["ref_doc_id"] == r["doc_id"] - 1 and r["n_same"] >= 0.8 * (r["stop"] - r["start"]) for r in got)
    hit = Counter(kind[i] for i in {r["doc_id"] for r in got})
    assert not {k: hit[k] for k in least if hit[k] < 60 * least[k]}


def test_a_passage_whose_parts_occur_elsewhere(spark):
    """Exact passages of 50 words, of lines that earlier documents have one at a time, are found where they occur whole."""
    from mailspark.llm import substring

    data = []
    for t in range(0, 100, 10):
        line = [[f"l{t}x{k}x{i}" for i in range(n)] for k, n in enumerate((17, 16, 17))]
        foreign = lambda k: [f"d{t}x{k}x{i}" for i in range(60)]
        some = [line[0] + line[1], line[1] + line[2], line[0] + line[1] + line[2][:-1], line[0][1:] + line[1] + line[2]]
        data += [(t + k, foreign(k) + part + foreign(k + 20)) for k, part in enumerate([*some, sum(line, []), sum(line, [])])]
    got = substring.report(spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["stop"], r["ref_doc_id"]) for r in got} >= {(t + 5, 60, 110, t + 4) for t in range(0, 100, 10)}


def test_each_copy_of_a_passage(spark):
    """A passage three times in a later document, and twice in a document alone: all copies but the first are found and cut."""
    from mailspark.llm import substring

    foreign = lambda k: [f"d{k}x{i}" for i in range(60)]
    p, q, r = ([f"{c}{i}" for i in range(60)] for c in "pqr")
    data = [(1, foreign(1) + p), (2, p + foreign(2) + p + foreign(3) + p), (3, foreign(4) + q + foreign(5) + q + foreign(6)),
            (4, r + r), (5, ["la"] * 49 + foreign(7)), (6, foreign(8) + [f"s{i}" for i in range(20)] * 8)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    got = [(x["id"], y["start"], y["stop"], y["ref"]) for x in substring.passages(df).collect() for y in x["passages"]]
    assert {(x["doc_id"], x["start"], x["stop"], x["ref_doc_id"]) for x in substring.report(df).collect()} == {g for g in got if g[0] == 2}
    assert sorted(g for g in got if g[0] < 6) == [(2, 0, 60, 1), (2, 120, 180, 1), (2, 240, 300, 1), (3, 180, 240, 3), (4, 60, 120, 4)]
    left = {x["doc_id"]: words(x["text"]) for x in substring.deduplicated(df).collect()}
    assert left[1] == data[0][1] and left[2] == foreign(2) + foreign(3) and left[3] == foreign(4) + q + foreign(5) + foreign(6)
    assert left[4] == r and left[5] == data[4][1] and left[6] == foreign(8) + [f"s{i}" for i in range(20)] * 3


def test_a_passage_next_to_other_shared_words(spark):
    """Two stretches shared with one document, far apart in foreign words: the long one is found, and only it."""
    from mailspark.llm import substring

    rng = np.random.default_rng(9)
    other = lambda n, k: [f"d{k}x{i}" for i in rng.integers(0, 10_000, n)]
    passage, line = [f"p{i}" for i in range(70)], [f"l{i}" for i in range(30)]
    data = [(1, other(50, 1) + passage + other(40, 2) + line + other(9, 3)), (2, other(20, 4) + passage + other(35, 5) + line + other(60, 6))]
    got = substring.report(spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["stop"], r["n_same"]) for r in got] == [(2, 20, 90, 70)]


def test_licenses(spark, docs):
    def sh(w):
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    names = defaultdict(list)
    for n, t in licenses.NOTICES:
        names[n].append((sh(words(t)), len(words(t))))
    want = {}
    for i, t in docs:
        w = words(t)
        found = set()
        for n, sets in names.items():
            for s, size in sets:
                wide = 1 << (size - 1).bit_length()
                for a in range(0, max(1, len(w)), wide):
                    if w and len(s & sh(w[a:a + 2 * wide])) >= 0.8 * len(s):
                        found.add(n)
        want[i] = ",".join(sorted(found))
    got = {r["doc_id"]: r["licenses"] for r in run(spark, "op7_")}
    assert got == want and any(want.values())


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for i, text in sorted(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op6_")} == want


def test_quality_on_held_out_labels(spark):
    label = dict(rows("labels", "doc_id", "quality"))
    got = {r["doc_id"]: r for r in run(spark, "op8_")}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and i in label]
    assert sum(got[i]["predicted"] == label[i] for i in held) >= 0.85 * len(held)


def test_quality_learns_nothing_from_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(one.value, two.value) and one.offset == two.offset


def test_pieces(spark, docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in docs:
        ids = m.encode(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op9_")} == want


def test_pieces_of_a_word_of_a_million_letters():
    import random
    import time

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceModel(path)
    rng = random.Random(3)
    t = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    start = time.time()
    ids = own.encode(t)
    assert time.time() - start < 60 and max(map(len, own.known), default=0) <= sentencepiece_bpe.KEPT
    assert ids == lib.encode(t)


def test_pieces_on_odd_texts():
    import random

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.PieceModel(path)
    rng = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "     ", "\n", "\t", "é", "漢字", "😀", "▁", "<s>", "'s", "0", "ing", "́", "‍", "है", "\x00", "ß", ".", "!!", "===="]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        ids = own.encode(t)
        assert ids == lib.encode(t) and own.decode(ids) == lib.decode(ids)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == lib.decode(ids)


def test_language_model(spark, docs):
    split = re.compile("[^\x20\x09-\x0d]+")
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs}
    toks = {i: [*split.findall((t or "").translate(LOW)), "\n"] for i, t in docs}
    c = Counter(w for i, t in toks.items() if learn[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in run(spark, "op10_")}
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    # a word has about ten signs: far better than the pieces' first weights, and not above certainty
    assert -8 < sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) < 0


def test_lattice_sums_all_segmentations():
    v = lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = sorted((i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))), key=lambda i: -m.get_score(i))
    place = {m.id_to_piece(i).encode(): 256 + k for k, i in enumerate(plain)}

    def brute(word):
        b = lattice_lm.SPACE + word
        ways = [1.0] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            for i in range(j):
                if b[i:j] in place:
                    ways[j] += ways[i] * math.exp(v.first[place[b[i:j]]])
                if j - i == 1:
                    ways[j] += ways[i] * math.exp(v.first[b[i]])
        return math.log(ways[-1])
    own = [b"the", b"", b"therethion.", "éaux".encode(), "漢😀".encode(), b"a" * 40, b"\x00x"]
    lattice = lattice_lm.Lattice(own, v)
    assert lattice.likelihood(v.first) == pytest.approx([brute(w) for w in own])
    # expected uses are the derivative of the log likelihood by the log weights
    times = np.arange(1.0, len(own) + 1)
    uses = lattice.expected(v.first, times, v.size)
    for k in np.argsort(-uses)[:4]:
        more = v.first.copy()
        more[k] += 1e-6
        assert uses[k] == pytest.approx(((lattice.likelihood(more) - lattice.likelihood(v.first)) * times).sum() / 1e-6, rel=1e-4)


def test_pages_without_learnt_kinds():
    nothing = html_text.Weights(np.zeros(html_text.KINDS), np.zeros(html_text.KINDS))
    page = html_text.Page("<div class=menu>a b</div><p>one two three</p><form>x y</form>")
    assert page.text(nothing) == "one two three"


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in after.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == table.columns
        before = after
    label = dict(rows("labels", "doc_id", "quality"))
    good = [i for i in label if label[i] == 1]
    assert sum(i in seen["quality_filter"] for i in good) >= 0.97 * len(good)
    sets = {i: shingle_counts(r["text"]) for i, r in seen["quality_filter"].items()}
    kept = list(seen["near_dedup"])
    assert all(jp(sets[a], sets[b]) < 0.8 for a in kept for b in kept
               if a < b and 2 * len(sets[a].keys() & sets[b].keys()) > max(len(sets[a]), len(sets[b])))
    assert seen["passage_dedup"].keys() == seen["near_dedup"].keys()
    runs = Counter(s for r in seen["passage_dedup"].values() for s in {tuple(words(r["text"])[i:i + 60]) for i in range(len(words(r["text"])) - 59)})
    assert not [s for s, n in runs.items() if n > 1]
    tests = {tuple(words(t)[i:i + 10]) for _, t in rows("benchmark", "item_id", "text") for i in range(max(1, len(words(t)) - 9))}
    for r in seen["decontamination"].values():
        w = words(r["text"])
        assert not any(tuple(w[i:i + 10]) in tests for i in range(len(w)))
    assert seen["tokens"].keys() == seen["decontamination"].keys()
    assert all(r["decoded_sha256"] == hashlib.sha256((seen["decontamination"][i]["text"] or "").encode()).hexdigest() for i, r in seen["tokens"].items())
