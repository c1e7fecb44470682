"""Every operator and stage on nulls, empty and odd texts, repeated rows, empty tables and clashing extra columns."""

import pytest
import public_tokenizers

from mailspark.llm import (decontaminate, embed_dedup, html_text, lattice_lm, licenses, minhash, quality, sentencepiece_bpe, substring,
                           token_files)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, spans string, rep long"
LONG = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, None, "a"), (3, None, "en", None), (4, "", "en", "a"), (5, "  \n ", "en", "a"),
    (6, "one two", "en", "a"), (7, "one two", "en", "a"), (8, "é漢😀 " + "x" * 5000, "fr", "b"), (9, LONG + " tail end", "en", "a"),
    (None, LONG, "en", "a"), (10, "Same text twice here now", "en", "a"), (10, "Same text twice here now", "en", "a"),
    (11, "!!! ... ,,,", "en", "a"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), 77, 0.5, "x", 5) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def full(spark):
    return docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, n_words long")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_near_duplicates(spark, full, empty):
    got = by_id(minhash.report(full))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert {k: r["class_id"] for k, r in got.items()} == {1: 1, 2: 1, 9: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 10: 10, 11: 11}
    assert [k for k, r in got.items() if not r["kept"]] and all(r["kept"] == (k == r["class_id"]) for k, r in got.items())
    left = minhash.deduplicated(full)
    assert left.columns == full.columns
    # the row without an id is a copy of the first; equal rows are one
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6, 8, 10, 11] or \
        sorted(str(r["doc_id"]) for r in left.collect()) == ["10", "11", "3", "4", "5", "6", "8", "None"]
    assert minhash.report(empty).collect() == [] and minhash.deduplicated(empty).collect() == []


def test_repeated_and_null_ids_are_judged_row_by_row(spark):
    """Each filtering stage decides by a row's own text: no clean row goes with another's id, no exact copy stays."""
    other = " ".join(f"other{i}" for i in range(120))
    bad = "tail " + " ".join(f"test{i}" for i in range(12))
    d = docs(spark, [(1, LONG, "en", "a"), (2, LONG, "en", "a"), (2, other, "en", "a"), (2, other, "en", "a"), (None, other + " end", "en", "a"),
                     (None, bad, "en", "a"), (None, None, "en", "a"), (3, bad, "en", "a"), (3, "clean text", "en", "a")])
    left = minhash.deduplicated(d)
    assert left.columns == d.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect())
    assert len([g for g in got if g[1] == LONG]) == len([g for g in got if g[1].startswith("other")]) == 1
    assert len([g for g in got if g[1] == bad]) == 1 and ("3", "clean text") in got and ("None", "") in got and len(got) == 5
    b = bench(spark, [(1, " ".join(f"test{i}" for i in range(12)), 0, 0)])
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and sorted(r["text"] or "" for r in clean.collect()) == sorted(
        ["", LONG, LONG, other, other, other + " end", "clean text"])


def test_decontamination_in_blocks_drops_the_same_rows(spark, full, monkeypatch):
    b = bench(spark, [(k, t, 0, 0) for k, t in ((1, LONG), (2, "one two"), (3, "no such words"), (4, "x" * 400))])
    one = sorted(str(r) for r in decontaminate.clean(full, b).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(str(r) for r in decontaminate.clean(full, b).collect()) == one and 0 < len(one) < len(ROWS)


def test_wide_gaps_are_aligned_in_full():
    import numpy as np

    a = np.arange(600, dtype=np.uint32) + 1
    b = np.insert(a, 300, 9999)
    assert substring.matches(a, b) == substring.matches(b, a) == 600
    assert substring.matches(a[:490], a[:490][::-1].copy()) == 1
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint32) for _ in "ab")
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert len(a) == len(b) and (a == b).sum() >= len(a) - 2 or substring.matches(a, b) == row[-1][-1]


def test_a_chain_is_extended_past_the_words_sent_with_it(spark):
    """A passage of 4,000 words of which only the first seed leads to its source; and one whose seed is its last."""
    import numpy as np
    import pyarrow as pa

    number = np.arange(1, 6001, dtype=np.uint32)
    xs = np.array([1000], "<i4")
    row = lambda lo, hi, n: {"ref": 1, "xs": xs.tobytes(), "ys": xs.tobytes(), "shift": lo, "more": hi < n, "words": number[lo:hi].tobytes()}
    got, unsure = substring.found(number[:5000], [row(952, 1053, 6000)])
    assert got == [] and len(unsure) == 1
    got, unsure = substring.found(number[:5000], [row(0, 6000, 6000)])
    assert unsure == [] and (got[0]["start"], got[0]["stop"], got[0]["n_same"]) == (0, 5000, 5000)
    # the same through Spark: documents 1 and 2 have the seeds of document 4's passage but for its first
    p = [f"p{i}" for i in range(200)]
    seeds = [x for _, _, x in zip(*substring.seeds(pa.array([" ".join(p)])))]
    rows = [(1, " ".join(f"f{i} " + " ".join(p[x:x + 5]) for i, x in enumerate(seeds[1:]))), (2, " ".join(p)), (3, " ".join(["z", *p, "y"]))]
    got = substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (3, 1, 201, 2, 200) in {(r["doc_id"], r["start"], r["stop"], r["ref_doc_id"], r["n_same"]) for r in got}


def test_texts_under_one_id_are_cut_by_their_own_passages(spark):
    shared, clean = " ".join(f"s{i}" for i in range(60)), " ".join(f"c{i}" for i in range(200))
    rows = [(1, "head " + shared, "en", "a"), (2, "one " + shared + " two", "en", "a"), (2, clean, "en", "a")]
    left = sorted(r["text"] for r in substring.deduplicated(docs(spark, rows)).collect())
    assert left == sorted(["head " + shared, "one two", clean])


def test_passages(spark, full, empty):
    got = substring.report(full).collect()
    assert {(r["doc_id"], r["start"], r["stop"], r["ref_doc_id"]) for r in got} == {(2, 0, 300, 1), (9, 0, 300, 1)}
    left = substring.deduplicated(full)
    assert left.columns == full.columns and left.count() == len(ROWS)
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert text[1][0] == LONG and text[2] == ("", 0) and text[9] == ("tail end", 8) and text[3][0] is None and text[None][0] == LONG
    assert substring.report(empty).collect() == [] and substring.deduplicated(empty).collect() == []


def test_decontamination(spark, full, empty):
    b = bench(spark, [(1, " ".join(f"Word{i}," for i in range(40, 60)), 0, 0), (2, "one... TWO", 0, 0), (3, None, 0, 0), (4, "", 0, 0),
                      (None, "x", 0, 0), (5, "é漢😀", 0, 0)])
    got = by_id(decontaminate.report(full, b).filter("doc_id is not null"))
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (300, 20, 1)
    assert (got[6]["n_hit"], got[6]["n_items"], got[6]["contaminated"]) == (2, 1, True)
    assert got[6]["items_sha256"] == decontaminate.items_digest(["2"])
    assert got[8]["n_hit"] == 1 and got[8]["items_sha256"] == decontaminate.items_digest(["5"])
    assert (got[3]["n_words"], got[3]["contaminated"], got[3]["items_sha256"]) == (0, False, decontaminate.items_digest([]))
    assert decontaminate.report(full, b).count() == len(ROWS)
    left = decontaminate.clean(full, b)
    assert left.columns == full.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 10, 10, 11]
    none = bench(spark, [])
    assert by_id(decontaminate.report(full, none))[1]["contaminated"] is False
    assert decontaminate.clean(full, none).count() == len(ROWS)
    assert decontaminate.report(empty, b).collect() == [] and decontaminate.report(empty, none).collect() == []


def test_decontamination_by_an_item_without_id(spark, full):
    b = bench(spark, [(None, "one two", 0, 0), (2, "words that no document has", 0, 0)])
    got = by_id(decontaminate.report(full, b).filter("doc_id is not null"))
    assert (got[6]["n_hit"], got[6]["n_items"], got[6]["contaminated"]) == (2, 0, True)
    assert got[6]["items_sha256"] == decontaminate.items_digest([]) and not got[1]["contaminated"]
    assert {6, 7}.isdisjoint(r["doc_id"] for r in decontaminate.clean(full, b).collect())


def test_decontamination_in_blocks_answers_each_row(spark, full, monkeypatch):
    """Repeated and null ids, with equal and with different texts, a row each whatever the benchmark's size."""
    more = docs(spark, [(None, "one two", "en", "a"), (None, None, "en", "a"), (7, LONG, "en", "a"), (7, LONG, "en", "a"), (7, None, "en", "a")])
    both = full.unionByName(more)
    b = bench(spark, [(k, t, 0, 0) for k, t in ((1, LONG), (2, "one two"), (3, "Same text twice here now"), (4, "x" * 400))])
    key = lambda r: tuple(map(str, r))
    one = sorted(decontaminate.report(both, b).collect(), key=key)
    assert len(one) == len(ROWS) + 5 and sum(r["doc_id"] is None for r in one) == 3
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(decontaminate.report(both, b).collect(), key=key) == one


def test_decontamination_in_blocks_is_the_same(spark, full, monkeypatch):
    b = bench(spark, [(i, " ".join(f"word{j}" for j in range(i * 7, i * 7 + 15)), 0, 0) for i in range(20)])
    one = {r["doc_id"]: r for r in decontaminate.report(full.filter("doc_id < 10"), b).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {r["doc_id"]: r for r in decontaminate.report(full.filter("doc_id < 10"), b).collect()} == one
    assert one[1]["n_items"] == 20


def test_token_files(spark, full, empty):
    got = token_files.report(full, WORDS).collect()
    assert len(got) == len(ROWS)
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert token_files.report(empty, WORDS).collect() == []


def test_quality(spark, full, empty):
    lab = labels(spark, [(i, i % 2, 0, "no input") for i in range(12)] + [(3, 0, 0, ""), (None, 1, 0, ""), (4, None, 0, "")])
    got = quality.report(full, lab).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    left = quality.accepted(full, lab)
    assert left.columns == full.columns
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r["doc_id"], r["score"]) for r in got if r["predicted"]], key=key) == sorted(
        [(r["doc_id"], s["score"]) for r, s in ((r, next(s for s in got if s["doc_id"] == r["doc_id"])) for r in left.collect())], key=key)
    none = labels(spark, [])
    assert {round(r["score"], 6) for r in quality.report(full, none).collect()} == {0.5}
    ones = labels(spark, [(i, 1, 0, "") for i in range(12)])
    assert {r["predicted"] for r in quality.report(full, ones).collect()} == {1}
    assert quality.report(empty, lab).collect() == [] and quality.accepted(empty, lab).collect() == []


def test_pieces(spark, full, empty):
    got = sentencepiece_bpe.report(full, PIECES).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0}
    back = by_id(sentencepiece_bpe.decode(sentencepiece_bpe.encode(full, PIECES), PIECES), "id")
    assert back[8]["text"] == ROWS[7][1] and back[3]["text"] == "" and back[5]["text"] == "  \n "
    assert sentencepiece_bpe.report(empty, PIECES).collect() == []


def test_language_model(spark, full, empty):
    got = lattice_lm.report(full, PIECES).collect()
    assert len(got) == len(ROWS)
    rows = {r["doc_id"]: r for r in got}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == rows[5]["n_tokens"] == 1 and rows[1]["n_tokens"] == 301
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["train_tokens"] == got[0]["train_tokens"] for r in got)
    assert rows[3]["score"] == rows[4]["score"] > rows[6]["score"]
    assert lattice_lm.report(empty, PIECES).collect() == []


def test_licenses(spark, full, empty):
    extra = docs(spark, [(1, "Intro. Licensed under CC BY-NC 4.0. End " + LONG, "en", "a"), (2, "x " * 40 + licenses.NOTICES[5][1], "en", "a"),
                         (3, licenses.NOTICES[4][1].replace("terms", "rules"), "en", "a")])
    got = by_id(licenses.report(extra))
    assert got[1]["licenses"] == "CC-BY-NC-4.0" and got[2]["licenses"] == "MIT" and got[3]["n_licenses"] == 0
    assert licenses.report(full).count() == len(ROWS) and {r["n_licenses"] for r in licenses.report(full).collect()} == {0}
    assert licenses.report(empty).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, kind int"
    rows = [(1, "u", "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head &amp; line</h1>"
                     "<p>First   <b>bold</b>\n text.<p>Second &lt;one&gt;</p><div class='comments'>Nice!</div></article><footer>Foot</footer></body>", "t", 1),
            (2, None, None, None, None), (3, "u", "", None, None), (None, "u", "<p>x", None, None), (4, "u", "just text", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == "Head & line\nFirst bold text.\nSecond <one>" and got[1]["n_chars"] == 41
    assert got[2]["text"] == got[3]["text"] == "" and got[None]["text"] == "x" and got[4]["text"] == "just text"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, rep long, times string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.2, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, []),
            (8, [1.0, None, 0.0]), (9, [nan, 1.0, 0.0]), (10, [inf, 1.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]),
            (4, [0.0, 1.0, 0.0])]
    got = by_id(embed_dedup.report(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)), "vec_id")
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == {
        1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (1, 11), 12: (1, 11)}
    assert embed_dedup.report(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_on_an_empty_corpus(spark, empty, tmp_path):
    import corpus_pipeline

    labels(spark, [(1, 1, 0, "")]).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = empty
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
    assert d.collect() == []


def test_many_extensions_at_once_are_those_made_one_by_one():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b, at = [], [], []
    for _ in range(400):
        x = rng.integers(0, rng.integers(2, 40), rng.integers(0, 60)).astype(np.uint32)
        y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 3))) if len(x) else x
        y = np.concatenate((y[:rng.integers(0, 49)], rng.integers(0, 9, rng.integers(0, 5)).astype(np.uint32)))[:48]
        at.append((sum(map(len, a)), sum(map(len, b)), len(x), len(y)))
        a.append(x)
        b.append(y)
    p, q, la, lb = np.array(at).T
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    got = [tuple(int(v) for v in r) for r in zip(*substring.extensions(flat_a, flat_b, p, q, la, lb, 1))]
    assert got == [tuple(map(int, substring.extension(x, y))) for x, y in zip(a, b)]
    got = [tuple(int(v) for v in r) for r in zip(*substring.extensions(flat_a, flat_b, p + la - 1, q + lb - 1, la, lb, -1))]
    assert got == [tuple(map(int, substring.extension(x[::-1], y[::-1]))) for x, y in zip(a, b)]


def test_words_around_the_chains_of_two_documents_are_sent_once():
    """A line that a document repeats 300 times: as many chains with its first place, but its source's words are sent once."""
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(400))
    some = lambda v: np.asarray(v, "<i4").tobytes()
    kind = pa.list_(pa.struct([("id", pa.int64()), ("ns", pa.binary()), ("xs", pa.binary()), ("ys", pa.binary())]))
    chained = [{"id": 2, "ns": some([1] * 300), "xs": some(range(0, 3000, 10)), "ys": some([100, 101, 300] * 100)}]
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text]), pa.array([chained], kind)], ["ref", "text", "chains"])
    rows = pa.Table.from_batches(substring._cutter(48)([batch])).to_pylist()
    assert len(rows) == 1 and np.frombuffer(rows[0]["froms"], "<i4").tolist() == [52, 252]
    assert len(rows[0]["words"]) // 4 == sum(np.frombuffer(rows[0]["sizes"], "<i4")) == 102 + 101 and rows[0]["total"] == 400


def test_a_short_alignment_is_left_only_where_widening_cannot_help():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (rng.integers(0, 2, rng.integers(50, 90)).astype(np.uint32) for _ in "ab")
        start, size = int(rng.integers(0, 45)), 5
        o = int(rng.integers(0, 45))
        b[o:o + size] = a[start:start + size]
        v = [np.array([x]) for x in (start, start + size, o, o + size, size, start, o, len(a) - start - size, len(b) - o - size)]
        got = substring.widened(a, b, 0, start, start + size, o, o + size, size)
        assert bool(substring.may_widen(a, b, *v)[0]) == (got[1] - got[0] >= 50 and got[4] >= 40)


def test_passages_under_other_kinds_of_ids(spark):
    """The first document by the ids' own order has the passage: strings, and negative numbers; a bucket of every run too."""
    shared = " ".join(f"s{i}" for i in range(60))
    for kind, ids in (("string", ["b", "B", "ä", "10", "9"]), ("int", [3, -5, 0, 2, 7]), ("string", ["only"] * 2)):
        rows = [(i, f"x{k} {shared} y{k}") for k, i in enumerate(ids)]
        got = substring.report(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        least = min(ids, key=lambda i: i.encode() if kind == "string" else i)
        assert sorted((r["doc_id"], r["start"], r["stop"], r["ref_doc_id"]) for r in got) == sorted((i, 1, 61, least) for i in ids if i != least)
