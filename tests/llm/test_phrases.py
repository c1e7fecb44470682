"""Phrases against counts in plain Python, with few and with many lengthened prefixes."""

import random
import re
from collections import Counter

import pytest

from mailspark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, key long, n long, word string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least=10, top=2000):
    out = []
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        rank = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= 50 * a and b >= least and p in (q[:2], q[1:]) for q, b in own.items() if len(q) == 3):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        rank.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rank[:top])]
    return sorted(out)


def texts(rng, n):
    words = ["the", "a", "of", "New", "york", "é", "漢字", "x-y", "sea side", "rare", "'s"]
    rows = []
    for i in range(n):
        body = " ".join(rng.choices(words, weights=[40, 20, 10, 8, 8, 4, 4, 3, 2, 1, 2], k=rng.randint(0, 40)))
        body = re.sub(r"New \S+", "New york", body)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(body))
            body = body[:at] + rng.choice([". ", "\n", ", ", "\t", "  ", "!?", "\x0b"]) + body[at:]
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), body))
    return rows + [("en", None), ("en", ""), (None, " \t ,, "), ("de", "of the of"), ("en", "the " * 30_000), ("en", rows[0][1]), ("en", rows[0][1])]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, lang, 5, 6, "w") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in phrases.mine(df, **how).collect())


@pytest.mark.parametrize("budget", [phrases.BUDGET, 4000, 64])
def test_against_plain_counts(spark, budget):
    """At 4,000 words are lengthened, at 64 pairs of words as well; the phrases are the same."""
    rows = texts(random.Random(2), 250)
    got = run(spark, rows, budget=budget)
    assert got == expected(rows) and len(got) > 30


def test_top_and_ties(spark):
    rows = [("en", f"{a} {b}. ") for a, b in [("b", "c"), ("d", "é"), ("d", "f"), ("z", "y")] for _ in range(12)]
    assert run(spark, rows, top=3) == expected(rows, top=3)
    assert run(spark, rows, top=3)[-1][1] == 3


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.mine(df).collect() == []
    assert run(spark, [("en", None), (None, "..")]) == []


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 3_000_000_000_001, 4_000_000_000_003)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r").alias("s")).first()["s"] == 10 ** 6 * 3_000_000_000_000 ** 2 // (3_000_000_000_001 * 4_000_000_000_003)


def test_equal_bits_take_another_hash(spark, monkeypatch):
    """A hash under which all words look alike is noticed, and the next one is taken."""
    real = phrases._byte_table
    monkeypatch.setattr(phrases, "span_hashes", lambda data, a, b, table: phrases.np.full(len(a), 5, phrases.np.uint64)
                        if (table == real(0)).all() else phrases.np.cumsum(phrases.np.ones(len(a), phrases.np.uint64)))
    batch = phrases.pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b a"]})
    first, second = (next(phrases._vocabulary(seed)(iter([batch]))).to_pydict() for seed in (0, 1))
    assert len(set(first["key"])) == 1 and sorted(first["word"]) == ["a", "b"]
    assert len(set(second["key"])) > 1
