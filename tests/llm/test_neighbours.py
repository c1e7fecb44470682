"""Neighbours against brute force: recall, exact scores, ties, copies and odd vectors."""

import numpy as np
import pytest

from mailspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, part int, rep long, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4) for i, v in rows],
                                 SCHEMA).repartition(4)


def brute(rows, k=20, every=20):
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    out = {}
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            near = sorted((-float(neighbours.exact(v[None], w[None])[0]), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        mine = out.setdefault(r["query_id"], [])
        mine.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(mine)
    return out


def vectors(n, dim, groups, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dim)) * 2
    x = centre[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))
    return (x * rng.uniform(0.5, 1.5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("groups", [12, 1])
def test_recall_and_scores(spark, groups):
    """Vectors in groups, and without any structure."""
    x = vectors(2400, 16, groups)
    rows = list(enumerate(x))
    got, want = answers(neighbours.search(frame(spark, rows), fill=150)), brute(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 20 * len(want)
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and q not in [j for j, _ in near]
        assert all(s == neighbours.exact(x[q][None].astype(float), x[j][None].astype(float))[0] for j, s in near)


def test_parts_are_searched_in_part(spark):
    """With structure, a query reads few of the parts."""
    x = vectors(3000, 16, 12).astype(float)
    router, mass = neighbours.learn(x, 12)
    q, part, _ = router.routes(x[::20], mass)
    assert len(q) < 0.6 * 12 * len(x[::20])
    near = neighbours.graph(x)
    first = neighbours._medians(x, 12, np.random.default_rng(0))
    label = neighbours.balanced_parts(near, first, 12)
    within = [(c[near] == c[:, None]).mean() for c in (first, label)]
    assert within[1] > within[0] and np.bincount(label, minlength=12).max() <= np.ceil(250 * 1.05)


def test_blocks_give_the_same(spark, monkeypatch):
    x = vectors(700, 8, 3)
    rows = list(enumerate(x))
    whole = answers(neighbours.search(frame(spark, rows), fill=200))
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    assert answers(neighbours.search(frame(spark, rows), fill=200)) == whole


def test_ties_and_copies(spark):
    """Whole numbers, so that many scores tie; a third of the rows are one vector."""
    rng = np.random.default_rng(4)
    x = rng.integers(-1, 2, (300, 6))
    x[(x == 0).all(axis=1)] = 1
    x[::3] = [1, 1, 0, 0, 1, -1]
    rows = list(enumerate(x))
    assert answers(neighbours.search(frame(spark, rows))) == brute(rows)


def test_small_and_odd(spark):
    rows = [(0, [1, 0]), (20, [0, 0]), (40, None), (60, []), (80, [1, None]), (100, [1, float("nan")]), (120, [1, float("inf")]),
            (1, [2, 1]), (None, [5, 5]), (2, [-1, 3]), (140, [1, 2, 3]), (3, [3, 2, 1]), (160, [4])]
    got = answers(neighbours.search(frame(spark, rows)))
    assert got == {0: [(1, 2.0), (2, -1.0)], 140: [(3, 10.0)]}
    assert neighbours.search(frame(spark, [])).collect() == []
    # equal rows are one; rows that share an id are both there
    twice = frame(spark, [(0, [1, 0]), (0, [1, 0]), (5, [1, 1]), (5, [2, 0]), (5, [2, 0])])
    assert answers(neighbours.search(twice)) == {0: [(5, 2.0), (5, 1.0)]}
