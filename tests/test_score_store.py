"""Scores in buckets: latest wins, votes without a shuffle, versions that a stopped upsert leaves whole."""
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from mailspark.operators import classify as K
from mailspark.operators.score_store import ScoreStore

SCHEMA = "message_id string, model string, prompt_version string, label string, confidence double, classified_at string"


def _scores(spark, rng, n, at):
    rows = [(f"m{rng.randint(0, 40)}", rng.choice("abc"), rng.choice(["v1", "v2"]), rng.choice(K.LABELS), rng.choice([None, 0.1, 0.9]),
             rng.choice([at, at + "x", None])) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upserts_equal_the_window_form(spark):
    rng = random.Random(3)
    runs = [_scores(spark, rng, 150, f"t{i}").cache() for i in range(3)]
    store = ScoreStore(spark, tempfile.mkdtemp(prefix="scores-") + "/s", buckets=4).create(runs[0])
    want = K.upsert_classifications(runs[0].limit(0), runs[0])
    assert _rows(store.read()) == _rows(want)
    for n, run in enumerate(runs[1:], start=1):
        want = K.upsert_classifications(want, run)
        assert store.upsert(run) == n and _rows(store.read()) == _rows(want)
    assert _rows(K.vote(store.read())) == _rows(K.vote(want))
    assert _rows(K.disagreement_rate(store.read())) == _rows(K.disagreement_rate(want))
    files = [f for f in os.listdir(store.path + "/v2") if f.endswith(".parquet")]
    assert len(files) <= 4                                     # a file a bucket


def test_votes_and_upserts_do_not_shuffle_what_is_stored(spark):
    rng = random.Random(5)
    store = ScoreStore(spark, tempfile.mkdtemp(prefix="scores-") + "/s", buckets=4).create(_scores(spark, rng, 200, "t"))
    for question in (K.vote, K.disagreeing_keys):
        plan = _plan(question(store.read()))
        assert "Exchange" not in plan and "Bucketed: true" in plan
    for question in (K.disagreement_rate, K.ensemble_verdict, K.outlier_by_model):   # only the final counts are shuffled
        plan = _plan(question(store.read()))
        assert "hashpartitioning(message_id" not in plan, plan
    new = _scores(spark, rng, 20, "u")
    plan = _plan(store.merged(new))
    left = plan[plan.index("SortMergeJoin"):].split("+- ", 1)[0] + plan[plan.index("SortMergeJoin"):]
    old_side = left[:left.index("Bucketed: true")]
    assert "Exchange" not in old_side, plan


def test_a_stopped_upsert_leaves_the_store(spark):
    rng = random.Random(7)
    store = ScoreStore(spark, tempfile.mkdtemp(prefix="scores-") + "/s", buckets=2).create(_scores(spark, rng, 50, "t"))
    before = _rows(store.read())
    new = _scores(spark, rng, 30, "u").cache()

    @F.udf("string")
    def fails(x):
        raise RuntimeError("stopped")
    with pytest.raises(Exception):
        store.upsert(new.withColumn("label", fails("label")))
    assert store.versions() == [0] and _rows(store.read()) == before
    assert store.upsert(new) == 1 and store.versions() == [0, 1]
