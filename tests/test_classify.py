"""Votes, corrections, gates, scoring plug-in and error budget on literal rows."""
import pytest
from pyspark.sql import functions as F

from mailspark.functions import columns as C
from mailspark.operators import classify as K
from mailspark.operators import score as SC

CSCHEMA = "message_id string, model string, prompt_version string, label string, confidence double"


def votes_for(spark, labels):
    rows = [("m", f"x{i}", "v1", lab, 0.5) for i, lab in enumerate(labels)]
    return K.vote(spark.createDataFrame(rows, CSCHEMA)).first()["vote"]


@pytest.mark.parametrize("labels, expected", [
    (["keep", "keep", "keep"], "keep"), (["delete", "delete", "delete"], "delete"),
    (["keep", "delete", "keep"], "uncertain"), (["keep", "uncertain", "delete"], "uncertain"),
    (["uncertain", "uncertain", "uncertain"], "uncertain"), (["keep", "keep", "delete"], "uncertain"),
    (["keep"], "keep"), (["delete"], "delete")])
def test_vote_truth_table(spark, labels, expected):
    assert votes_for(spark, labels) == expected


def test_majority_is_strict(spark):
    rows = [("a", "m1", "v", "keep", 1.0), ("a", "m2", "v", "delete", 1.0), ("a", "m3", "v", "delete", 1.0),
            ("b", "m1", "v", "keep", 1.0), ("b", "m2", "v", "delete", 1.0), ("b", "m3", "v", "uncertain", 1.0),
            ("c", "m1", "v", "keep", 1.0), ("c", "m2", "v", "keep", 1.0), ("c", "m3", "v", "delete", 1.0),
            ("c", "m4", "v", "delete", 1.0)]
    mv = K.minority_votes(spark.createDataFrame(rows, CSCHEMA)).collect()
    # a: majority delete -> m1 outlier; b: 3-way split, no majority; c: 2-2 tie, no majority (Q3)
    assert [(r.message_id, r.model, r.majority_label) for r in mv] == [("a", "m1", "delete")]


def test_latest_corrections(spark):
    rows = [("m1", "keep", "v1", "2026-06-18T10:00:00", 1), ("m1", "delete", "v1", "2026-06-18T12:00:00", 2),
            ("m2", "keep", "v1", None, 3), ("m2", "delete", "v1", None, 4)]
    df = spark.createDataFrame(rows, "message_id string, human_label string, prompt_version string, "
                                     "corrected_at string, line long")
    got = {r.message_id: r.human_label for r in K.latest_corrections(df, "line").collect()}
    assert got == {"m1": "delete", "m2": "delete"}          # later line wins a tie


def test_deployment_gate(spark):
    c = spark.createDataFrame([("m1", "a", "v1.10.0", "keep", 0.9), ("m1", "b", "v1.10.0", "keep", 0.9),
                               ("m2", "a", "v1.10.0", "keep", 0.9), ("m2", "b", "v1.10.0", "delete", 0.9)], CSCHEMA)
    corr = spark.createDataFrame([("m1", "v1.10.0", "keep", "t"), ("m2", "v1.10.0", "keep", "t")],
                                 "message_id string, prompt_version string, human_label string, corrected_at string")
    versions = spark.createDataFrame([("v1.10.0",), ("v1.0.0",), ("v1.9.0",)], "prompt_version string")
    g = {r.prompt_version: r for r in K.deployment_gate(corr, c, versions).collect()}
    assert g["v1.10.0"].status == "fail_error_rate" and g["v1.10.0"].error_rate == pytest.approx(0.5)
    assert g["v1.0.0"].status == "fail_version"
    assert g["v1.9.0"].status == "unmeasured"


def test_version_key(spark):
    df = spark.createDataFrame([("v1.10.0", "v1.9.0")], "a string, b string")
    assert df.select(C.version_key("a") > C.version_key("b")).first()[0] is True


def _pairs(spark, n, model="m"):
    return spark.createDataFrame([(f"id{i}", model, f"From: x\nSubject: s{i}\n") for i in range(n)],
                                 "message_id string, model string, user_turn string")


def test_error_budget_aborts(spark):
    def dead(model, prompt, turns):
        return [None] * len(turns)
    with pytest.raises(Exception) as e:
        SC.classify(_pairs(spark, 10), dead, "p", "v1", partitions=1).collect()
    assert "consecutive hard errors" in str(e.value)


def test_error_budget_resets_and_parse_errors_do_not_count(spark):
    def flaky(model, prompt, turns):
        out = []
        for i, _ in enumerate(turns):
            out.append(None if i % 3 != 2 else "not json")      # 2 failures then a (bad) reply
        return out
    raw = SC.classify(_pairs(spark, 12), flaky, "p", "v1", partitions=1)
    stored, errors = SC.split_errors(SC.parse_scored(raw, "t"))
    assert stored.count() == 4 and stored.where("label = 'uncertain'").count() == 4
    assert errors.count() == 12                                # 8 hard + 4 parse errors logged


def test_keyword_pipeline_and_pending(spark):
    msgs = spark.createDataFrame([("a", "x@y", "n", "Your invoice"), ("b", "x@y", "n", "Hi"),
                                  (None, "x@y", "n", "no id")],
                                 "message_id string, from_email string, from_name string, subject string")
    turns = SC.user_turns(msgs)
    done = spark.createDataFrame([("a", "m1", "v")], "message_id string, model string, prompt_version string")
    pairs = K.pending(turns, ["m1", "m2"], done, "v")
    assert sorted((r.message_id, r.model) for r in pairs.collect()) == [("a", "m2"), ("b", "m1"), ("b", "m2")]
    res = SC.parse_scored(SC.classify(pairs, SC.keyword_responder, "p", "v"), "t")
    got = {(r.message_id, r.model): r.label for r in res.collect()}
    assert got[("a", "m2")] == "keep" and got[("b", "m1")] == "uncertain"


def test_label_check_split(spark):
    df = spark.createDataFrame([("a", "m", "v", "keep", 1.0), ("b", "m", "v", "spam", 1.0)], CSCHEMA)
    ok, bad = K.valid_labels(df)
    assert ok.count() == 1 and bad.first().label == "spam"


def test_fan_out_has_no_join(spark):
    df = K.fan_out(spark.range(3).withColumnRenamed("id", "message_id"), ["a", "b"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and df.count() == 6
