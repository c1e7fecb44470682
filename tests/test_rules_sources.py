"""Rule vocabulary, cascade semantics, audit, readers and streaming = batch."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from mailspark.functions.predicates import Rule, cutoff_epoch, parse_size, rule_predicate
from mailspark.operators import audit as AU
from mailspark.operators import rules as R
from mailspark.sources import api as API
from mailspark.sources import lists as L

AS_OF = 996624000  # 2001-08-01
MSCHEMA = ("path string, mbox_offset long, message_id string, thread_id string, date_ts long, from_email string, subject string, "
           "category string, labels array<string>, is_unread int, is_starred int, is_important int, in_inbox int, "
           "in_sent int, in_trash int, body_size_bytes long")


def msg(off, **kw):
    base = dict(path="a.mbox", mbox_offset=off, message_id=f"m{off}", thread_id=f"t{off}", date_ts=AS_OF - 400 * 86400,
                from_email="a@b.com", subject="hello", category="promotions", labels=["Category Promotions"],
                is_unread=1, is_starred=0, is_important=0, in_inbox=1, in_sent=0, in_trash=0, body_size_bytes=10)
    base.update(kw)
    return base


def test_age_and_size():
    assert cutoff_epoch(AS_OF, "6m") == 980985600          # 2001-02-01
    assert cutoff_epoch(AS_OF, "7d") == AS_OF - 7 * 86400
    assert parse_size("1M") == 1048576


def test_whole_token_subject_and_sender(spark):
    rows = [msg(1, subject="Your package was DELIVERED today", from_email="x@mail.ups.com"),
            msg(2, subject="undelivered mail", from_email="x@ups.com"),
            msg(3, subject="delivered", from_email="x@notups.com")]
    df = spark.createDataFrame(rows, MSCHEMA)
    r = Rule("ship", from_any=("ups.com",), subject_any=("delivered",))
    got = [x.mbox_offset for x in df.where(rule_predicate(r, AS_OF)).collect()]
    assert got == [1]


def test_cascade_first_match_and_protection(spark):
    rows = [msg(1), msg(2, is_starred=1), msg(3, from_email="friend@x.com"), msg(4, thread_id="tr"),
            msg(5, thread_id="tr", in_sent=1, category="primary", is_unread=0, labels=["Reference"]),
            msg(6, date_ts=None)]
    m = spark.createDataFrame(rows, MSCHEMA)
    contacts = spark.createDataFrame([(" Friend@X.com ",)], "email string")
    out = {r.mbox_offset: r for r in R.prune(m, R.STANDING_RULES, contacts, AS_OF).collect()}
    assert out[1].category == "Old promotions" and out[1].decision == "prune"
    assert 2 not in out and 5 not in out and 6 not in out      # starred / Reference+sent / no date
    assert out[3].protected_by == "contact" and out[3].decision == "skip"
    assert out[4].protected_by == "replied_thread"


def test_apply_actions_and_summary(spark):
    m = spark.createDataFrame([msg(1), msg(2, in_trash=1, labels=["Trash"], subject="your invoice")], MSCHEMA)
    acts = R.prune(m, R.STANDING_RULES, spark.createDataFrame([], "email string"), AS_OF)
    new = {r.mbox_offset: r for r in R.apply_actions(m, acts, "prune").collect()}
    assert new[1].in_trash == 1 and "Audit/Pruned/Old promotions" in new[1].labels
    resc = R.rescue(m, R.RESCUE_RULES, AS_OF)
    back = {r.mbox_offset: r for r in R.apply_actions(m, resc, "rescue").collect()}
    assert back[2].in_trash == 0 and "Trash" not in back[2].labels and "Reference" in back[2].labels
    s = R.run_summary(acts).first()
    assert (s.moved, s.skipped, s.failed) == (1, 0, 0)


def test_reference_stale(spark):
    df = spark.createDataFrame([(AS_OF - 8 * 86400,), (AS_OF - 7 * 86400,), (None,)], "t long")
    assert [r[0] for r in df.select(R.reference_stale(F.col("t"), AS_OF)).collect()] == [True, False, True]


def test_audit_near_miss_order(spark):
    rows = [(1, "2026-01-01", "pruned", "A", "x", "s@x", "S"), (2, "2026-01-02", "rescued", "B", "x", "s@x", "S"),
            (3, "2026-01-03", "rescued", "C", "y", "t@x", "T"), (4, "2026-01-04", "trash", "D", "y", "t@x", "T")]
    a = spark.createDataFrame(rows, "event_id long, ts string, action string, category string, message_id string, "
                                    "sender string, subject string")
    assert sorted(r.message_id for r in AU.audit_near_misses(a).collect()) == ["x", "y"]
    assert [r.message_id for r in AU.audit_near_misses(a, strict_order=True).collect()] == ["x"]
    t = AU.audit_totals(a).first()
    assert (t.pruned, t.rescued) == (2, 2)


def test_readers(spark):
    tmp = tempfile.mkdtemp(prefix="lists-")
    p = os.path.join(tmp, "contacts.txt")
    with open(p, "w") as f:
        f.write("# comment\nAlice@Example.com\n\n  bob@x.org \nalice@example.com\n")
    assert sorted(r.email for r in L.read_contacts(spark, p).collect()) == ["alice@example.com", "bob@x.org"]
    assert L.read_contacts(spark, os.path.join(tmp, "missing.txt")).count() == 0
    n = os.path.join(tmp, "noisy.txt")
    with open(n, "w") as f:
        f.write("# x\nnews@a.com\nbank@b.com\tstatement, payment due ,\n")
    rows = {r.address: r.exclude_keywords for r in L.read_noisy_senders(spark, n).collect()}
    assert rows == {"news@a.com": [], "bank@b.com": ["statement", "payment due"]}
    k = os.path.join(tmp, "keep.tsv")
    with open(k, "w") as f:
        f.write("# c\nPresident\tfrom:president@example.edu\nbroken line\nTrips\tsubject:(itinerary OR \"e-ticket\")\n")
    rules = L.keep_rules(spark, k, "rescue")
    assert [r.name for r in rules] == ["President", "Trips"] and rules[1].subject_any == ("itinerary", "e-ticket")
    j = os.path.join(tmp, "corr.jsonl")
    with open(j, "w") as f:
        f.write(json.dumps({"message_id": "m1", "human_label": "keep", "prompt_version": "v1",
                            "model_labels": {"a": "keep"}, "corrected_at": "t"}) + "\n\nnot json\n")
    good, bad = L.read_jsonl(spark, j, L.CORRECTIONS_SCHEMA)
    assert good.count() == 1 and bad.count() == 1
    assert good.first().model_labels == {"a": "keep"}


def test_build_contacts(spark):
    a = spark.createDataFrame([([{"value": "A@x.com"}, {"value": "b@x.com"}],)],
                              "emailAddresses array<struct<value:string>>")
    b = spark.createDataFrame([], "emailAddresses array<struct<value:string>>")
    assert [r.email for r in L.build_contacts(a, b).collect()] == ["a@x.com", "b@x.com"]


def test_api_messages(spark):
    import base64
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    doc = {"id": "1", "threadId": "t", "labelIds": ["INBOX", "Reference", "UNREAD"],
           "payload": {"headers": [{"name": "From", "value": "Ann <Ann@X.com>"}, {"name": "from", "value": "z@z"},
                                   {"name": "Subject", "value": "Hi"}],
                       "parts": [{"mimeType": "text/plain", "body": {"data": enc("plain")}},
                                 {"mimeType": "text/html", "body": {"data": enc("<p>html</p>")}}]}}
    tmp = tempfile.mkdtemp(prefix="api-")
    with open(os.path.join(tmp, "a.json"), "w") as f:
        f.write(json.dumps(doc) + "\n")
    r = API.api_to_messages(API.read_api_messages(spark, tmp)).first()
    assert r.from_email == "ann@x.com" and r.subject == "Hi" and r.body_text == "<p>html</p>"
    assert r.has_reference is True


def test_streaming_audit_counts_equal_batch(spark):
    """Over restarts, and when a batch is done again, the counts table equals the batch report."""
    from mailspark.streaming.audit import merge_counts, read_audit_counts, start_audit_counts
    tmp = tempfile.mkdtemp(prefix="audit-")
    os.makedirs(tmp + "/in")
    steps = [[("pruned", "A"), ("trash", "A"), ("rescued", "B"), ("rescue", "A")], [("pruned", "C"), (None, None)],
             [("rescued", "C"), ("pruned", "A"), ("pruned", None)]]
    for n, step in enumerate(steps):
        with open(f"{tmp}/in/{n}.jsonl", "w") as f:
            for i, (a, c) in enumerate(step):
                f.write(json.dumps({"ts": "t", "action": a, "category": c, "message_id": str(i), "from": "x", "subject": "s"}) + "\n")
        q = start_audit_counts(spark, tmp + "/in", tmp + "/counts", tmp + "/ck", trigger_once=True)
        q.awaitTermination(240)
        assert q.exception() is None
        batch = AU.audit_by_category(spark.read.schema(L.AUDIT_SCHEMA).json(tmp + "/in")).collect()
        assert read_audit_counts(spark, tmp + "/counts").collect() == batch
    again = spark.createDataFrame([("A", 3, 1), ("C", 1, 1), (None, 1, 0)], "category string, pruned long, rescued long")
    merge_counts(tmp + "/counts")(again, 2)
    assert read_audit_counts(spark, tmp + "/counts").collect() == batch
    assert sorted(os.listdir(tmp + "/counts")) == ["version=1", "version=2"]


def test_noisy_direction_q8(spark):
    old = [msg(i, from_email="n@x.com", is_unread=1, date_ts=AS_OF - 200 * 86400) for i in range(6)]
    new = [msg(10 + i, from_email="m@x.com", is_unread=1, date_ts=AS_OF - 10 * 86400) for i in range(6)]
    m = spark.createDataFrame(old + new, MSCHEMA)
    coded = [r.from_email for r in R.noisy_senders(m, AS_OF).collect()]
    documented = [r.from_email for r in R.noisy_senders(m, AS_OF, direction="newer").collect()]
    assert coded == ["n@x.com"] and documented == ["m@x.com"]


def test_stratified_overlap_q5(spark):
    from mailspark.operators import classify as K
    rows = [msg(i, labels=["Category Promotions", "Category Social"], in_inbox=0) for i in range(10)]
    m = spark.createDataFrame(rows, MSCHEMA)
    s = K.stratified_sample(m, 10, ["message_id"])                 # 2 per stratum
    assert sorted(r.stratum for r in s.collect()) == ["promotions", "promotions", "social", "social"]
    assert {r.message_id for r in s.collect()} == {"m0", "m1"}      # same newest rows in both strata
    assert K.stratified_sample(m, 10, ["message_id"], distinct=True).count() == 2


def test_api_body_choice_edges(spark):
    import base64
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    docs = [
        {"id": "a", "payload": {"parts": [{"mimeType": "text/plain", "body": {"data": enc("plain first")}},
                                          {"mimeType": "text/html", "body": {"data": ""}}]}},
        {"id": "b", "payload": {"parts": [{"mimeType": "text/html", "body": {"data": enc("<b>h</b>")}},
                                          {"mimeType": "text/plain", "body": {"data": enc("later plain")}}]}},
        {"id": "c", "payload": {"body": {"data": enc("single part")}}},
        {"id": "d", "payload": {"headers": [{"name": "Subject", "value": "one"}, {"name": "subject", "value": "two"}]}},
    ]
    tmp = tempfile.mkdtemp(prefix="api2-")
    with open(os.path.join(tmp, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(d) for d in docs) + "\n")
    got = {r.message_id: r for r in API.api_to_messages(API.read_api_messages(spark, tmp)).collect()}
    assert got["a"].body_text == "plain first"          # empty html part: the plain part before it
    assert got["b"].body_text == "<b>h</b>"
    assert got["c"].body_text == "single part"
    assert got["d"].body_text == "" and got["d"].subject == "one"   # first header wins
    assert got["c"].subject == "(no subject)"
