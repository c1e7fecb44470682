"""Job-level pieces: ledger + import summary, append sinks, prompt catalogue, live scoring stream."""
import base64
import json
import os
import tempfile

from pyspark.sql import functions as F

from mailspark.operators import audit as AU
from mailspark.operators import classify as K
from mailspark.operators import messages as M
from mailspark.operators import score as SC
from mailspark.operators.corrections import append_corrections
from mailspark.sources import lists as L
from mailspark.sources import parse as P
from mailspark.sources.versioned import VersionConflict, VersionedTable


def test_ledger_and_import_summary(spark):
    rows = [(1, "/a.mbox", 2147483648, 1073741824, 100, "s1", "u1", None),
            (2, "/a.mbox", 2147483648, 2147483648, 200, "s1", "u2", "c2"),
            (3, "/b.mbox", 1000, 10, 1, "s3", "u3", None)]
    led = spark.createDataFrame(rows, P.LEDGER_SCHEMA)
    latest = P.update_ledger(led.where("id = 1"), led.where("id > 1"))
    got = {r.mbox_path: r.id for r in latest.collect()}
    assert got == {"/a.mbox": 2, "/b.mbox": 3}
    assert {r.mbox_path: r.resume_offset for r in P.resume_offsets(latest).collect()} == {"/b.mbox": 10}
    s = {r.mbox_path: r for r in M.import_summary(latest).collect()}
    assert s["/a.mbox"].mbox_size == "2.00 GB" and s["/a.mbox"].pct_done == "100.0%"
    assert s["/b.mbox"].completed_at == "(in progress)" and s["/b.mbox"].pct_done == "1.0%"


def test_fixed_text_rounding(spark):
    from mailspark.functions.columns import fixed_text
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (5, 1000)], "n long, d long")
    got = [r[0] for r in df.select(fixed_text(F.col("n") * 100, "d", 1, "%")).collect()]
    assert got == ["12.5%", "33.3%", "66.7%", "0.5%"]


def test_append_sinks_round_trip(spark):
    tmp = tempfile.mkdtemp(prefix="sinks-")
    corr = spark.createDataFrame([("m1", "keep", "v1", {"a": "keep"}, "2026-01-01T00:00:00"),
                                  ("m1", "delete", "v1", {"a": "keep"}, "2026-01-02T00:00:00")],
                                 "message_id string, human_label string, prompt_version string, "
                                 "model_labels map<string,string>, corrected_at string")
    append_corrections(corr.limit(1), tmp + "/corr")
    append_corrections(corr.where("human_label = 'delete'"), tmp + "/corr")
    good, bad = L.read_jsonl(spark, tmp + "/corr", L.CORRECTIONS_SCHEMA)
    assert bad.count() == 0
    assert K.latest_corrections(good, "line_no").first().human_label == "delete"
    audit = spark.createDataFrame([("2026-01-01 10:00:00", "Old promotions", "m1", "a@x", "s")],
                                  "ts string, category string, message_id string, sender string, subject string")
    AU.append_audit(audit.withColumn("ts", F.to_timestamp("ts")), "pruned", tmp + "/audit")
    row = spark.read.schema(L.AUDIT_SCHEMA).json(tmp + "/audit").first()
    assert row.ts == "2026-01-01T10:00:00Z" and row.action == "pruned" and row["from"] == "a@x"


def test_prompt_catalogue(spark):
    tmp = tempfile.mkdtemp(prefix="prompts-")
    with open(os.path.join(tmp, "v9.1.0.yaml"), "w") as f:
        f.write("version: v9.1.0\nsystem_prompt: be brief\nkeep_criteria: [a, b]\ndelete_criteria: [c]\n"
                "output_format: '{}'\n")
    df = L.read_prompts(spark, tmp, "v9.1.0")
    r = df.first()
    assert r.system_prompt == "be brief" and r.keep_criteria == ["a", "b"]
    with open(os.path.join(tmp, "v9.2.0.yaml"), "w") as f:
        f.write("version: v9.3.0\n")
    try:
        L.read_prompts(spark, tmp)
        raise AssertionError("mismatched version must fail")
    except ValueError:
        pass


def test_live_scoring_stream(spark):
    from mailspark.streaming.live import start_live
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    tmp = tempfile.mkdtemp(prefix="live-")
    os.makedirs(tmp + "/in")
    msgs = []
    for i, (frm, subj, labels, thread) in enumerate([
            ("A <a@x.com>", "Your invoice", ["INBOX"], "t1"),          # scored: keep
            ("B <b@x.com>", "Security alert", ["INBOX"], "t2"),        # scored: delete
            ("Friend <friend@x.com>", "hi", ["INBOX"], "t3"),          # contact -> skipped
            ("C <c@x.com>", "ref", ["Reference"], "t4"),               # Reference -> skipped
            ("D <d@x.com>", "re", ["INBOX"], "t5"),                    # replied thread -> skipped
            ("E <e@x.com>", "done", ["INBOX"], "t6")]):                # checkpointed -> skipped
        msgs.append({"id": f"id{i}", "threadId": thread, "labelIds": labels,
                     "payload": {"headers": [{"name": "From", "value": frm}, {"name": "Subject", "value": subj}],
                                 "parts": [{"mimeType": "text/html", "body": {"data": enc("<p>Hello</p>")}}]}})
    with open(tmp + "/in/batch.json", "w") as f:
        f.write("\n".join(json.dumps(m) for m in msgs) + "\n")
    checkpointed = spark.createDataFrame([("id5",)], "message_id string")
    contacts = spark.createDataFrame([("friend@x.com",)], "email string")
    replied = spark.createDataFrame([("t5",)], "thread_id string")
    q = start_live(spark, tmp + "/in", tmp + "/out", tmp + "/ck", checkpointed, contacts, replied,
                   ["kw-a", "kw-b"], SC.keyword_responder, "p", "v1.1.0", trigger_once=True)
    q.awaitTermination(180)
    acts = {r.message_id: r for r in spark.read.parquet(tmp + "/out/actions").collect()}
    assert set(acts) == {"id0", "id1"}
    assert acts["id0"].action_label == "AI/Keep" and acts["id1"].action_label == "AI/Delete"
    assert all(r.applied is False for r in acts.values())
    assert not os.path.exists(tmp + "/out/audit")                          # a dry run marks nothing as done

    def real(n):
        q = start_live(spark, tmp + "/in", tmp + "/real", f"{tmp}/ck{n}", checkpointed, contacts, replied,
                       ["kw-a", "kw-b"], SC.keyword_responder, "p", "v1.1.0", dry_run=False, trigger_once=True)
        q.awaitTermination(180)
        return spark.read.json(tmp + "/real/audit")
    audit = real(1)
    assert {(r.message_id, r.label, r.category) for r in audit.collect()} == {
        ("id0", "AI/Keep", "ai_classify"), ("id1", "AI/Delete", "ai_classify")}
    # mail that comes later, and a message already checkpointed by this sink, in a new batch of a running stream
    again = [dict(msgs[0]), dict(msgs[1], id="id9"), dict(msgs[1], id="id10", labelIds=["SENT"], threadId="t8")]
    again[1]["payload"] = {"headers": msgs[1]["payload"]["headers"], "body": {"data": base64.urlsafe_b64encode(b"caf\xe9").decode()}}
    with open(tmp + "/in/later.json", "w") as f:
        f.write("\n".join(json.dumps(m) for m in again) + "\n")
    assert sorted(r.message_id for r in real(1).collect()) == ["id0", "id1", "id9"]


def test_api_bodies_of_any_bytes(spark):
    from mailspark.sources import api as API
    vals = [base64.urlsafe_b64encode(b"caf\xe9 \xc3\xa9").decode().rstrip("="), "***", "", None,
            base64.urlsafe_b64encode("\u00e9?>".encode()).decode()]
    df = spark.createDataFrame([(v,) for v in vals], "d string").select(API.b64url_text(F.col("d")).alias("t"))
    assert [r.t for r in df.collect()] == ["caf\ufffd \u00e9", "", None, None, "\u00e9?>"]


def _responder(bad):
    """A model that fails a whole call where ``bad(model, turn)`` holds (a closure, so that workers need no test module)."""
    def fn(model, prompt, turns):
        if any(bad(model, t) for t in turns):
            raise TimeoutError("slow")
        return ['{"label": "keep", "confidence": 0.9, "reason": "r"}' for _ in turns]
    return fn


def test_one_bad_call_costs_one_message(spark):
    pairs = spark.createDataFrame([(f"m{i}", "a", "poison" if i == 7 else "fine") for i in range(40)],
                                  "message_id string, model string, user_turn string")
    rows = SC.classify(pairs, _responder(lambda m, t: "poison" in t), "p", "v1.1.0", partitions=1).collect()
    assert [r.message_id for r in rows if r.error] == ["m7"] and len(rows) == 40


def test_scoring_run_keeps_what_it_has_and_resumes(spark):
    tmp = tempfile.mkdtemp(prefix="score-run-")
    m = spark.createDataFrame([(f"m{i}", "a@x", "A", f"s{i}", "body") for i in range(30)],
                              "message_id string, from_email string, from_name string, subject string, body_text string")
    try:
        SC.scoring_run(spark, m, ["a", "b"], _responder(lambda m, t: m == "b"), "p", "v1.1.0", tmp, waves=3)
        raise AssertionError("the budget must end the pass")
    except Exception as exc:  # noqa: BLE001
        assert "hard errors" in str(exc)
    SC.scoring_run(spark, m, ["a"], _responder(lambda m, t: m == "b"), "p", "v1.1.0", tmp, waves=3)
    n = spark.read.parquet(tmp + "/replies").where("raw_response IS NOT NULL").count()
    assert n == 30
    paths = SC.scoring_run(spark, m, ["a", "b"], SC.keyword_responder, "p", "v1.1.0", tmp, waves=3)
    votes = spark.read.parquet(paths["votes"])
    assert votes.count() == 60 and votes.where("model = 'a' AND label = 'keep'").count() == 30
    assert spark.read.json(paths["disagreements"]).count() == 30 and spark.read.json(paths["errors"]).count() == 30


def _counting(folder, down):
    """A factory that notes each opening and call in a folder; models in ``down`` fail every call."""
    def factory(model):
        import os
        import uuid
        open(f"{folder}/open-{model}-{uuid.uuid4().hex}-{os.getpid()}", "w").close()

        def call(prompt, turns):
            open(f"{folder}/call-{model}-{uuid.uuid4().hex}", "w").close()
            if model in down:
                raise TimeoutError("down")
            return ['{"label": "keep", "confidence": 0.9, "reason": "r"}' for _ in turns]
        return call
    return factory


def _noted(folder, kind):
    return [n for n in os.listdir(folder) if n.startswith(kind)]


def test_a_task_has_one_model_and_opens_it_once(spark):
    tmp = tempfile.mkdtemp(prefix="open-")
    pairs = spark.createDataFrame([(f"m{i}", m, "t") for i in range(300) for m in ("a", "b", "c")],
                                  "message_id string, model string, user_turn string")
    raw = SC.classify(pairs, _counting(tmp, ()), "p", "v", partitions=12, factory=True, checkpoint=False, models=["a", "b", "c"])
    by_task = raw.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("model").alias("models"), F.count("*").alias("n"))
    got = by_task.collect()
    assert len(got) == 12 and {r.models for r in got} == {1} and sum(r.n for r in got) == 900
    assert len(_noted(tmp, "open-")) == 12
    assert max(r.n for r in got) < 2 * min(r.n for r in got)


def test_a_pass_whose_every_call_fails_ends_after_few_calls(spark):
    """Over 200 tasks: the first wave finds the model down; of a model that works, all replies are kept."""
    tmp = tempfile.mkdtemp(prefix="budget-")
    os.makedirs(tmp + "/notes")
    m = spark.createDataFrame([(f"m{i}", "a@x", "A", f"s{i}", "body") for i in range(800)],
                              "message_id string, from_email string, from_name string, subject string, body_text string")

    def run(down, **how):
        try:
            SC.scoring_run(spark, m, ["up", "down"], _counting(tmp + "/notes", down), "p", "v1.1.0", tmp + "/s", waves=2, partitions=200,
                           factory=True, **how)
        except SC.ErrorBudgetExceeded as exc:
            return str(exc)
    assert "model down" in run(("down",))
    assert len(_noted(tmp + "/notes", "call-down")) <= 25        # one task: a call halved down to single turns
    replies = spark.read.parquet(tmp + "/s/replies")
    kept = replies.where("raw_response IS NOT NULL").count()
    assert 0 < kept < 800 and replies.where("model = 'up' AND raw_response IS NULL").count() == 0
    # errors spread over many tasks, none of which has five of its own, end the pass as well
    few = tempfile.mkdtemp(prefix="budget-few-")
    try:
        SC.scoring_run(spark, m.limit(60), ["down"], _responder(lambda *_: True), "p", "v1.1.0", few, waves=1, partitions=200)
        raise AssertionError("the budget must end the pass")
    except SC.ErrorBudgetExceeded:
        pass
    # resumed when the model is back: what is there is not asked again
    before = len(_noted(tmp + "/notes", "call-up"))
    assert run(()) is None and len(_noted(tmp + "/notes", "call-up")) > before
    replies = spark.read.parquet(tmp + "/s/replies").where("raw_response IS NOT NULL")
    assert replies.count() == replies.select("message_id", "model").distinct().count() == 1600


def test_the_corpus_is_read_once_a_pass(spark):
    """Each wave reads its own part of the staged pairs, and never the messages."""
    tmp = tempfile.mkdtemp(prefix="once-")
    m = spark.createDataFrame([(f"m{i}", "a@x", "A", f"s{i}", "body") for i in range(60)],
                              "message_id string, from_email string, from_name string, subject string, body_text string")
    m.write.parquet(tmp + "/m")
    seen = []
    real = SC.classify

    def noted(pairs, *a, **k):
        seen.append((pairs._jdf.queryExecution().executedPlan().toString(), pairs.inputFiles()))
        return real(pairs, *a, **k)
    SC.classify = noted
    try:
        paths = SC.scoring_run(spark, spark.read.parquet(tmp + "/m"), ["a"], SC.keyword_responder, "p", "v", tmp + "/s", waves=3)
    finally:
        SC.classify = real
    assert len(seen) == 4 and spark.read.parquet(paths["votes"]).count() == 60
    for wave, (plan, files) in enumerate(seen):
        assert f"= {wave})" in plan.split("PartitionFilters:")[1].split("]")[0] and not any(tmp in f for f in files)


def test_live_state_of_threads_and_messages(spark):
    """Sent mail seen between batches protects its thread, a changed contact file counts, and the audit history is not read."""
    from mailspark.streaming.live import start_live
    tmp = tempfile.mkdtemp(prefix="live-state-")
    os.makedirs(tmp + "/in")
    with open(tmp + "/contacts.txt", "w") as f:
        f.write("# none\n")

    def batch(name, rows):
        with open(f"{tmp}/in/{name}.json", "w") as f:
            for i, sender, thread, labels in rows:
                f.write(json.dumps({"id": i, "threadId": thread, "labelIds": labels, "payload": {
                    "headers": [{"name": "From", "value": sender}, {"name": "Subject", "value": "Your invoice"}],
                    "parts": [{"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"Hello").decode()}}]}}) + "\n")
        none = spark.createDataFrame([], "message_id string, thread_id string")
        q = start_live(spark, tmp + "/in", tmp + "/out", tmp + "/ck", none, lambda: L.read_contacts(spark, tmp + "/contacts.txt"), none,
                       ["kw-a"], SC.keyword_responder, "p", "v1.1.0", dry_run=False, trigger_once=True)
        q.awaitTermination(240)
        assert q.exception() is None
        return sorted(r.message_id for r in spark.read.parquet(tmp + "/out/actions").collect())
    assert batch("1", [("a", "x@x.com", "t1", ["INBOX"]), ("b", "y@x.com", "t2", ["INBOX"])]) == ["a", "b"]
    assert batch("2", [("mine", "me@x.com", "t1", ["SENT"])]) == ["a", "b"]
    for n in os.listdir(tmp + "/out/audit"):                      # scored messages are known without it
        if n.startswith("batch_id="):
            os.rename(f"{tmp}/out/audit/{n}", f"{tmp}/{n}")
    with open(tmp + "/contacts.txt", "w") as f:
        f.write("Z@x.com\n")
    assert batch("3", [("c", "x@x.com", "t1", ["INBOX"]), ("a", "x@x.com", "t9", ["INBOX"]), ("d", "z@x.com", "t4", ["INBOX"]),
                       ("e", "w@x.com", "t5", ["INBOX"]), ("f", "v@x.com", None, ["INBOX"])]) == ["a", "b", "e", "f"]


def test_unreachable_inputs_fail(spark):
    assert L.read_contacts(spark, "/nowhere/contacts.txt").count() == 0                  # proven missing
    for path in ("nosuchscheme://x/contacts.txt", "hdfs://127.0.0.1:1/contacts.txt"):
        spark.sparkContext._jsc.hadoopConfiguration().set("ipc.client.connect.max.retries", "0")
        try:
            L.read_contacts(spark, path).count()
            raise AssertionError("an unreachable contact list must fail")
        except AssertionError:
            raise
        except Exception:  # noqa: BLE001
            pass


def test_keep_rule_fragments():
    f = L._fragment('from:(a@b.com OR shop.com) subject:"order 66" older_than:1y -is:starred label:Receipts -category:promotions is:read')
    assert f == {"from_any": ("a@b.com", "shop.com"), "subject_any": ("order 66",), "older_than": "1y", "starred": False,
                 "label_any": ("Receipts",), "category_none": ("promotions",), "unread": False}
    for bad in ("", "has:nothing", "from:a@b.com larger words", "-from:a@b.com"):
        try:
            L._fragment(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_retention_run_from_mbox_files_to_new_table(spark):
    from mailspark.operators import rules as R
    tmp = tempfile.mkdtemp(prefix="retention-")
    head = "From x Mon Jan 01 00:00:00 2024\nDate: Sat, 01 Jan 2022 00:00:00 +0000\nMessage-ID: <{}>\nFrom: <{}>\nSubject: s\nX-Gmail-Labels: {}\n\nb\n"
    with open(tmp + "/a.mbox", "w") as f:
        f.write(head.format("p1", "ads@shop.com", "Category Promotions,Unread") + head.format("p2", "friend@x.com", "Category Promotions,Unread"))
    with open(tmp + "/b.mbox", "w") as f:                                  # the same offset, protected by its flags
        f.write(head.format("k1", "boss@x.com", "Category Promotions,Unread,Starred,Important"))
    m = P.read_parsed(spark, tmp)
    assert {r.mbox_offset for r in m.where("message_id IN ('p1', 'k1')").collect()} == {0}
    contacts = spark.createDataFrame([(" Friend@X.com ",)], "email string")
    out = tempfile.mkdtemp(prefix="retention-out-")
    table = VersionedTable(spark, out + "/t").create(m)
    args = (table, "prune", R.STANDING_RULES, 1704067200, out + "/runs", "p1", "2024-01-01T00:00:00Z", contacts)
    R.retention_run(*args, dry_run=True).collect()
    assert os.listdir(out) == ["t"] and table.versions() == [0]
    s = R.retention_run(*args).collect()
    assert [(r.category, r.moved, r.skipped, r.failed) for r in s] == [("Old promotions", 1, 1, 0)]
    t = {r.message_id: r for r in table.read().collect()}
    assert len(t) == 3 and {k for k, r in t.items() if r.in_trash} == {"p1"} and "Audit/Pruned/Old promotions" in t["p1"].labels
    a = spark.read.json(out + "/runs/audit").collect()
    assert [(r.message_id, r.action, r["from"]) for r in a] == [("p1", "pruned", "ads@shop.com")]
    assert spark.read.parquet(out + "/runs/summary").count() == 1


def _mail(spark, n=400):
    """Mail of 40 months; every 7th is a receipt, every 5th trash, every 50th has no id."""
    return spark.createDataFrame(
        [(f"f{i % 2}", i, None if i % 50 == 0 else f"m{i}", f"t{i}", f"a{i % 9}@shop.com", "Your invoice" if i % 7 == 0 else "news",
          1_500_000_000 + i * 250_000, "promotions", 1, 0, 0, 0, 0, int(i % 5 == 0), 10, ["Category Promotions"] + (["Trash"] if i % 5 == 0 else []))
         for i in range(n)],
        "path string, mbox_offset long, message_id string, thread_id string, from_email string, subject string, date_ts long, category string,"
        " is_unread int, is_starred int, is_important int, in_inbox int, in_sent int, in_trash int, body_size_bytes long, labels array<string>")


def _state(table):
    return {(r.path, r.mbox_offset): (r.in_trash, tuple(r.labels)) for r in table.read().collect()}


def test_retention_runs_of_each_kind_can_be_repeated(spark):
    from mailspark.operators import rules as R
    m = _mail(spark)
    contacts = spark.createDataFrame([("a3@shop.com",)], "email string")
    as_of = 1_500_000_000 + 500 * 250_000
    for kind, rules, action in (("prune", R.STANDING_RULES, "pruned"), ("rescue", R.RESCUE_RULES, "rescued"),
                                ("reference", R.REFERENCE_RULES, "labelled")):
        out = tempfile.mkdtemp(prefix=f"retention-{kind}-")
        table = VersionedTable(spark, out + "/t").create(m)
        args = (table, kind, rules, as_of, out + "/runs", "r1", "2024-01-01T00:00:00Z", contacts)
        first = R.retention_run(*args).collect()
        audit = sorted(map(str, spark.read.json(out + "/runs/audit").collect()))
        want = {(r.path, r.mbox_offset): (r.in_trash, tuple(r.labels)) for r in
                R.apply_actions(m, R.decide(m, kind, rules, as_of, contacts), kind).collect()}
        assert _state(table) == want and sum(r.moved for r in first) == len(audit) > 10
        assert {r.action for r in spark.read.json(out + "/runs/audit").collect()} == {action}
        # the same run again, also as if it had stopped before its version was added
        assert R.retention_run(*args).collect() == first and table.versions() == [0, 1]
        os.remove(out + "/t/versions/1")
        assert R.retention_run(*args).collect() == first
        assert sorted(map(str, spark.read.json(out + "/runs/audit").collect())) == audit and _state(table) == want
        # another run finds nothing left to move
        again = R.retention_run(table, kind, rules, as_of, out + "/runs", "r2", "2024-01-02T00:00:00Z", contacts).collect()
        assert sum(r.moved for r in again) == 0 and _state(table) == want
        assert sorted(str(r) for r in spark.read.json(out + "/runs/audit").drop("run").collect()) == \
            sorted(str(r) for r in spark.read.json(out + "/runs/audit/run=r1").collect())


def test_mail_that_is_gone_when_the_run_applies_has_failed(spark):
    from mailspark.operators import rules as R
    m = _mail(spark)
    out = tempfile.mkdtemp(prefix="retention-failed-")
    as_of = 1_500_000_000 + 500 * 250_000
    table = VersionedTable(spark, out + "/t").create(m.where("mbox_offset <> 8 AND mbox_offset <> 50"))
    R.decide(m, "prune", R.STANDING_RULES, as_of, m.select(F.lit("x").alias("email")).limit(0)).write.parquet(out + "/runs/decisions/run=r")
    s = R.retention_run(table, "prune", R.STANDING_RULES, as_of, out + "/runs", "r", "2024-01-01T00:00:00Z").collect()
    assert sum(r.failed for r in s) == 1 and sum(r.moved for r in s) == spark.read.json(out + "/runs/audit").count()
    assert spark.read.json(out + "/runs/audit").where("message_id = 'm8'").count() == 0


def test_only_files_with_hits_are_rewritten(spark):
    from mailspark.operators import rules as R
    out = tempfile.mkdtemp(prefix="versions-")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = VersionedTable(spark, out + "/t").create(_mail(spark))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    before = set(table.files())
    assert len(before) >= 4
    hit = table.read().orderBy("date_ts").limit(3).withColumn("category", F.lit("c"))
    own = {table._relative(r[0]) for r in table.located(hit.select("path", "mbox_offset")).select("_file").collect()}
    assert R.apply_by_file(table, hit, "prune") == 1
    after = set(table.files())
    assert before - after == own and len(own) < len(before) and len(after - before) >= 1
    assert table.read().count() == table.read(0).count() == 400
    changed = table.read().where(F.array_contains("labels", "Audit/Pruned/c"))
    assert sorted(r.mbox_offset for r in changed.collect()) == [0, 1, 2]
    # a run that stops while it writes: the data folder is there, the version is not
    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop
    real, state = table._add, _state(table)
    table._add = stop
    try:
        R.apply_by_file(table, hit, "rescue")
        raise AssertionError("must stop")
    except Stop:
        pass
    table._add = real
    assert table.versions() == [0, 1] and _state(table) == state
    # two writers of one version: the later one fails and changes nothing
    other = VersionedTable(spark, out + "/t")
    real_manifest = other._manifest
    other.versions = lambda: [0]
    try:
        other.rewrite([], lambda df: df)
        raise AssertionError("must conflict")
    except VersionConflict:
        assert real_manifest(1) and _state(table) == state
