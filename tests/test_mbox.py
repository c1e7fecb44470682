"""mbox source (S1), parse job (S2 / X*), dedup (K1), streaming ingest (St1)."""
import base64
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mailspark.sources import mbox as MB
from mailspark.sources import parse as P

MSG = """From 1234@xxx Mon Jan 01 00:00:00 +0000 2024
From: {frm}
To: bob@example.com
Subject: {subj}
Date: {date}
Message-ID: <{mid}>
X-Gmail-Labels: {labels}
X-Gmail-Thread-ID: {thread}

{body}
"""


def _write(tmp, name, msgs, prefix=b""):
    p = os.path.join(tmp, name)
    with open(p, "wb") as f:
        f.write(prefix)
        for m in msgs:
            f.write(m.encode())
    return p


def _msgs(n):
    out = []
    for i in range(n):
        body = "\n".join(f"line {j} of message {i}" for j in range(i % 7))
        if i % 5 == 0:
            body += "\n>From the escaped line\nFrom\n"
        out.append(MSG.format(frm=f"Alice {i} <Alice{i}@Example.com>", subj=f"=?utf-8?b?{base64.b64encode(f'Hello {i}'.encode()).decode()}?=",
                              date="Mon, 01 Jan 2024 10:00:00 +0000" if i % 4 else "garbage",
                              mid=f"id{i % 17}@example.com", labels="Inbox, Unread,Important" if i % 2 else "",
                              thread=f"t{i % 9}", body=body))
    return out


@pytest.fixture(scope="module")
def mbox_file():
    tmp = tempfile.mkdtemp(prefix="mbox-test-")
    return _write(tmp, "a.mbox", _msgs(60), prefix=b"junk before the first envelope\n")


def _rows(spark, path, split):
    df = MB.read_mbox(spark, path, split_size=split)
    return sorted((r.mbox_offset, r.mbox_size, bytes(r.raw)) for r in df.collect())


def test_split_invariance(spark, mbox_file):
    size = os.path.getsize(mbox_file)
    base = _rows(spark, mbox_file, size + 1)
    for parts in (2, 7, 40, 400):
        assert _rows(spark, mbox_file, max(1, size // parts)) == base
    # bytes concatenate back to the file; first row is the junk prefix at offset 0
    with open(mbox_file, "rb") as f:
        assert b"".join(r[2] for r in base) == f.read()
    assert base[0][0] == 0 and base[0][2].startswith(b"junk")
    assert len(base) == 61


def test_parse_columns(spark, mbox_file):
    parsed = P.parse_messages(MB.read_mbox(spark, mbox_file, 4096))
    good, bad = P.split_parsed(parsed)
    rows = {r.mbox_offset: r for r in good.collect()}
    first_real = sorted(rows)[1]
    r = rows[first_real]
    assert r.from_email == "alice0@example.com" and r.from_name == "Alice 0"
    assert r.subject == "Hello 0"
    assert r.message_id == "id0@example.com"
    assert r.thread_id == "t0"
    assert r.date_ts is None and r.year is None          # 'garbage' date
    r1 = rows[sorted(rows)[2]]
    assert r1.labels == ["Inbox", "Unread", "Important"]
    assert (r1.in_inbox, r1.is_unread, r1.is_important, r1.is_starred) == (1, 1, 1, 0)
    assert r1.date_ts == 1704103200 and r1.year == 2024 and r1.year_month == "2024-01"
    assert bad.count() == 0


def test_minimal_and_two_messages(spark):
    tmp = tempfile.mkdtemp(prefix="mbox-min-")
    p = _write(tmp, "m.mbox", ["From x@y Mon Jan 1 00:00:00 2024\nFrom: Alice <alice@example.com>\n"
                               "Subject: Hi\nMessage-ID: <abc123@example.com>\n\nbody\n",
                               "From x@y Mon Jan 1 00:00:00 2024\nFrom: b@x\n\nsecond\n"])
    rows = P.parse_messages(MB.read_mbox(spark, p)).orderBy("mbox_offset").collect()
    assert len(rows) == 2 and rows[0].mbox_offset == 0
    assert rows[0].from_email == "alice@example.com" and rows[0].message_id == "abc123@example.com"
    assert rows[0].body_text.strip() == "body"


def test_header_words_and_dates():
    assert P.header_text("=?iso-8859-1?q?Caf=E9_au?= =?ISO-8859-1?Q?_lait?= !") == "Caf\u00e9 au lait !"
    assert P.header_text("=?utf-8?b?w6k=?=\n =?x-unknown?q?=E9?= tail") == "\u00e9\u00e9 tail"      # unknown charset: latin-1
    assert P.header_text("=?utf-8?b?4p?= =?utf-8?q?=E2=82?==?utf-8?q?=AC?=").endswith("\u20ac")        # a sign cut in two words
    assert P.header_text("=?utf-8?q?=FF?=") == "\ufffd" and P.header_text(None) == "" and P.header_text("  plain  ") == "plain"
    assert P.epoch("Tue, 02 Jan 2024 00:00:00") == 1704153600 and P.epoch("Tue, 02 Jan 2024 02:00:00 +0200") == 1704153600
    assert P.epoch("Tue, 99 Jan 2024 00:00:00 +0000") is None and P.epoch(None) is None


def test_label_array(spark):
    df = spark.createDataFrame([("Work,, Trash ,Category Social",), ("",), (" , ",), (None,)], "raw string")
    assert [r[0] for r in df.select(P.label_array(F.col("raw"))).collect()] == [["Work", "Trash", "Category Social"], None, None, None]


MULTI = """From m@x Mon Jan 01 00:00:00 +0000 2024
From: "Doe, J" <J@Doe.example>
Received: one
Received: two
X-Gmail-Labels: Category Promotions,=?utf-8?q?Caf=C3=A9?=
Content-Type: multipart/mixed; boundary="B"

--B
Content-Type: text/plain; charset=iso-8859-1
Content-Disposition: attachment; filename="=?utf-8?q?caf=C3=A9.txt?="

not the body
--B
Content-Type: application/pdf
Content-Disposition: attachment

x
--B
Content-Type: text/html; name="page.html"

<p>no</p>
--B
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

gar=E7on
--B--
"""


def test_multipart_body_attachments_and_headers(spark):
    tmp = tempfile.mkdtemp(prefix="mbox-multi-")
    p = _write(tmp, "m.mbox", [MULTI])
    for df in (P.parse_messages(MB.read_mbox(spark, p)), P.read_parsed(spark, p)):
        r = df.first()
        assert r.body_text.strip() == "gar\u00e7on" and r.content_type == "multipart/mixed"
        assert r.attachment_names == ["caf\u00e9.txt", "[application/pdf]", "page.html"] and r.has_attachments == 1
        assert r.headers["received"] == ["one", "two"] and (r.from_name, r.from_email) == ("Doe, J", "j@doe.example")
        assert r.labels == ["Category Promotions", "Caf\u00e9"] and r.category == "promotions"
    short = P.parse_messages(MB.read_mbox(spark, p), max_body_kb=0).first()
    assert short.body_text is None


def test_a_range_reads_no_further_than_it_must(monkeypatch):
    tmp = tempfile.mkdtemp(prefix="mbox-range-")
    p = os.path.join(tmp, "one.mbox")
    with open(p, "wb") as f:
        f.write(b"From a@b Mon Jan 01 00:00:00 2024\n\n" + b"x" * (6 << 20) + b"\n" + (b"y" * 99 + b"\n") * 100_000)
    monkeypatch.setattr(MB, "BLOCK", 1 << 16)
    read = [0]

    class Counting(MB._Lines):
        def __init__(self, f, pos):
            super().__init__(f, pos)
            inner = self.f

            class File:
                def read(self, n):
                    data = inner.read(n)
                    read[0] += len(data)
                    return data
            self.f = File()
    monkeypatch.setattr(MB, "_Lines", Counting)
    assert list(MB.read_range(p, 1 << 20, 2 << 20)) == []                  # inside the endless line
    assert list(MB.read_range(p, 8 << 20, 9 << 20)) == []
    assert read[0] <= 2 * ((1 << 20) + (1 << 17))


def test_a_new_export_under_the_old_name_loses_no_mail(spark):
    from mailspark.streaming.ingest import ingest_files
    tmp, out = tempfile.mkdtemp(prefix="mbox-re-"), tempfile.mkdtemp(prefix="mbox-re-out-")
    one = "From a Mon Jan 01 00:00:00 2024\nMessage-ID: <{}>\n\nbody {}\n"
    bare = "From a Mon Jan 01 00:00:00 2024\nSubject: {}\n\nno id\n"
    _write(tmp, "a.mbox", [bare.format("b1"), one.format("old1", 1)])
    assert ingest_files(spark, tmp, out + "/t", out + "/l")["new"] == 2
    _write(tmp, "a.mbox", [bare.format("b2 longer"), one.format("new1", 1), one.format("new2", 2), one.format("old1", 1)])
    assert ingest_files(spark, tmp, out + "/t", out + "/l")["new"] == 3
    got = {r.message_id or r.subject for r in spark.read.parquet(out + "/t").collect()}
    assert got == {"b1", "b2 longer", "old1", "new1", "new2"}


def test_ingest_in_waves_resumes_from_the_ledger(spark, mbox_file):
    from mailspark.streaming.ingest import ingest_files
    out = tempfile.mkdtemp(prefix="ingest-waves-")
    src, size = os.path.dirname(mbox_file), os.path.getsize(mbox_file)
    whole = ingest_files(spark, src, out + "/t", out + "/l", wave_bytes=size // 3)
    led = spark.read.parquet(out + "/l")
    assert led.count() >= 3 and led.where("completed_at IS NULL").count() == led.count() - 1
    assert whole["seen"] == 61 and led.agg(F.max("messages_imported"), F.max("messages_new")).first()[:] == (61, whole["new"])
    # a run that stopped after its first wave: the next takes up the rest only
    first = led.orderBy("id").first()
    out2 = tempfile.mkdtemp(prefix="ingest-resume-")
    led.where(F.col("id") == first.id).write.parquet(out2 + "/l")
    rest = ingest_files(spark, src, out2 + "/t", out2 + "/l")
    assert rest["seen"] == 61 - first.messages_imported
    assert P.resume_offsets(spark.read.parquet(out2 + "/l")).count() == 0


def test_stream_by_default_gives_the_last_message(spark):
    from mailspark.streaming.ingest import ingest_stream
    tmp, out = tempfile.mkdtemp(prefix="mbox-tail-"), tempfile.mkdtemp(prefix="mbox-tail-out-")
    for n in ("a", "b"):
        _write(tmp, n + ".mbox", [f"From x Mon Jan 01 00:00:00 2024\nMessage-ID: <{n}>\n\nbody\n"])
    q = ingest_stream(spark, tmp, out + "/t", out + "/ck")
    for _ in range(3):
        q.processAllAvailable()
    q.stop()
    assert sorted(r.message_id for r in spark.read.parquet(out + "/t").collect()) == ["a", "b"]


def test_dedup_first_wins(spark, mbox_file):
    parsed, _ = P.split_parsed(P.parse_messages(MB.read_mbox(spark, mbox_file, 2048)))
    d = P.dedup_messages(parsed)
    rows = d.collect()
    ids = [r.message_id for r in rows if r.message_id]
    assert len(ids) == len(set(ids)) == 17
    first = {}
    for r in sorted(parsed.collect(), key=lambda r: r.mbox_offset):
        if r.message_id and r.message_id not in first:
            first[r.message_id] = r.mbox_offset
    assert {r.message_id: r.mbox_offset for r in rows if r.message_id} == first
    assert sum(1 for r in rows if r.message_id is None) == parsed.where("message_id IS NULL").count()


@pytest.mark.parametrize("parse_in_reader", [True, False])
def test_streaming_equals_batch(spark, mbox_file, parse_in_reader):
    from mailspark.streaming.ingest import ingest_stream
    out = tempfile.mkdtemp(prefix="mbox-stream-out-")
    ck = tempfile.mkdtemp(prefix="mbox-stream-ck-")
    q = ingest_stream(spark, os.path.dirname(mbox_file), out + "/t", ck, eof_complete=True,
                      parse_in_reader=parse_in_reader)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out + "/t")
    batch = P.dedup_messages(P.split_parsed(P.parse_messages(MB.read_mbox(spark, mbox_file)))[0])
    key = ["path", "mbox_offset"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in batch.select(*key).collect())


def test_dedup_within_watermark_stream(spark):
    from mailspark.streaming.ingest import dedup_within_watermark
    tmp = tempfile.mkdtemp(prefix="wm-")
    os.makedirs(tmp + "/in")
    import json as _j
    with open(tmp + "/in/a.json", "w") as f:
        for i, mid in enumerate(["a", "b", "a", "c", "b"]):
            f.write(_j.dumps({"message_id": mid, "ts": f"2024-01-01 00:00:0{i}"}) + "\n")
    s = spark.readStream.schema("message_id string, ts timestamp").json(tmp + "/in")
    q = (dedup_within_watermark(s, "ts", "1 hour").writeStream.format("memory").queryName("wm_t")
         .option("checkpointLocation", tmp + "/ck").start())
    q.processAllAvailable()
    got = sorted(r.message_id for r in spark.sql("SELECT * FROM wm_t").collect())
    q.stop()
    assert got == ["a", "b", "c"]


def test_parse_in_reader_equals_parse_job(spark, mbox_file):
    cols = ["path", "mbox_offset", "message_id", "from_email", "subject", "date_ts", "labels", "headers_json",
            "body_text", "attachment_names", "parse_error", "year_month", "in_inbox"]
    a = P.parse_messages(MB.read_mbox(spark, mbox_file, 3000)).select(*cols)
    b = P.read_parsed(spark, mbox_file, 5000).select(*cols)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_batch_ingest_is_idempotent_and_keeps_a_ledger(spark, mbox_file):
    from mailspark.operators import messages as M
    from mailspark.streaming.ingest import ingest_files
    out = tempfile.mkdtemp(prefix="ingest-")
    c1 = ingest_files(spark, os.path.dirname(mbox_file), out + "/t", out + "/ledger", out + "/q")
    c2 = ingest_files(spark, os.path.dirname(mbox_file), out + "/t", out + "/ledger", out + "/q")
    t = spark.read.parquet(out + "/t")
    ids = [r.message_id for r in t.collect() if r.message_id]
    assert len(ids) == len(set(ids)) == 17
    assert c1["new"] == t.count() and c2["new"] == 0
    assert "year" in t.columns
    ledger = P.update_ledger(spark.read.parquet(out + "/ledger").limit(0), spark.read.parquet(out + "/ledger"))
    summ = M.import_summary(ledger).collect()
    assert len(summ) == 1 and summ[0].pct_done == "100.0%" and summ[0].messages_imported == 61
