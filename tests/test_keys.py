"""The key store beside a message table, and streaming dedup with keyed state."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.sources import keys as KS
from mailspark.sources import mbox as MB
from mailspark.sources import parse as P
from mailspark.streaming import ingest as I


def _keys(spark, ids):
    return spark.createDataFrame([(f"i{i}",) for i in ids], "key string")


def test_filters_hold_all_and_little_else():
    rng = np.random.default_rng(1)
    h = rng.integers(-2 ** 63, 2 ** 63 - 1, (4, 5000))
    own = KS.make_filter(h[0], h[1])
    assert KS.may_hold(own, h[0], h[1]).all() and KS.may_hold(own, h[2], h[3]).mean() < 0.005
    assert not KS.may_hold(KS.make_filter(h[0][:0], h[1][:0]), h[2], h[3]).any()


def test_lookup_reads_only_folders_that_may_hold_a_key(spark):
    store = KS.KeyStore(spark, tempfile.mkdtemp(prefix="keys-"), buckets=8)
    for n in range(3):
        store.commit(store.write(f"b{n}", _keys(spark, range(n * 1000, n * 1000 + 1000))))
    asked = _keys(spark, [1, 1500, 999_999])
    places = sorted({(r["name"], r["bucket"]) for r in store.maybe(asked).collect()})
    assert 2 <= len(places) <= 3                               # two real ones; a filter may err
    plan = store.stored(places)._jdf.queryExecution().toString()
    files = {f.split("/keys/")[1].rsplit("/", 1)[0] for f in store.stored(places).inputFiles()}
    assert files == {f"{n}/bucket={b}" for n, b in places} and "FileScan parquet" in plan
    assert sorted(r["key"] for r in store.known(asked).collect()) == ["i1", "i1500"]
    assert store.known(_keys(spark, range(5000, 5050))).count() == 0


def test_reads_do_not_grow_with_history(spark, monkeypatch):
    """After many appends a bucket has a logarithm of filters, and a new batch still opens almost no keys."""
    monkeypatch.setattr(KS, "MERGE", 3)
    store = KS.KeyStore(spark, tempfile.mkdtemp(prefix="keys-"), buckets=2)
    for n in range(10):
        store.commit(store.write(f"b{n}", _keys(spark, range(n * 20, n * 20 + 20))))
        store.merge()
        assert len(store.batches()) <= 2 * 3
    assert sorted(x.split("-")[0] for x in store.batches()) == ["0", "2"]
    assert store.known(_keys(spark, range(0, 400))).count() == 200


def test_uncommitted_keys_are_settled(spark):
    store = KS.KeyStore(spark, tempfile.mkdtemp(prefix="keys-"), buckets=2)
    store.commit(store.write("a", _keys(spark, range(10))))
    store.write("stopped", _keys(spark, range(10, 20)))        # its rows 10 to 14 have reached the table
    assert store.known(_keys(spark, range(30))).count() == 10
    store.recover(lambda: _keys(spark, range(15)))
    assert store.known(_keys(spark, range(30))).count() == 15
    store.write("early", _keys(spark, range(40, 50)))
    store.recover(lambda: None)                                # there is no table yet
    assert store.known(_keys(spark, range(40, 50))).count() == 0 and len(store._names("keys")) == 2


MSG = "From x Mon Jan 01 00:00:00 2024\nDate: Sat, 01 Jan 2022 00:00:00 +0000\n{}From: <a@x.com>\nSubject: s{}\n\nbody {}\n"


def _mbox(folder, name, ids):
    with open(f"{folder}/{name}", "w") as f:
        for n, i in enumerate(ids):
            f.write(MSG.format("" if i is None else f"Message-ID: <{i}>\n", n, i))


def test_an_append_that_stops_is_taken_up(spark, monkeypatch):
    """Stopped after its keys, or after half of its rows: the next run adds what is missing and nothing twice."""
    src, out = tempfile.mkdtemp(prefix="mbox-"), tempfile.mkdtemp(prefix="table-") + "/t"
    _mbox(src, "a.mbox", ["m1", "m2", None, "m3", "m1", None])
    good, _ = P.split_parsed(P.read_parsed(spark, src))
    real = P.write_messages

    class Stop(Exception):
        pass

    for part in (0, 2):
        def stopped(m, path, mode="append", part=part):
            if part:
                real(m.orderBy("mbox_offset").limit(part), path, mode)
            raise Stop
        monkeypatch.setattr(P, "write_messages", stopped)
        with pytest.raises(Stop):
            I.append_new(spark, good, out, "w")
        monkeypatch.setattr(P, "write_messages", real)
    assert I.append_new(spark, good, out, "w").count() == 3     # m1, m2 were there
    assert I.append_new(spark, good, out, "w").count() == 0
    got = [r.message_id for r in spark.read.parquet(out).collect()]
    assert sorted(map(str, got)) == ["None", "None", "m1", "m2", "m3"]


def test_a_table_older_than_its_store(spark):
    src, out = tempfile.mkdtemp(prefix="mbox-"), tempfile.mkdtemp(prefix="table-") + "/t"
    _mbox(src, "a.mbox", ["m1", None])
    good, _ = P.split_parsed(P.read_parsed(spark, src))
    P.write_messages(good, out)
    _mbox(src, "b.mbox", ["m1", "m4"])
    good, _ = P.split_parsed(P.read_parsed(spark, src))
    assert [r.message_id for r in I.append_new(spark, good, out, "w").collect()] == ["m4"]
    assert spark.read.parquet(out).count() == 3


def test_first_messages_over_restarts(spark):
    """Keyed state: triggers and a restart from the checkpoint give the rows of the batch job."""
    src, tmp = tempfile.mkdtemp(prefix="parsed-"), tempfile.mkdtemp(prefix="first-")
    box = tempfile.mkdtemp(prefix="mbox-")
    for name, ids in (("a.mbox", ["m1", "m2", "m1", None]), ("b.mbox", ["m2", "m3", None]), ("c.mbox", ["m4", "m1", "m4"])):
        _mbox(box, name, ids)
    MB.register(spark)
    good, _ = P.split_parsed(P.read_parsed(spark, box))
    good = good.cache()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for n, name in enumerate(("a.mbox", "b.mbox", "c.mbox")):
        good.where(F.col("path").endswith(name)).coalesce(1).write.parquet(f"{src}/{n}")
        stream = spark.readStream.schema(good.schema).parquet(src + "/*")
        q = (I.first_messages(stream).writeStream.format("parquet").option("checkpointLocation", tmp + "/ck")
             .outputMode("append").trigger(availableNow=True).start(tmp + "/out"))
        q.awaitTermination(240)
        assert q.exception() is None
    got = sorted((os.path.basename(r.path), r.mbox_offset) for r in spark.read.parquet(tmp + "/out").collect())
    want = sorted((os.path.basename(r.path), r.mbox_offset) for r in P.dedup_messages(good).collect())
    assert got == want and len(got) == 6
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
