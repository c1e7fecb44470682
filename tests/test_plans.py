"""Plan checks: no cartesian / nested-loop joins, pruning and pushdown reach the scan."""
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from mailspark import fixtures as fx
from mailspark.operators import messages as M
from mailspark.plans import catalog
from mailspark.sources import parse as P

SF_SMALL = "/root/testdata/sf0.001"


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = executed(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_column_pruning_in_view(spark):
    plan = M.by_hour_of_day(fx.messages(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    orders = next(ln for ln in plan.split("\n") if "FileScan parquet" in ln and "orders.parquet" in ln).split("ReadSchema:")[1]
    assert "o_orderdate" in orders and "o_totalprice" not in orders and "o_orderpriority" not in orders


def test_stored_layout_prunes_partitions_and_pushes_dates(spark):
    out = tempfile.mkdtemp(prefix="msgs-") + "/messages"
    m = fx.messages(spark, SF_SMALL).withColumn("path", F.lit("x")).withColumn("mbox_size", F.lit(1))
    P.write_messages(m.where("year IS NOT NULL"), out, "overwrite")
    t = spark.read.parquet(out)
    q = M.by_month(t.where((F.col("year") == 2000) & (F.col("date_ts") > 950000000)))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    assert "PushedFilters: [IsNotNull(date_ts), GreaterThan(date_ts,950000000)" in plan
    scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln][0]
    assert "body_size_bytes" not in scan.split("ReadSchema:")[1]        # only the needed columns are read
    assert q.count() > 0


@pytest.mark.parametrize("name", ["vote", "disagreeing_keys", "disagreement_rate", "ensemble_verdict", "minority_votes", "outlier_by_model",
                                  "top_senders", "storage_by_sender", "unread_by_sender", "busiest_threads", "one_way_threads",
                                  "upsert_classifications", "latest_corrections", "audit_near_misses", "rule_vote"])
def test_no_sort_aggregate(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_bounded_sorts_keep_order(spark):
    rows = M.by_month(fx.messages(spark, SF_SMALL)).collect()
    months = [r.year_month for r in rows]
    assert months == sorted(months, reverse=True) and len(months) > 10
    hours = [r.hour_utc for r in M.by_hour_of_day(fx.messages(spark, SF_SMALL)).collect()]
    assert hours == sorted(hours)


def test_prune_joins_contacts_and_threads_on_their_keys(spark):
    plan = executed(E.queries()["prune"](spark, SF_SMALL))
    joins = [ln for ln in plan.split("\n") if "Join" in ln and "LeftOuter" in ln]
    assert any("_contact" in ln for ln in joins) and any("_thread" in ln for ln in joins)
    # NULL keys are replaced before the join, so none of them meet in one task
    assert all("coalesce" in ln or "_nondeterministic" in ln for ln in joins)


def test_a_lookup_reads_its_tokens_buckets(spark):
    from mailspark.operators import search as SE
    index = SE.StoredIndex(spark, tempfile.mkdtemp(prefix="idx-") + "/index")
    idx = SE.build_index(fx.table(spark, SF_SMALL, "documents"), "doc_id", ["text"])
    index.add(idx, "all")
    hits = SE.search_keys(index, "the of", "doc_id")
    plan = executed(hits)
    scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "index" in ln][0]
    buckets = sorted({r[0] for t in ("the", "of") for r in spark.range(1).select(SE.StoredIndex.bucket(F.lit(t))).collect()})
    assert "PartitionFilters: [" + (f"bucket#" if len(buckets) > 1 else "isnotnull(bucket") in scan
    assert " IN (" + ",".join(map(str, buckets)) in scan or "In(token, [of,the])" in scan
    assert "In(token, [of,the])" in scan.split("PushedFilters:")[1]
    files = [f for f in index.postings(["the", "of"]).inputFiles()]
    assert files and hits.count() == SE.search_keys(idx, "the of", "doc_id").count() > 0


def test_more_mail_adds_blocks_only(spark, monkeypatch):
    """Additions leave the other files alone, a repeated or stopped one counts once, merging changes no answer."""
    import os

    from mailspark.operators import search as SE
    monkeypatch.setattr(SE.StoredIndex, "MERGE", 4)
    root = tempfile.mkdtemp(prefix="idx-") + "/index"
    index = SE.StoredIndex(spark, root)
    docs = fx.table(spark, SF_SMALL, "documents")

    def files():
        return {os.path.join(d, f) for d, _, own in os.walk(root) for f in own if f.endswith(".parquet")}
    seen = set()
    for n in range(3):
        part = SE.build_index(docs.where(F.col("doc_id") % 5 == n), "doc_id", ["text"])
        index.add(part, f"b{n}")
        assert seen < files()
        seen = files()
    index.add(part, "b2")
    whole = SE.build_index(docs.where(F.col("doc_id") % 5 < 3), "doc_id", ["text"])

    def found(i):
        return sorted(r[0] for r in SE.search_keys(i, "the of", "doc_id").collect())
    assert found(index) == found(whole) != []
    # stopped between the merge and the removal of what it has merged
    real = index._fs

    class Stop(Exception):
        pass

    class Stopping:
        def __getattr__(self, name):
            return getattr(real, name)

        def delete(self, *_):
            raise Stop
    index._fs = Stopping()
    try:
        index.add(SE.build_index(docs.where(F.col("doc_id") % 5 == 3), "doc_id", ["text"]), "b3")
        raise AssertionError("must stop")
    except Stop:
        pass
    index._fs = real
    assert [n[0] for n in index.additions()] == ["1"]
    assert found(index) == found(SE.build_index(docs.where(F.col("doc_id") % 5 < 4), "doc_id", ["text"]))
    assert SE.search_keys(index, " ?! ", "doc_id").count() == 0


def test_an_index_counts_the_rows_of_a_key_together_and_stores_lists(spark, monkeypatch):
    """Postings equal those of the column functions, also where keys repeat or are null; a stored row holds many."""
    from mailspark.operators import search as SE
    monkeypatch.setattr(SE, "PACKED", 40)
    rows = [(k, t) for k in (None, 1, 2, 3) for t in ("År år år Ó_b a2½ 中文", "", None, "the THE of", " ́ ")] * 3
    df = spark.createDataFrame(rows + [(n, f"the of w{n}") for n in range(4, 60)], "k long, text string")
    plain = (df.select("k", F.explode(SE.tokens(F.col("text"))).alias("token")).groupBy("token", "k").agg(F.count("*").alias("tf")))
    index = SE.build_index(df, "k", ["text"])
    assert sorted(map(repr, index.select("token", "k", "tf").collect())) == sorted(map(repr, plain.collect()))
    packed = SE.build_index(df, "k", ["text"], packed=True)
    assert dict(packed.dtypes)["k"] == "array<bigint>" and packed.count() < index.count()
    stored = SE.StoredIndex(spark, tempfile.mkdtemp(prefix="idx-") + "/index")
    stored.add(packed, "all")
    assert sorted(map(repr, stored.postings(["the", "ar"]).select("token", "k", "tf").collect())) == \
        sorted(map(repr, plain.where("token in ('the', 'ar')").collect()))


def test_a_stored_index_is_packed_where_its_texts_are(spark, monkeypatch):
    """Texts are not shuffled for it, a posting takes a few bytes, and lookups sum what blocks and additions have of a key."""
    from mailspark.operators import search as SE
    monkeypatch.setattr(SE, "PACKED", 500)
    rows = [(f"box{n % 4}" if n % 50 else None, n // 8 if n % 60 else None, f"the of år w{n} 中文 the") for n in range(4000)]
    df = spark.createDataFrame(rows + rows[:700], "p string, k long, text string").repartition(6)
    plain = (df.select("p", "k", F.explode(SE.tokens(F.col("text"))).alias("token"))
               .groupBy("token", "p", "k").agg(F.count("*").alias("tf")))
    blocks = SE.build_index(df, ("p", "k"), ["text"], packed="blocks")
    plan = executed(blocks)
    assert plan.count("Exchange") == executed(df).count("Exchange") == 1 and "Sort" not in plan
    toks = ["the", "ar", "中文", "w7", "w3999", "absent"]
    want = sorted(map(repr, plain.where(F.col("token").isin(toks)).collect()))
    for postings in (blocks, SE.build_index(df, ("p", "k"), ["text"])):
        stored = SE.StoredIndex(spark, tempfile.mkdtemp(prefix="idx-") + "/index")
        stored.add(postings, "all")
        lists = spark.read.parquet(stored.path + "/0-all").where("token = 'the'")
        assert lists.agg(F.sum(F.length("postings"))).first()[0] < 16 * plain.where("token = 'the'").count()
        assert sorted(map(repr, stored.postings(toks).select("token", "p", "k", "tf").collect())) == want
    part = df.where("k % 2 = 0 or k is null")
    halves = SE.StoredIndex(spark, tempfile.mkdtemp(prefix="idx-") + "/index")
    monkeypatch.setattr(SE.StoredIndex, "MERGE", 2)
    halves.add(SE.build_index(part, ("p", "k"), ["text"], packed="blocks"), "a")
    halves.add(SE.build_index(df.where("k % 2 = 1"), ("p", "k"), ["text"], packed="blocks"), "b")
    assert [n[0] for n in halves.additions()] == ["1"]
    assert sorted(map(repr, halves.postings(toks).select("token", "p", "k", "tf").collect())) == want


def test_posting_lists_are_read_as_written():
    """Nulls, negative and largest numbers, long and empty texts, dates; also no posting at all."""
    import datetime

    import numpy as np
    import pyarrow as pa
    from mailspark.operators import posting_bytes as PB
    tf = np.array([1, 1, 300, 70000, 1, 2], np.int64)
    own = [pa.array(["a", "a", "", None, "é" * 200, "a"]), pa.array([5, -1, 2 ** 63 - 1, -2 ** 63, None, None], pa.int64()),
           pa.array([datetime.date(2001, 1, d) for d in range(1, 7)]), pa.array([True, None, False, True, True, False]),
           pa.array([0.1, -0.0, None, 1e300, 2.0, 3.0])]
    for first in ([0], [0, 1], [0, 3, 4, 5], range(6)):
        lists = PB.written(np.array(first, np.int64), tf, own)
        got = [PB.read(x, [c.type for c in own]) for x in lists.to_pylist()]
        assert np.concatenate([t for t, _ in got]).tolist() == tf.tolist()
        for i, c in enumerate(own):
            assert [v for _, cols in got for v in cols[i].to_pylist()] == c.to_pylist()
    assert len(PB.written(np.zeros(0, np.int64), tf[:0], [c[:0] for c in own])) == 0
