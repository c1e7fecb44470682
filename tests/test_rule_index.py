"""Rules as rows: the same claims as the CASE chain, for files and for thousands of rules."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from mailspark.functions.predicates import Rule, cutoff_epoch
from mailspark.operators import rule_index as RI
from mailspark.operators import rules as R
from mailspark.sources import lists as L

AS_OF = 1_700_000_000
SCHEMA = ("path string, mbox_offset long, message_id string, thread_id string, from_email string, subject string, date_ts long, category string,"
          " is_unread int, is_starred int, is_important int, in_inbox int, in_sent int, in_trash int, body_size_bytes long, labels array<string>")
WORDS = ["Invoice", "re-order", "straße", "délivered", "out", "of", "office", "№5", "policy", "x"]
SENDERS = ["a@shop.example.com", "News@B.example.org", "c@example.com", None, "plain", "we.ird", "d.e@sub.c.net", "a@b@c.net"]


def _mail(spark, n, rng, senders=SENDERS, words=WORDS):
    rows = [(f"f{i % 2}", i, f"m{i}", f"t{i}", rng.choice(senders), rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 5)))]),
             rng.choice([None, AS_OF - rng.randint(0, 900) * 86400]), rng.choice(["promotions", "Updates", None, "primary"]),
             rng.choice([0, 1, None]), rng.choice([0, 0, 1]), rng.choice([0, 0, 1]), rng.choice([0, 1]), rng.choice([0, 0, 1]), rng.choice([0, 0, 1]),
             rng.choice([None, 10, 10 ** 7]), rng.choice([None, [], ["Work"], ["Reference"], ["Chats", "Inbox"], ["Category Updates"]]))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def _rule(rng, i):
    own = {}
    if rng.random() < 0.6:
        own["from_any"] = tuple(rng.sample(["a@shop.example.com", "example.com", "ORG", "b.example.org", "c.net", "plain", "ird", "nobody.test"], rng.randint(1, 3)))
    if rng.random() < 0.6:
        own["subject_any"] = tuple(rng.sample(["invoice", "Out of Office", "re-order", "STRASSE", "straße", "№5", "office", "!!", "délivered"], rng.randint(1, 2)))
    for field, values in (("category_any", [("promotions",), ("UPDATES", "x")]), ("category_none", [("primary",)]), ("older_than", ["6m", "1y", "30d"]),
                          ("newer_than", ["1y", "400d"]), ("unread", [True, False]), ("in_trash", [True, False]), ("in_inbox", [True, False]),
                          ("not_starred", [True]), ("not_important", [True]), ("not_reference", [True]), ("not_sent", [True]), ("not_chats", [True]),
                          ("no_user_labels", [True]), ("subject_none", [("policy",), ("x", "of")]), ("smaller_than", [1000]), ("starred", [True, False]),
                          ("important", [False]), ("sent", [False]), ("chats", [False]), ("label_any", [("Work",)]), ("label_none", [("Work", "Inbox")])):
        if rng.random() < 0.12:
            own[field] = rng.choice(values)
    return Rule(f"rule {i} \\ \"q\"", **own)


def _claims(df):
    return sorted((r.path, r.mbox_offset, r.rule_no, r.category) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_chain(spark, seed):
    """Every field, odd senders, nulls: the chain's claims, rule by rule order."""
    rng = random.Random(seed)
    _, m = _mail(spark, 250, rng)
    rules = [_rule(rng, i) for i in range(60)]
    got = RI.match_rule_table(m, RI.rule_rows(spark, rules).repartition(5), AS_OF)
    want = _claims(R.match_rules(m, rules, AS_OF))
    assert _claims(got) == want and len({w[2] for w in want}) > 8


def test_each_rule_alone(spark):
    """A rule that an earlier one hides in a cascade is checked too."""
    rng = random.Random(9)
    _, m = _mail(spark, 120, rng)
    for i in range(8):
        rules = [_rule(rng, i) for _ in range(1)]
        assert _claims(RI.match_rule_table(m, RI.rule_rows(spark, rules), AS_OF)) == _claims(R.match_rules(m, rules, AS_OF))


def test_ten_thousand_rules(spark):
    """More rules than a CASE chain can hold; checked in Python, and joined, not looped over."""
    rng = random.Random(4)
    senders = [f"u{i}@d{i % 700}.example.com" for i in range(3000)]
    words = [f"w{i}" for i in range(3000)]
    rows, m = _mail(spark, 1500, rng, senders, words)
    rules = [Rule(f"r{i}", older_than="6m", not_starred=True, **({"from_any": (f"u{i}@d{i % 700}.example.com",)} if i % 3 == 0 else
             {"from_any": (f"d{i}.example.com",)} if i % 3 == 1 else {"subject_any": (f"w{i % 4000} w{(i * 7) % 3000}", f"w{i}")})) for i in range(10_000)]
    old = cutoff_epoch(AS_OF, "6m")
    index = {}
    for n, r in enumerate(rules, start=1):
        for t in (*r.from_any, *r.subject_any):
            index.setdefault(t, n)
    want = []
    for row in rows:
        path, at, sender, subject, date, starred = row[0], row[1], row[4], row[5] or "", row[6], row[9]
        if date is None or date >= old or starred:
            continue
        w = subject.lower().split(" ")
        keys = [sender, sender.split("@")[1], *w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
        hits = [index[k] for k in keys if k in index]
        if hits:
            want.append((path, at, min(hits), f"r{min(hits) - 1}"))
    got = RI.match_rule_table(m, RI.rule_rows(spark, rules), AS_OF)
    assert _claims(got) == sorted(want) and len(want) > 250
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "r9000" not in plan


def test_rule_files_as_rows(spark):
    tmp = tempfile.mkdtemp(prefix="rules-")
    with open(tmp + "/industry.tsv", "w") as f:
        f.write("# comment\nCarriers\ttrack@ups.example example.com\nno tab\nPress\tb.example.org  c.net\nEmpty\t\n")
    with open(tmp + "/keep.tsv", "w") as f:
        f.write("Bills\tsubject:(invoice OR \"out of office\") older_than:1y\nFriends\tfrom:c@example.com -is:starred\nStars\tis:starred category:updates\n")
    rng = random.Random(2)
    _, m = _mail(spark, 300, rng)
    chain = R.industry_rules(L.industry_rows(spark, tmp + "/industry.tsv"))
    rows = RI.numbered(L.industry_rule_rows(spark, tmp + "/industry.tsv"), in_inbox=True, older_than="6m", not_starred=True, in_trash=False)
    assert [(r.rule_no, r.name) for r in rows.orderBy("rule_no").collect()] == [(1, "Carriers"), (2, "Press")]
    assert _claims(RI.match_rule_table(m, rows, AS_OF)) == _claims(R.match_rules(m, chain, AS_OF)) != []
    for mode, common in (("rescue", {"in_trash": True}), ("reference", {"not_reference": True, "in_trash": False})):
        chain = L.keep_rules(spark, tmp + "/keep.tsv", mode)
        rows = RI.numbered(L.keep_rule_rows(spark, tmp + "/keep.tsv"), first=5, **common)
        got = [(p, o, n - 4, c) for p, o, n, c in _claims(RI.match_rule_table(m, rows, AS_OF))]
        assert got == _claims(R.match_rules(m, chain, AS_OF)) != []


def test_too_many_broad_rules(spark):
    _, m = _mail(spark, 5, random.Random(1))
    with pytest.raises(ValueError):
        RI.match_rule_table(m, RI.rule_rows(spark, [Rule(f"r{i}", unread=True) for i in range(RI.MOST_BROAD + 1)]), AS_OF)


def test_noisy_lines_are_ranked_without_one_task(spark):
    """Ordinals of the cascade over many lines, from ranges of lines."""
    lines = [(f"s{i}@x.com" if i % 4 else "d%d.com" % i, [] if i % 5 == 0 else [f"k{i}"], i * 3) for i in range(400)]
    noisy = spark.createDataFrame(lines, "address string, exclude_keywords array<string>, line_no long").repartition(7)
    t = R.noisy_table(noisy)
    got = {r.address: r.noisy_no for r in t.collect()}
    excluded = [a for a, k, _ in lines if k]
    assert got == {**{a: 1 for a, k, _ in lines if not k}, **{a: 2 + i for i, a in enumerate(excluded)}}
    assert "SinglePartition" not in t._jdf.queryExecution().executedPlan().toString()
    only = R.noisy_table(noisy.where(F.size("exclude_keywords") > 0))
    assert {r.address: r.noisy_no for r in only.collect()} == {a: 1 + i for i, a in enumerate(excluded)}
