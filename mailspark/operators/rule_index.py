"""Rule tables of any size: messages meet the rules that can claim them by a join.

``first_match`` turns rules into one CASE chain, which is right for dozens.
Here rules are rows.  A rule that names senders is found by any of their
addresses or domains, one that names subjects by the longest word of each
phrase; these are its anchors.  A message has the keys that an anchor can
equal: its sender's address, its domain and each parent domain, and the words
of its subject.  Keys and anchors are joined, the rule's other fields are
checked on the joined row, and the first rule that is left claims the message.
Rules without an anchor ("old read mail") can't be found that way; they stay a
CASE chain, and more than ``MOST_BROAD`` of them is an error.

Senders, subjects and nulls are taken exactly as ``functions.predicates`` takes
them, so both forms claim the same messages.
"""

from __future__ import annotations

import dataclasses
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import REFERENCE_LABELS, Rule, cutoff_epoch, has_label, no_user_labels
from ..util import KEY, names
from .rules import first_match, protect, rule_name

MOST_BROAD = 200
_LISTS = ("category_any", "category_none", "from_any", "subject_any", "subject_none", "label_any", "label_none")
_FLAGS = ("unread", "in_trash", "in_inbox", "starred", "important", "sent", "chats")
_TRUE = ("not_starred", "not_important", "not_reference", "not_sent", "not_chats", "no_user_labels")
FIELDS = (", ".join(f"{c} array<string>" for c in _LISTS) + ", " + ", ".join(f"{c} boolean" for c in (*_FLAGS, *_TRUE))
          + ", older_than string, newer_than string, smaller_than long")
RULES = "rule_no long, name string, fields string"
WORDS = "[^\\p{L}\\p{N}]+"


def fields_of(rule: Rule) -> str:
    """A rule's fields as JSON, without those at their defaults."""
    own = {f.name: getattr(rule, f.name) for f in dataclasses.fields(Rule) if f.name != "name"}
    return json.dumps({k: v for k, v in own.items() if v not in (None, False, ()) or (k in _FLAGS and v is False)})


def rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules that the program itself holds, as rows."""
    return spark.createDataFrame([(i, r.name, fields_of(r)) for i, r in enumerate(rules, start=1)], RULES)


def numbered(lines: DataFrame, first: int = 1, **common) -> DataFrame:
    """Rule rows of a file's lines (line_no, name, fields), numbered from ``first`` in their order.

    common: fields that all of them have unless the line says otherwise.
    Lines are ranked in ranges; the driver learns how many a range holds.
    """
    from ..session import ensure_checkpoint_dir

    spark = lines.sparkSession
    ensure_checkpoint_dir(spark)
    t = lines.repartitionByRange("line_no").withColumn("_range", F.spark_partition_id()).checkpoint()
    before, offsets = first, []
    for r in sorted(t.groupBy("_range").count().collect()):
        offsets.append((r["_range"], before))
        before += r["count"]
    at = spark.createDataFrame(offsets, "_range int, _before long")
    own = Window.partitionBy("_range").orderBy("line_no")
    text = "map<string,string>"
    merged = F.map_zip_with(F.from_json(F.lit(json.dumps(common)), text), F.from_json("fields", text), lambda k, a, b: F.coalesce(b, a))
    parts = F.transform(F.map_entries(merged), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(
        e["value"].rlike(r"^(\[.*|true|false|-?\d+)$"), e["value"]).otherwise(F.concat(F.lit('"'), e["value"], F.lit('"')))))
    return t.join(at, "_range").select((F.row_number().over(own) + F.col("_before") - 1).cast("long").alias("rule_no"), "name",
                                       F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("fields"))


def _cutoffs(as_of_epoch: int):
    """Epoch of an age as text; ages are few, so each is worked out once a batch."""
    @F.pandas_udf("long")
    def cutoff(ages: pd.Series) -> pd.Series:
        known = {a: cutoff_epoch(as_of_epoch, a) for a in ages.dropna().unique()}
        return ages.map(known).astype("Int64")
    return cutoff


def _pattern(terms: Column) -> Column:
    """The phrases as whole words, any of them."""
    quoted = F.transform(terms, lambda w: F.concat(F.lit("\\Q"), F.replace(F.lower(w), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(terms) > 0, F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(")(?![\\p{L}\\p{N}])")))


def compiled(rules: DataFrame, as_of_epoch: int) -> DataFrame:
    """Rule rows with typed fields (null or empty: not set), patterns, date bounds and their anchors."""
    f = F.from_json("fields", FIELDS)
    lists = [F.filter(F.coalesce(f[c], F.array().cast("array<string>")), lambda x: x.isNotNull()).alias(c) for c in _LISTS]
    r = rules.select("rule_no", "name", "fields", *lists, *[f[c].alias(c) for c in _FLAGS],
                     *[F.coalesce(f[c], F.lit(False)).alias(c) for c in _TRUE], f["older_than"].alias("older_than"),
                     f["newer_than"].alias("newer_than"), f["smaller_than"].alias("smaller_than"))
    cutoff = _cutoffs(as_of_epoch)
    longest = F.transform("subject_any", lambda p: F.try_element_at(F.array_sort(
        F.filter(F.split(F.lower(p), WORDS, -1), lambda w: w != ""),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(1)))
    senders = F.transform("from_any", lambda t: F.concat(F.lit("f:"), F.lower(t)))
    words = F.when(~F.exists(longest, lambda w: w.isNull()), F.transform(longest, lambda w: F.concat(F.lit("s:"), w)))
    anchors = F.when(F.size("from_any") > 0, senders).when(F.size("subject_any") > 0, words)
    return r.select("*", cutoff("older_than").alias("_before"), cutoff("newer_than").alias("_from"),
                    F.transform("from_any", lambda t: F.lower(t)).alias("_senders"),
                    F.transform("category_any", lambda t: F.lower(t)).alias("_cats"), F.transform("category_none", lambda t: F.lower(t)).alias("_no_cats"),
                    _pattern(F.col("subject_any")).alias("_subject"), _pattern(F.col("subject_none")).alias("_no_subject"),
                    F.array_distinct(anchors).alias("_anchors"))


def _sender_keys(email: Column) -> Column:
    """What a sender term may equal: the address, its domain and each parent domain."""
    e = F.lower(email)
    has_at = F.contains(e, F.lit("@"))
    labels = F.split(F.when(has_at, F.substring_index(e, "@", -1)).otherwise(e), "\\.")
    first = F.when(has_at, 1).otherwise(2)                   # a name without '@' is no domain itself
    suffixes = F.transform(F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i >= first),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.when(has_at, F.array(e)).otherwise(F.array().cast("array<string>"))
    return F.when(email.isNotNull(), F.array_distinct(F.concat(own, suffixes))).otherwise(F.array().cast("array<string>"))


def _holds() -> Column:
    """Do the rule's fields hold on the message of this row?"""
    def is_set(c):
        return F.size(c) > 0

    def flag(c):
        return F.coalesce(F.col("m." + c), F.lit(0)) == 1
    cat, labels = F.lower(F.col("m.category")), F.coalesce(F.col("m.labels"), F.array().cast("array<string>"))
    subject = F.lower(F.col("m.subject"))
    flags = {"unread": flag("is_unread"), "in_trash": flag("in_trash"), "in_inbox": flag("in_inbox"), "starred": flag("is_starred"),
             "important": flag("is_important"), "sent": flag("in_sent"), "chats": has_label(["Chats"], "m.labels")}
    negated = {"not_starred": flag("is_starred"), "not_important": flag("is_important"), "not_sent": flag("in_sent"),
               "not_chats": has_label(["Chats"], "m.labels"), "not_reference": has_label(REFERENCE_LABELS, "m.labels"),
               "no_user_labels": ~no_user_labels("m.labels")}
    r = {c: F.col("r." + c) for c in (*_LISTS, *_FLAGS, *_TRUE, "smaller_than", "_before", "_from", "_senders", "_cats", "_no_cats",
                                      "_subject", "_no_subject")}
    conds = [~is_set(r["_cats"]) | F.coalesce(F.array_contains(r["_cats"], cat), F.lit(False)),
             ~is_set(r["_no_cats"]) | ~F.coalesce(F.array_contains(r["_no_cats"], cat), F.lit(False)),
             r["_before"].isNull() | F.coalesce(F.col("m.date_ts") < r["_before"], F.lit(False)),
             r["_from"].isNull() | F.coalesce(F.col("m.date_ts") >= r["_from"], F.lit(False)),
             ~is_set(r["_senders"]) | F.arrays_overlap(r["_senders"], F.col("m._from_keys")),
             r["_subject"].isNull() | F.coalesce(F.rlike(subject, r["_subject"]), F.lit(False)),
             r["_no_subject"].isNull() | ~F.coalesce(F.rlike(subject, r["_no_subject"]), F.lit(False)),
             ~is_set(r["label_any"]) | F.arrays_overlap(labels, r["label_any"]),
             ~is_set(r["label_none"]) | ~F.arrays_overlap(labels, r["label_none"]),
             r["smaller_than"].isNull() | F.coalesce(F.col("m.body_size_bytes") < r["smaller_than"], F.lit(False))]
    conds += [r[c].isNull() | (F.coalesce(own, F.lit(False)) == r[c]) for c, own in flags.items()]
    conds += [~r[c] | ~own for c, own in negated.items()]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def match_rule_table(m: DataFrame, rules: DataFrame, as_of_epoch: int, key=KEY) -> DataFrame:
    """The messages that a rule claims, with ``rule_no`` and ``category`` of the first one, for rules as rows."""
    own = ["message_id", "thread_id", "from_email", "subject"]
    r = compiled(rules, as_of_epoch)
    broad = r.where("_anchors IS NULL OR size(_anchors) = 0").select("rule_no", "name", "fields").limit(MOST_BROAD + 1).collect()
    if len(broad) > MOST_BROAD:
        raise ValueError(f"more than {MOST_BROAD} rules name neither a sender nor a subject")
    need = [*names(key), *own, "category", "labels", "date_ts", "body_size_bytes", "is_unread", "is_starred", "is_important",
            "in_inbox", "in_sent", "in_trash"]
    x = m.select(*need, _sender_keys(F.col("from_email")).alias("_from_keys"))
    words = F.filter(F.array_distinct(F.split(F.lower("subject"), WORDS, -1)), lambda w: w != "")
    keys = F.concat(F.transform("_from_keys", lambda k: F.concat(F.lit("f:"), k)),
                    F.coalesce(F.transform(words, lambda w: F.concat(F.lit("s:"), w)), F.array().cast("array<string>")))
    met = (x.withColumn("_key", F.explode(keys)).alias("m")
           .join(r.withColumn("_anchor", F.explode("_anchors")).drop("fields").alias("r"), F.col("m._key") == F.col("r._anchor"))
           .where(_holds()).select(*[F.col("m." + c) for c in (*names(key), *own)], F.col("r.rule_no").alias("rule_no"), F.col("r.name").alias("category")))
    if broad:
        broad = sorted(broad)
        chain = [Rule(b["name"], **{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(b["fields"]).items()}) for b in broad]
        hit = F.explode(F.array_compact(F.array(first_match(chain, as_of_epoch)))).alias("_n")
        y = m.select(*names(key), *own, hit)
        met = met.unionByName(y.select(*names(key), *own, F.element_at(F.array(*[F.lit(b["rule_no"]) for b in broad]), F.col("_n")).alias("rule_no"),
                                       rule_name(chain, F.col("_n")).alias("category")))
    first = Window.partitionBy(*names(key)).orderBy("rule_no")
    return met.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def prune_by_table(m: DataFrame, rules: DataFrame, contacts: DataFrame, as_of_epoch: int, key=KEY) -> DataFrame:
    """R1 with rules as rows: the columns of ``rules.prune``."""
    cand = match_rule_table(m, rules, as_of_epoch, key).withColumn("rule_no", F.col("rule_no").cast("int"))
    p = protect(cand.select(*names(key), "message_id", "thread_id", "from_email", "subject", "rule_no", "category"), contacts, m)
    return p.withColumn("decision", F.when(F.col("protected_by").isNull(), "prune").otherwise("skip")).drop("thread_id")
