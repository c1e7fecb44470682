"""Retention-rule operators.

The reference runs one remote search per rule and then one metadata fetch per
candidate.  Here the whole cascade is ONE scan of the messages table: the
rule predicates become a ``CASE`` chain whose value is the ordinal of the
first matching rule, so a message can only ever be claimed by one rule (the
reference gets the same effect because a trashed message fails ``-in:trash``
in later rules).  Protection is two anti/semi joins:

* contacts (J1): distinct addresses; Spark broadcasts them if their run-time
  size allows, otherwise it shuffles;
* replied threads (J2): distinct thread ids of sent mail, joined by shuffle.

NULL senders and NULL thread ids match nothing; they enter a shuffle under
keys of their own (``_spread_null``), so they never gather in one task.

A message's key is (path, mbox_offset): an offset alone is unique only inside
one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import REFERENCE_LABELS, MIB, Rule, rule_predicate, has_label
from ..session import ensure_checkpoint_dir
from ..sources.versioned import VersionedTable
from ..util import KEY, names

# The standing prune rules, in cascade order (names and terms as the reference uses them).
PRUNE_AGES = {"promo": "6m", "social": "3m", "auth": "7d", "autoreply": "30d", "calendar": "30d",
              "shipping": "3m", "updates": "6m", "old_read": "1y", "old_unread": "1y", "noisy": "30d"}
_G = dict(not_starred=True, not_important=True, not_reference=True, in_trash=False)
STANDING_RULES = [
    Rule("Old promotions", category_any=("promotions",), older_than="6m", unread=True, **_G),
    Rule("Social/notification noise", category_any=("social",), older_than="3m", **_G),
    Rule("Expired codes/resets/verifications",
         subject_any=("verification code", "reset your password", "verify your email"), older_than="7d", **_G),
    Rule("Auto-reply/bounce noise",
         subject_any=("out of office", "automatic reply", "delivery status notification"), older_than="30d", **_G),
    Rule("Past calendar notifications", from_any=("calendar-notification@google.com",), older_than="30d", **_G),
    Rule("Post-delivery shipping notices", from_any=("amazon.com", "ups.com", "fedex.com", "usps.com"),
         subject_any=("delivered", "out for delivery"), older_than="3m", **_G),
    Rule("Old read newsletters/digests", category_any=("updates",), unread=False, older_than="6m", **_G),
    Rule("Old newsletters/digests - Medium, Coursera, Glassdoor", category_any=("updates",), older_than="6m",
         from_any=("noreply@medium.com", "coursera.org", "glassdoor.com"), no_user_labels=True,
         not_starred=True, not_reference=True, in_trash=False),
    Rule("Old news alerts that are not starred, Google, WSJ", category_any=("updates",), older_than="6m",
         subject_any=("Google Alert", "WSJ News Alert"), not_starred=True, in_trash=False),
    Rule("Old news that are not starred, WSJ", category_any=("updates",), older_than="6m",
         from_any=("access.interactive.wsj.com",), not_starred=True, in_trash=False),
    Rule("Old read mail", unread=False, not_sent=True, not_chats=True, older_than="1y", smaller_than=MIB, **_G),
    Rule("Old unread mail", unread=True, category_none=("primary",), older_than="1y", **_G),
]

# Rescue / reference rules (receipts, policy, travel, alerts, warranty).
_RECEIPTS = ("statement", "invoice", "order")
_POLICY = ("policy", "terms")
_TRAVEL = ("itinerary", "boarding pass", "flight confirmation", "hotel confirmation", "reservation confirmation")
_ALERTS = ("security alert", "new sign-in", "password changed")
_WARRANTY = ("product registration", "registration confirmation", "warranty", "proof of purchase")
RESCUE_RULES = [
    Rule("Receipts/statements/orders (1y+)", in_trash=True, older_than="1y", subject_any=_RECEIPTS),
    Rule("Policy/terms docs (1y+)", in_trash=True, older_than="1y", subject_any=_POLICY),
    Rule("Travel confirmations", in_trash=True, subject_any=_TRAVEL, category_none=("promotions",)),
    Rule("Account security alerts (recent)", in_trash=True, subject_any=_ALERTS, newer_than="1y"),
    Rule("Warranty/registration docs", in_trash=True, subject_any=_WARRANTY, category_none=("promotions",)),
]
REFERENCE_RULES = [
    Rule("Receipts/statements/orders", subject_any=_RECEIPTS, not_reference=True, in_trash=False),
    Rule("Policy/terms docs", subject_any=_POLICY, not_reference=True, in_trash=False),
    Rule("Travel confirmations", subject_any=_TRAVEL, category_none=("promotions",), not_reference=True, in_trash=False),
    Rule("Account security alerts (recent)", subject_any=_ALERTS, newer_than="1y", not_reference=True, in_trash=False),
    Rule("Warranty/registration docs", subject_any=_WARRANTY, category_none=("promotions",), not_reference=True,
         in_trash=False),
]
NOISY_CATEGORIES = ("promotions", "updates", "social")
REFERENCE_LABEL = "Reference"
REFERENCE_MAX_AGE_DAYS = 7


def industry_rules(rows: list[tuple[str, list[str]]]) -> list[Rule]:
    """One rule per (label, sender addresses) row of the industry-sender file."""
    return [Rule(label, in_inbox=True, older_than=PRUNE_AGES["updates"], from_any=tuple(addrs),
                 not_starred=True, in_trash=False) for label, addrs in rows if addrs]


def noisy_rules(plain: list[str], with_exclusions: list[tuple[str, list[str]]]) -> list[Rule]:
    """R1c/R1d: one shared rule for plain noisy senders, one rule per sender with subject exclusions."""
    out = []
    if plain:
        out.append(Rule("Noisy senders (low engagement)", category_any=NOISY_CATEGORIES, from_any=tuple(plain),
                        older_than=PRUNE_AGES["noisy"], **_G))
    for addr, kws in with_exclusions:
        out.append(Rule(f"Noisy sender: {addr} (excluding: {','.join(kws)})", category_any=NOISY_CATEGORIES,
                        from_any=(addr,), subject_none=tuple(kws), older_than=PRUNE_AGES["noisy"], **_G))
    return out


def first_match(rules: list[Rule], as_of_epoch: int) -> Column:
    """1-based ordinal of the first matching rule, NULL when none matches."""
    out = None
    for i, r in enumerate(rules, start=1):
        p = rule_predicate(r, as_of_epoch)
        out = F.when(p, F.lit(i)) if out is None else out.when(p, F.lit(i))
    return out


def rule_name(rules: list[Rule], ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r.name) for r in rules]), ordinal)


def match_rules(m: DataFrame, rules: list[Rule], as_of_epoch: int) -> DataFrame:
    """Messages claimed by a rule, with ``rule_no`` and ``category`` (rule name).

    The ordinal is emitted by exploding a 0/1-element array instead of a
    ``rule_no IS NOT NULL`` filter: a filter would be pushed below the
    projection and evaluate the whole CASE chain twice (once to filter, once
    to project); the generator evaluates it exactly once per message.
    """
    hit = F.array_compact(F.array(first_match(rules, as_of_epoch)))
    x = m.select("*", F.explode(hit).alias("rule_no"))
    return x.withColumn("category", rule_name(rules, F.col("rule_no")))


# ------------------------------------------------------------- protections
def _spread_null(c: str, salt: Column) -> Column:
    """A join key: the value, or for NULL a text that no value equals, different from row to row."""
    return F.coalesce(F.col(c), F.concat(F.lit("\u0000"), salt.cast("string")))


def _row_salt(df: DataFrame) -> Column:
    return F.xxhash64(*[c for c in (*KEY, "message_id") if c in df.columns])


def contact_addresses(contacts: DataFrame, email_col: str = "email") -> DataFrame:
    return contacts.select(F.lower(F.trim(F.col(email_col))).alias("_contact")).where("_contact IS NOT NULL").distinct()


def exclude_contacts(m: DataFrame, contacts: DataFrame, email_col: str = "email") -> DataFrame:
    """Rows whose sender is not a contact (NULL sender is never a contact)."""
    return m.join(contact_addresses(contacts, email_col), _spread_null("from_email", _row_salt(m)) == F.col("_contact"), "left_anti")


def replied_thread_ids(m: DataFrame) -> DataFrame:
    return m.where((F.col("in_sent") == 1) & F.col("thread_id").isNotNull()).select(F.col("thread_id").alias("_thread")).distinct()


def exclude_replied(m: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows whose thread never got a reply; a NULL thread counts as not replied."""
    return m.join(replied_thread_ids(sent), _spread_null("thread_id", _row_salt(m)) == F.col("_thread"), "left_anti")


def protect(cands: DataFrame, contacts: DataFrame, m: DataFrame, email_col: str = "email",
            keep_flags: bool = False) -> DataFrame:
    """R2: mark candidates protected by contact (J1) or by a replied thread.

    Adds ``protected_by`` ('contact', 'replied_thread' or NULL).  Both lookups
    are left joins on distinct keys, so a candidate row is never multiplied.
    """
    salt = _row_salt(cands)
    x = (cands.join(contact_addresses(contacts, email_col), _spread_null("from_email", salt) == F.col("_contact"), "left")
              .join(replied_thread_ids(m), _spread_null("thread_id", salt) == F.col("_thread"), "left"))
    x = x.withColumn("protected_by", F.when(F.col("_contact").isNotNull(), "contact")
                                      .when(F.col("_thread").isNotNull(), "replied_thread"))
    if keep_flags:
        x = x.withColumn("is_contact", F.col("_contact").isNotNull()).withColumn("replied", F.col("_thread").isNotNull())
    return x.drop("_contact", "_thread")


def prune(m: DataFrame, rules: list[Rule], contacts: DataFrame, as_of_epoch: int,
          key=KEY) -> DataFrame:
    """The prune cascade with protections.

    One row per claimed message: key, message_id, from_email, subject,
    rule_no, category, decision ('prune' or 'skip'), protected_by.
    """
    cand = match_rules(m, rules, as_of_epoch).select(*names(key), "message_id", "thread_id", "from_email", "subject",
                                                      "rule_no", "category")
    p = protect(cand, contacts, m)
    return p.withColumn("decision", F.when(F.col("protected_by").isNull(), "prune").otherwise("skip")).drop("thread_id")


def rescue(m: DataFrame, rules: list[Rule], as_of_epoch: int, key=KEY) -> DataFrame:
    """Trashed messages matching a keep rule (first match) -> rescue actions."""
    return match_rules(m, rules, as_of_epoch).select(*names(key), "message_id", "from_email", "subject", "rule_no", "category")


def label_reference(m: DataFrame, rules: list[Rule], as_of_epoch: int, key=KEY) -> DataFrame:
    """Messages to label Reference (not in trash, not already labelled): idempotent."""
    return match_rules(m, rules, as_of_epoch).select(*names(key), "message_id", "from_email", "subject", "rule_no", "category")


def apply_actions(m: DataFrame, actions: DataFrame, kind: str, key=KEY) -> DataFrame:
    """Next table version with the actions applied to the label arrays and flags.

    kind='prune':  add Trash + 'Audit/Pruned/<category>', in_trash = 1
    kind='rescue': remove Trash, add Reference + 'Audit/Rescued/<category>', in_trash = 0
    kind='reference': add Reference
    Only rows with decision 'prune' (when present) are acted on.
    """
    a = actions
    if "decision" in a.columns:
        a = a.where(F.col("decision") == "prune")
    a = a.select(*names(key), F.col("category").alias("_act_cat"))
    x = m.join(a, names(key), "left")
    labels = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    hit = F.col("_act_cat").isNotNull()
    if kind == "prune":
        new = F.array_union(labels, F.array(F.lit("Trash"), F.concat(F.lit("Audit/Pruned/"), F.col("_act_cat"))))
        x = x.withColumn("in_trash", F.when(hit, F.lit(1)).otherwise(F.col("in_trash")))
    elif kind == "rescue":
        new = F.array_union(F.array_remove(labels, "Trash"),
                            F.array(F.lit(REFERENCE_LABEL), F.concat(F.lit("Audit/Rescued/"), F.col("_act_cat"))))
        x = x.withColumn("in_trash", F.when(hit, F.lit(0)).otherwise(F.col("in_trash")))
    elif kind == "reference":
        new = F.array_union(labels, F.array(F.lit(REFERENCE_LABEL)))
    else:
        raise ValueError(kind)
    return x.withColumn("labels", F.when(hit, new).otherwise(F.col("labels"))).drop("_act_cat")


def run_summary(decisions: DataFrame, failed: DataFrame | None = None, key="message_id") -> DataFrame:
    """K9: per category: moved, skipped, failed (decided, but what ``failed`` names by ``key`` could not be moved).

    Decisions without a ``decision`` column (rescue, reference) all move.
    """
    d = decisions if "decision" in decisions.columns else decisions.withColumn("decision", F.lit("prune"))
    if failed is not None:
        d = d.join(failed.select(*names(key)).distinct().withColumn("_failed", F.lit(True)), names(key), "left")
    else:
        d = d.withColumn("_failed", F.lit(False))
    is_failed = F.coalesce(F.col("_failed"), F.lit(False))
    return (d.groupBy("category").agg(
                F.sum(F.when((F.col("decision") == "prune") & ~is_failed, 1).otherwise(0)).cast("long").alias("moved"),
                F.sum(F.when(F.col("decision") == "skip", 1).otherwise(0)).cast("long").alias("skipped"),
                F.sum(F.when((F.col("decision") == "prune") & is_failed, 1).otherwise(0)).cast("long").alias("failed"))
             .orderBy("category"))


def preview(m: DataFrame, rules: list[Rule], as_of_epoch: int, n: int = 10, key=KEY) -> DataFrame:
    """Dry-run preview: per rule, its INDEPENDENT match count and newest ``n`` messages.

    Every rule is evaluated on its own (no cascade).  A message matching k
    rules is emitted k times by ``explode``; the per-rule newest-n uses a
    ``row_number() <= n`` window, which Spark executes with a partial
    per-partition group limit before the shuffle (WindowGroupLimit), so a hot
    rule never ships all of its rows to one task.
    """
    hits = F.filter(F.array(*[F.when(rule_predicate(r, as_of_epoch), F.lit(i))
                              for i, r in enumerate(rules, start=1)]), lambda x: x.isNotNull())
    x = m.select(*names(key), "message_id", "date_ts", "from_email", "subject", F.explode(hits).alias("rule_no"))
    ensure_checkpoint_dir(m.sparkSession)
    x = x.checkpoint()                                       # counted and ranked: the predicates run once
    counts = x.groupBy("rule_no").agg(F.count(F.lit(1)).alias("matches"))
    w = Window.partitionBy("rule_no").orderBy(F.col("date_ts").desc_nulls_last(), *names(key))
    top = x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return (top.join(counts, "rule_no").withColumn("category", rule_name(rules, F.col("rule_no")))
               .select("rule_no", "category", "matches", "rank", *names(key), "message_id", "date_ts", "from_email", "subject"))


def reference_stale(last_run_epoch: Column, as_of_epoch: int, max_days: int = REFERENCE_MAX_AGE_DAYS) -> Column:
    """True when never run or more than ``max_days`` whole days ago."""
    days = F.floor((F.lit(as_of_epoch) - last_run_epoch) / 86400)
    return F.coalesce(days > max_days, F.lit(True))


def noisy_senders(m: DataFrame, as_of_epoch: int, min_count: int = 5, max_read_pct: int = 10,
                  lookback: str = "180d", direction: str = "older", sample: int | None = None,
                  key=KEY) -> DataFrame:
    """Low-engagement senders in promotions/updates/social.

    ``direction='older'`` keeps the coded ``older_than`` (Q8); 'newer' gives
    the documented "last N days".  ``sample`` optionally restricts to the
    newest N matches (a top-k, as the reference's single page); the default
    is the full scan.
    """
    age = Rule("noisy", category_any=NOISY_CATEGORIES,
               **({"older_than": lookback} if direction == "older" else {"newer_than": lookback}),
               not_starred=True, not_important=True, not_reference=True, in_trash=False)
    x = m.where(rule_predicate(age, as_of_epoch) & F.col("from_email").isNotNull())
    if sample is not None:
        x = x.orderBy(F.col("date_ts").desc_nulls_last(), *names(key)).limit(sample)
    g = x.groupBy(F.lower("from_email").alias("from_email")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.coalesce(F.col("is_unread"), F.lit(0)) == 0, 1).otherwise(0)).cast("long").alias("read"),
        F.sum(F.coalesce(F.col("is_starred"), F.lit(0))).cast("long").alias("starred"))
    pct = F.floor(F.col("read") * 100 / F.col("count")).cast("long")
    return (g.withColumn("read_pct", pct)
             .where((F.col("count") >= min_count) & (F.col("read_pct") <= max_read_pct))
             .select("from_email", "count", "read_pct", "starred")
             .orderBy(F.col("count").desc(), "from_email"))


def has_reference_label(labels: str = "labels") -> Column:
    """Reference label present (either spelling)."""
    return has_label(REFERENCE_LABELS, labels)


# ------------------------------------------------ noisy senders as a join (R1c/R1d at scale)
NOISY_PLAIN_NAME = "Noisy senders (low engagement)"


def noisy_table(noisy: DataFrame) -> DataFrame:
    """(address, exclude_keywords, line_no) -> (address, noisy_no, noisy_category, excluded).

    One row per line.  ``noisy_no`` is the line's place in the cascade: all
    plain senders are one rule and come first, then each line with exclusions
    in file order.  ``excluded`` is the pattern of its keywords (as
    ``subject_none`` has it), NULL for a plain line.
    """
    kws = F.filter(F.coalesce(F.col("exclude_keywords"), F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    t = (noisy.select(F.lower(F.trim("address")).alias("address"), kws.alias("kws"), "line_no")
              .where("address <> ''"))
    k = F.col("kws")
    plain = F.size(k) == 0
    cat = F.when(plain, F.lit(NOISY_PLAIN_NAME)).otherwise(
        F.concat(F.lit("Noisy sender: "), F.col("address"), F.lit(" (excluding: "), F.array_join(k, ","), F.lit(")")))
    quoted = F.transform(k, lambda w: F.concat(F.lit("\\Q"), F.replace(F.lower(w), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.when(~plain, F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(")(?![\\p{L}\\p{N}])")))
    t = t.select("address", "line_no", plain.alias("plain"), cat.alias("noisy_category"), pattern.alias("excluded"))
    # lines in ranges of their order; a line's place is what the ranges before its own hold, and its place in that
    ensure_checkpoint_dir(noisy.sparkSession)
    t = t.repartitionByRange(F.col("plain").desc(), "line_no").withColumn("_range", F.spark_partition_id()).checkpoint()
    before, offsets = 0, []
    for r in sorted(t.groupBy("_range").agg(F.count_if(~F.col("plain")).alias("n"), F.count_if("plain").alias("p")).collect()):   # a row a range
        offsets.append((r["_range"], before))
        before += r["n"]
    any_plain = t.where("plain").select(F.lit(1)).limit(1).count()
    at = noisy.sparkSession.createDataFrame(offsets, "_range int, _before long")
    own = Window.partitionBy("_range").orderBy("plain", "line_no")                       # false first: lines with exclusions
    no = F.when(F.col("plain"), 1).otherwise(F.dense_rank().over(own) + F.col("_before") + any_plain)
    return t.join(at, "_range").select("address", no.cast("int").alias("noisy_no"), "noisy_category", "excluded")


def sender_keys(email: Column) -> Column:
    """What a sender rule may name: the address, its domain, and each parent domain."""
    e = F.lower(email)
    labels = F.split(F.regexp_extract(e, "@([^@]*)$", 1), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(email.isNotNull(), F.array_distinct(F.concat(F.array(e), suffixes)))


def prune_with_noisy(m: DataFrame, rules: list[Rule], noisy: DataFrame, contacts: DataFrame, as_of_epoch: int,
                     key=KEY) -> DataFrame:
    """R1 with the noisy-sender rules as a join instead of a CASE chain.

    ``rules`` (standing + industry) keep their ordinal chain.  A message that
    the chain does not claim and that meets the shared noisy conditions is
    joined to the noisy lines by its address and its domains; lines whose
    keywords the subject has fall out, and the first line left claims it.
    Output equals ``prune`` with ``noisy_rules`` appended to the chain.
    """
    common = Rule("noisy", category_any=NOISY_CATEGORIES, older_than=PRUNE_AGES["noisy"], **_G)
    columns = [*names(key), "message_id", "thread_id", "from_email", "subject"]
    chain = first_match(rules, as_of_epoch)
    state = F.when(chain.isNotNull(), chain).when(rule_predicate(common, as_of_epoch), F.lit(0))
    x = m.select(*columns, F.explode(F.array_compact(F.array(state))).alias("rule_no"))
    claimed = x.where("rule_no > 0").withColumn("category", rule_name(rules, F.col("rule_no")))
    lines = noisy_table(noisy)
    met = (x.where("rule_no = 0").withColumn("_key", F.explode(sender_keys(F.col("from_email"))))
            .join(lines, F.col("_key") == F.col("address"))
            .where(F.col("excluded").isNull() | ~F.coalesce(F.rlike(F.lower("subject"), F.col("excluded")), F.lit(False))))
    # the first line that is left claims the message (one row a key and partition before the shuffle)
    first = Window.partitionBy(*names(key)).orderBy("noisy_no")
    noisy_claim = (met.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
                    .select(*columns, (F.col("noisy_no") + len(rules)).cast("int").alias("rule_no"), F.col("noisy_category").alias("category")))
    p = protect(claimed.unionByName(noisy_claim), contacts, m)
    return p.withColumn("decision", F.when(F.col("protected_by").isNull(), "prune").otherwise("skip")).drop("thread_id")


# ------------------------------------------------ a whole retention run
# The action that a run's audit rows carry.
AUDIT_ACTIONS = {"prune": "pruned", "rescue": "rescued", "reference": "labelled"}


def decide(m: DataFrame, kind: str, rules: list[Rule], as_of_epoch: int, contacts: DataFrame | None = None, key=KEY) -> DataFrame:
    """The decisions of a run: R1 with protections ('prune'), R3 ('rescue') or R4 ('reference')."""
    if kind == "prune":
        return prune(m, rules, contacts, as_of_epoch, key)
    return (rescue if kind == "rescue" else label_reference)(m, rules, as_of_epoch, key)


def apply_by_file(table: VersionedTable, actions: DataFrame, kind: str, key=KEY, run: str | None = None) -> int:
    """R5 on a versioned table: only the files that hold a row to change are written anew.  Returns the version."""
    a = actions.where("decision = 'prune'") if "decision" in actions.columns else actions
    files = [r[0] for r in table.located(a.select(*names(key)), key).where("_file IS NOT NULL").select("_file").distinct().collect()]
    return table.rewrite(files, lambda rows: apply_actions(rows, a, kind, key), run)


def retention_run(table: VersionedTable, kind: str, rules: list[Rule], as_of_epoch: int, out_dir: str, run: str, run_ts: str,
                  contacts: DataFrame | None = None, dry_run: bool = False, key=KEY) -> DataFrame:
    """A prune, rescue or reference run over a versioned table; returns its summary (K9).

    Under ``out_dir`` a run has a folder of its own, ``run=<run>``, in each of
    ``decisions``, ``audit`` (JSON lines) and ``summary``.  It decides once;
    the audit rows (K7) are written before the table's next version (R5), and
    all of them from the stored decisions.  A run that is started again under
    its name takes up its decisions, writes the same audit rows and summary
    over the old ones, and adds no second version.  A run under another name
    finds the moved mail moved.  Messages that were decided on but are no
    longer in the table when it is changed count as ``failed`` and get no
    audit row.  A dry run returns the summary and writes nothing.
    """
    from ..sources.lists import exists

    spark = table.spark
    where = {n: f"{out_dir.rstrip('/')}/{n}/run={run}" for n in ("decisions", "audit", "summary")}
    if dry_run:
        return run_summary(decide(table.read(), kind, rules, as_of_epoch, contacts, key))
    if not exists(spark, where["decisions"] + "/_SUCCESS"):
        decide(table.read(), kind, rules, as_of_epoch, contacts, key).write.mode("overwrite").parquet(where["decisions"])
    d = spark.read.parquet(where["decisions"])
    acted = d.where("decision = 'prune'") if kind == "prune" else d
    done = table.runs().get(run)
    at = table.located(acted.select(*names(key)), key, None if done is None else done - 1)
    gone = at.where("_file IS NULL").select(*names(key))
    (acted.join(gone, names(key), "left_anti")
     .select(F.lit(run_ts).alias("ts"), F.lit(AUDIT_ACTIONS[kind]).alias("action"), "category", "message_id",
             F.col("from_email").alias("from"), "subject").write.mode("overwrite").json(where["audit"]))
    if done is None:
        apply_by_file(table, d, kind, key, run)
    summary = run_summary(d, gone, key)
    summary.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite").parquet(where["summary"])
    return spark.read.parquet(where["summary"]).drop("run_ts").orderBy("category")
