"""Queries and jobs over ``classifications``.

Shape of the data: one row per (message_id, model, prompt_version); a
(message_id, prompt_version) group holds one vote per model, so it is bounded
by the number of models.  Every per-message question (vote, disagreement,
verdict) is one partial + final aggregate on (message_id, prompt_version);
the strict majority is aggregates plus one join of the votes to a
one-row-per-group table.  No step gathers a group into one task, so even a
pathologically large group is reduced map-side.  The reference's self-joins
and per-message lookups disappear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..util import KEY as MESSAGE_KEY
from ..util import count_if, names, sort_small

KEY = ["message_id", "prompt_version"]
LABELS = ("keep", "delete", "uncertain")
UNCERTAIN_RATE_WARN = 0.30          # single-model gate (G1)
MIN_PROMPT_VERSION = "v1.1.0"       # deployment gate (G2)
MAX_ERROR_RATE = 0.05               # deployment gate (G2)
# Labels, gates and their texts.
GATE_WARN_TEXT = "WARN: refine prompt before Stage 3"


def _pct_text(num: Column, den: Column, decimals: int = 1) -> Column:
    return C.fixed_text(num * 100, den, decimals, "%")


# ------------------------------------------------------------ per-model stats
def label_distribution(c: DataFrame) -> DataFrame:
    """Label counts per (model, version) with the share inside (model, version)."""
    g = c.groupBy("model", "prompt_version", "label").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("model", "prompt_version")
    return (g.withColumn("_tot", F.sum("count").over(w))
             .select("model", "prompt_version", "label", "count", _pct_text(F.col("count"), F.col("_tot")).alias("pct"))
             .transform(lambda d: sort_small(d, "model", "prompt_version", "label")))


def uncertain_rate_by_version(c: DataFrame, gate: float = UNCERTAIN_RATE_WARN) -> DataFrame:
    """Uncertain rate per (version, model) and the single-model gate status."""
    g = c.groupBy("prompt_version", "model").agg(
        count_if(F.col("label") == "uncertain").alias("uncertain"), F.count(F.lit(1)).alias("total"))
    return (g.select("prompt_version", "model", "uncertain", "total",
                     _pct_text(F.col("uncertain"), F.col("total")).alias("uncertain_rate"),
                     F.when(F.col("uncertain").cast("double") / F.col("total") > gate, GATE_WARN_TEXT)
                      .otherwise("OK").alias("gate_status"))
             .transform(lambda d: sort_small(d, "prompt_version", "model")))


def confidence_distribution(c: DataFrame) -> DataFrame:
    """Confidence histogram (truncated to tenths; NULL confidence kept as a bucket)."""
    return (c.groupBy("model", "prompt_version", "label", C.confidence_bucket("confidence").alias("confidence_bucket"))
             .agg(F.count(F.lit(1)).alias("count"))
             .transform(lambda d: sort_small(d, "model", "prompt_version", "label", "confidence_bucket")))


def label_drift_by_model(c: DataFrame) -> DataFrame:
    """Per-model label mix across prompt versions."""
    g = c.groupBy("model", "prompt_version").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("label") == "delete").alias("deletes"),
        count_if(F.col("label") == "keep").alias("keeps"),
        count_if(F.col("label") == "uncertain").alias("uncertain"))
    return (g.withColumn("delete_rate", _pct_text(F.col("deletes"), F.col("total")))
             .transform(lambda d: sort_small(d, "model", "prompt_version")))


def single_model_uncertain_rate(c: DataFrame, model: str, version: str,
                                gate: float = UNCERTAIN_RATE_WARN) -> DataFrame:
    """A28 + G1: one row: uncertain, total, rate, warn flag for one (model, version)."""
    one = c.where((F.col("model") == model) & (F.col("prompt_version") == version))
    g = one.agg(count_if(F.col("label") == "uncertain").alias("uncertain"), F.count(F.lit(1)).alias("total"))
    rate = F.when(F.col("total") > 0, F.col("uncertain").cast("double") / F.col("total"))
    return g.select(F.lit(model).alias("model"), F.lit(version).alias("prompt_version"),
                    "uncertain", "total", rate.alias("uncertain_rate"),
                    F.coalesce(rate > gate, F.lit(False)).alias("gate_warn"))


# ------------------------------------------------------ per-message questions
def _label_counts(c: DataFrame, *more: Column) -> DataFrame:
    """Per (message, version): votes for each of the three labels, and what follows from them.

    Labels are a closed set, so counts (a hash aggregate) hold all that
    minimum, maximum and majority of the label texts would.  ``kinds``: labels
    voted for; ``max_label``: the last of them in text order; ``majority_label``:
    the one with strictly most votes, NULL on a tie.  ``more``: further aggregates.
    """
    n = {x: F.col("n_" + x) for x in LABELS}
    g = c.groupBy(*KEY).agg(*[count_if(F.col("label") == x).alias("n_" + x) for x in LABELS], F.count("label").alias("n_votes"),
                            F.count(F.lit(1)).alias("n_rows"), *more)
    some = [F.when(n[x] > 0, F.lit(x)) for x in sorted(LABELS, reverse=True)]
    majority = F.lit(None).cast("string")
    for x in LABELS:
        others = F.greatest(*[n[y] for y in LABELS if y != x])
        majority = F.when(n[x] > others, F.lit(x)).otherwise(majority)
    return (g.withColumn("kinds", sum(((n[x] > 0).cast("int") for x in LABELS), F.lit(0)))
             .withColumn("max_label", F.coalesce(*some)).withColumn("majority_label", majority))


def vote(c: DataFrame) -> DataFrame:
    """Unanimous label, else 'uncertain'; n_votes = number of votes (Q13)."""
    return _label_counts(c).select(*KEY, F.when(F.col("kinds") == 1, F.col("max_label")).otherwise("uncertain").alias("vote"), "n_votes")


def disagreeing_keys(c: DataFrame) -> DataFrame:
    """(message_id, prompt_version) groups with at least two distinct labels."""
    return _label_counts(c).where("kinds > 1").select(*KEY)


def disagreement_rate(c: DataFrame, m: DataFrame | None = None, category_col: str = "category") -> DataFrame:
    """Share of messages with a disagreement, per version (optionally per category of ``m``)."""
    pm = _label_counts(c).withColumn("_dis", (F.col("kinds") > 1).cast("int"))
    keys = ["prompt_version"]
    if m is not None:
        # one category a message: rows that repeat an id don't multiply its votes
        own = m.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(F.min(category_col).alias(category_col))
        pm = pm.join(own, "message_id", "left")
        keys.append(category_col)
    g = pm.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_messages"), F.sum("_dis").cast("long").alias("disagreements"))
    return g.withColumn("disagreement_rate", _pct_text(F.col("disagreements"), F.col("total_messages"))).orderBy(*keys)


def ensemble_verdict(c: DataFrame) -> DataFrame:
    """Unanimous keep / unanimous delete / all uncertain / disagreement, share per version."""
    pm = _label_counts(c).withColumn("verdict", C.verdict_name("kinds", "max_label"))
    g = pm.groupBy("prompt_version", "verdict").agg(F.count(F.lit(1)).alias("messages"))
    w = Window.partitionBy("prompt_version")
    return (g.withColumn("_tot", F.sum("messages").over(w))
             .select("prompt_version", "verdict", "messages", _pct_text(F.col("messages"), F.col("_tot")).alias("pct"))
             .transform(lambda d: sort_small(d, "prompt_version", "verdict")))


def majority_labels(c: DataFrame) -> DataFrame:
    """(message_id, prompt_version, majority_label) for disagreeing groups with a strict majority.

    majority_label = the label with the strictly highest count inside the
    group; groups whose top count is shared have none (Q3: the reference
    picks an arbitrary row's label instead).
    """
    return _label_counts(c).where("kinds > 1 AND majority_label IS NOT NULL").select(*KEY, "majority_label")


def minority_votes(c: DataFrame) -> DataFrame:
    """Votes that differ from their group's strict majority (disagreeing groups only).

    The votes are joined to the one-row-per-group majority table; a hot
    group only skews the vote side of that join, which AQE splits.
    """
    return (c.join(majority_labels(c), KEY).where(F.col("label") != F.col("majority_label"))
             .withColumn("disagree", F.lit(True)))


def outlier_by_model(c: DataFrame) -> DataFrame:
    """Outlier votes (against the strict majority) per (version, model)."""
    return (minority_votes(c).groupBy("prompt_version", "model")
            .agg(F.count(F.lit(1)).alias("outlier_votes"))
            .transform(lambda d: sort_small(d, "prompt_version", F.col("outlier_votes").desc(), "model")))


def outlier_directions(c: DataFrame) -> DataFrame:
    """Outlier votes per model split by direction against the majority."""
    mv = minority_votes(c)
    return (mv.groupBy("prompt_version", "model").agg(
                F.count(F.lit(1)).alias("outlier_votes"),
                count_if((F.col("label") == "delete") & (F.col("majority_label") == "keep")).alias("false_deletes"),
                count_if((F.col("label") == "keep") & (F.col("majority_label") == "delete")).alias("false_keeps"),
                count_if(F.col("label") == "uncertain").alias("uncertain"))
              .transform(lambda d: sort_small(d, "prompt_version", F.col("outlier_votes").desc(), "model")))


def disagreement_history(c: DataFrame) -> DataFrame:
    """Per run = (prompt_version, sorted model set): sample, disagreements, rate."""
    pm = c.groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        *[F.max((F.col("label") == x).cast("int")).alias("n_" + x) for x in LABELS])
    pm = pm.withColumn("_dis", (sum((F.coalesce("n_" + x, F.lit(0)) for x in LABELS), F.lit(0)) > 1).cast("int"))
    g = pm.groupBy("prompt_version", "models").agg(
        F.count(F.lit(1)).alias("sample"), F.sum("_dis").cast("long").alias("disagreements"))
    return (g.withColumn("disagreement_rate", _pct_text(F.col("disagreements"), F.col("sample")))
             .transform(lambda d: sort_small(d, "prompt_version", "models")))


def vote_text(model: Column, label: Column, conf: Column) -> Column:
    """'model:label(conf)'; NULL confidence drops the vote from the list (as GROUP_CONCAT)."""
    return F.concat(model, F.lit(":"), label, F.lit("("), F.round(conf, 2).cast("string"), F.lit(")"))


def high_confidence_disagreements(c: DataFrame, threshold: float = 0.9, k: int = 200) -> DataFrame:
    """Disagreeing messages with at least one vote at confidence >= threshold."""
    order = [F.col("max_confidence").desc(), F.col("prompt_version"), F.col("message_id")]
    # numbers decide which messages are listed; texts are gathered for those k only
    top = (_label_counts(c, F.max("confidence").alias("max_confidence"))
           .where((F.col("kinds") > 1) & (F.col("max_confidence") >= threshold)).select(*KEY, "max_confidence").orderBy(*order).limit(k))
    votes = (c.join(F.broadcast(top), KEY).groupBy(*KEY, "max_confidence")                # k rows at most
             .agg(F.array_join(F.array_sort(F.collect_list(vote_text(F.col("model"), F.col("label"), F.col("confidence")))), "  ").alias("votes")))
    return votes.select("message_id", "prompt_version", "votes", "max_confidence").orderBy(*order)


def disagreements(c: DataFrame, models: list[str], version: str | None = None) -> DataFrame:
    """K5: disagreement log: one row per disagreeing message, one label column per model.

    ``pivot`` with the explicit model list needs no extra pass to find the
    values; min<>max replaces the reference's per-message lookups.
    """
    if version is not None:
        c = c.where(F.col("prompt_version") == version)
    c = c.where(F.col("model").isin(models))
    g = (c.groupBy(*KEY).pivot("model", models).agg(F.max("label"))
          .withColumnsRenamed({mm: f"{mm}_label" for mm in models}))
    cols = [F.col(f"{mm}_label") for mm in models]
    if len(cols) < 2:                                        # one model cannot disagree with itself
        return g.where(F.lit(False))
    lo, hi = F.least(*cols), F.greatest(*cols)
    return g.where(lo != hi)


# -------------------------------------------------------------- upsert / log
def upsert_classifications(old: DataFrame, new: DataFrame) -> DataFrame:
    """K3: latest classified_at wins per (message_id, model, prompt_version) (Q4 fixed).

    Ranked inside the key; Spark limits each partition to its first row a key
    before the shuffle, so repeated runs of a key never gather in one task.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in both.columns if c not in ("message_id", "model", "prompt_version", "classified_at")]
    return _first(both, ["message_id", "model", "prompt_version"], [F.col("classified_at").desc_nulls_last(), *rest])


def _first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def valid_labels(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The CHECK constraint as a split: (valid rows, quarantined rows)."""
    ok = F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    return c.where(ok), c.where(~ok)


# --------------------------------------------------------------- corrections
def latest_corrections(corr: DataFrame, order_col: str | None = None) -> DataFrame:
    """Latest corrected_at per (message_id, prompt_version); ties -> later line.

    Missing corrected_at sorts as ''.
    """
    order = [F.coalesce(F.col("corrected_at"), F.lit("")).desc()] + ([F.col(order_col).desc_nulls_last()] if order_col else [])
    rest = [F.col(c).desc_nulls_last() for c in corr.columns if c not in (*KEY, "corrected_at", order_col) and c != "model_labels"]
    return _first(corr, KEY, order + rest)


def corrections_vs_votes(corr: DataFrame, c: DataFrame) -> DataFrame:
    """Latest human label next to the ensemble vote of the same (message, version)."""
    return latest_corrections(corr).join(vote(c), KEY, "inner")


def corrections_error_rate(corr: DataFrame, c: DataFrame) -> DataFrame:
    """Per version: corrected messages with votes, correct votes, error rate."""
    j = corrections_vs_votes(corr, c)
    g = j.groupBy("prompt_version").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("vote") == F.col("human_label")).alias("correct"))
    return (g.withColumn("error_rate", 1.0 - F.col("correct").cast("double") / F.col("total"))
             .transform(lambda d: sort_small(d, "prompt_version")))


def deployment_gate(corr: DataFrame, c: DataFrame, versions: DataFrame,
                    min_version: str = MIN_PROMPT_VERSION, max_error: float = MAX_ERROR_RATE) -> DataFrame:
    """Per candidate prompt version: version check + error-rate check.

    ``versions`` has one column ``prompt_version``.  No corrections or no
    overlap with votes -> status 'unmeasured' (passes); error >= max fails.
    """
    err = corrections_error_rate(corr, c)
    # left join of the candidate versions to their error rates, as union + aggregate
    # (both sides are one row per version; no join to plan)
    cand = versions.select("prompt_version", F.lit(1).alias("_cand"), F.lit(None).cast("long").alias("total"),
                           F.lit(None).cast("long").alias("correct"), F.lit(None).cast("double").alias("error_rate"))
    v = (cand.unionByName(err.withColumn("_cand", F.lit(0)))
             .groupBy("prompt_version")
             .agg(F.max("_cand").alias("_cand"), F.max("total").alias("total"), F.max("correct").alias("correct"),
                  F.max("error_rate").alias("error_rate"))
             .where(F.col("_cand") == 1))
    version_ok = C.version_key("prompt_version") >= C.version_key(F.lit(min_version))
    status = (F.when(~version_ok, "fail_version")
               .when(F.col("total").isNull(), "unmeasured")
               .when(F.col("error_rate") >= max_error, "fail_error_rate")
               .otherwise("pass"))
    return v.select("prompt_version", version_ok.alias("version_ok"),
                    F.coalesce("total", F.lit(0).cast("long")).alias("total"),
                    F.coalesce("correct", F.lit(0).cast("long")).alias("correct"),
                    "error_rate", status.alias("status"))


# -------------------------------------------------------------- review queue
def review_queue(c: DataFrame, version: str) -> DataFrame:
    """Uncertain votes of one version grouped per message as a sorted array of structs."""
    u = c.where((F.col("prompt_version") == version) & (F.col("label") == "uncertain"))
    reason = F.col("reason") if "reason" in c.columns else F.lit(None).cast("string")
    return (u.groupBy("message_id")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("model"), F.col("label"), reason.alias("reason")))).alias("votes"))
             .withColumn("prompt_version", F.lit(version)))


def exclude_corrected(q: DataFrame, corr: DataFrame) -> DataFrame:
    """Drop queue entries that already have a correction for that version."""
    return q.join(corr.select(*KEY).distinct(), KEY, "left_anti")


def enrich_review(q: DataFrame, m: DataFrame, cols: list[str]) -> DataFrame:
    """Attach message fields; a missing message leaves them NULL."""
    return q.join(m.select("message_id", *cols), "message_id", "left")


# ------------------------------------------------------------------ fan-out
def fan_out(msgs: DataFrame, models: list[str]) -> DataFrame:
    """Message x model product as a generator (no join): one row per model."""
    return msgs.withColumn("model", F.explode(F.array(*[F.lit(mm) for mm in models])))


def pending(msgs: DataFrame, models: list[str], done: DataFrame, version: str) -> DataFrame:
    """(message, model) pairs not yet scored for ``version`` (resume).

    What is done is gathered per message on narrow keys; a message's row (its
    long turn with it) meets that once and fans out to its open models after.
    """
    d = (done.where(F.col("prompt_version") == version).where(F.col("model").isin(models))
             .groupBy(F.col("message_id").alias("_done_id")).agg(F.collect_set("model").alias("_done")))    # models at most
    x = msgs.where(F.col("message_id").isNotNull()).join(d, F.col("message_id") == F.col("_done_id"), "left")
    open_models = F.array_except(F.array(*[F.lit(mm) for mm in models]), F.coalesce("_done", F.array().cast("array<string>")))
    return x.withColumn("model", F.explode(open_models)).drop("_done", "_done_id").withColumn("prompt_version", F.lit(version))


# ----------------------------------------------------------------- sampling
# Stratified-sample strata (W4), in order.
STRATA = [
    ("read_inbox", "in_inbox = 1 AND is_unread = 0"),
    ("unread_inbox", "in_inbox = 1 AND is_unread = 1"),
    ("promotions", "Promotions"),
    ("social", "Social"),
    ("updates", "Updates"),
]


def _stratum_cond(spec: str) -> Column:
    if "=" in spec:
        return F.expr(spec)
    word = spec.lower()
    # SQLite LIKE on the JSON label text is case-insensitive
    return F.coalesce(F.exists("labels", lambda lab: F.lower(lab).contains(word)), F.lit(False))


def stratified_sample(m: DataFrame, n: int, cols: list[str], key=MESSAGE_KEY,
                      distinct: bool = False) -> DataFrame:
    """Five strata, newest ``n // 5`` messages with an id each, unioned (Q5: overlaps kept).

    One scan: every message emits the strata it belongs to (``explode``), and
    a per-stratum ``row_number() <= n // 5`` window picks the newest ones.
    Spark applies that limit per partition before the shuffle
    (WindowGroupLimit), so at most ``n // 5`` rows per stratum and partition
    move, however large a stratum is.
    """
    per = n // 5
    strata = F.array(*[F.when(_stratum_cond(spec), F.lit(name)) for name, spec in STRATA])
    x = (m.where(F.col("message_id").isNotNull())
          .select(*cols, F.col("date_ts"), F.struct(*names(key)).alias("_key"),
                  F.explode(F.array_compact(strata)).alias("stratum")))
    w = Window.partitionBy("stratum").orderBy(F.col("date_ts").desc_nulls_last(), F.col("_key"))
    out = x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).select("stratum", *cols)
    if distinct:
        out = out.dropDuplicates(["message_id"])
    return out


# ------------------------------------------------------------------ browse
# Default facets of the classifications table (B2).
CLASSIFICATION_FACETS = ["model", "prompt_version", "label"]


def browse_classifications(c: DataFrame) -> DataFrame:
    """B2: classifications, newest first (key columns break ties)."""
    return c.orderBy(F.col("classified_at").desc_nulls_last(), "message_id", "model", "prompt_version")


def exclude_checkpointed(m: DataFrame, audit: DataFrame, category: str = "ai_classify") -> DataFrame:
    """Messages without an audit checkpoint row of the live classifier."""
    done = (audit.where(F.col("category") == category).where(F.col("message_id").isNotNull())
                 .select(F.col("message_id").cast("string").alias("_mid")).distinct())
    return m.join(done, m["message_id"].cast("string") == done["_mid"], "left_anti")
