"""Small line-oriented inputs (S3-S6, S8, S9): all read with Spark's text/JSON readers.

A missing file yields an empty DataFrame (the reference turns the feature
off), never an error.  Config-sized inputs (rules, prompts) are turned into
typed rule rows for the cascade; they never carry message data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Rule


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, as Spark's own file systems see it.

    Only a file system that answers "not there" makes an input empty; one
    that cannot be reached, or a wrong scheme, fails: an empty contact list
    would switch the protection off.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, line_no); line_no orders them by file time, file name, place in the file."""
    return (spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_no")))


_LINE_NO = "struct<time:timestamp,file:string,block:bigint,line:bigint>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank, non-comment lines (value, line_no) of a text file; empty when missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"value string, line_no {_LINE_NO}")
    v = F.trim(F.col("value"))
    return _numbered(spark, path).where((v != "") & ~v.startswith("#"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S3: tolerant JSONL scan -> (good rows, quarantined raw lines).

    Blank lines are skipped; malformed lines land in the quarantine frame;
    a missing file gives two empty frames.
    """
    corrupt = "_corrupt_record"
    full = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())])
    if not exists(spark, path):
        empty = spark.createDataFrame([], full)
        return empty.drop(corrupt).withColumn("line_no", F.lit(None).cast(_LINE_NO)), empty.select(corrupt)
    # Lines in file order; line_no orders ties ("later line wins", W3).
    lines = _numbered(spark, path).where(F.trim("value") != "")
    parsed = lines.select("value", "line_no", F.from_json("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    ok = parsed["r"].isNotNull() & parsed["r"][corrupt].isNull()
    good = parsed.where(ok).select("r.*", "line_no").drop(corrupt)
    bad = parsed.where(~ok).select(F.col("value").alias(corrupt))
    return good, bad


CORRECTIONS_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("human_label", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("model_labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("corrected_at", T.StringType()),
])
AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
])


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """One lower-cased, trimmed address per line; '#' comments and blanks ignored."""
    return _lines(spark, path).select(F.lower(F.trim("value")).alias("email")).distinct()


def read_noisy_senders(spark: SparkSession, path: str) -> DataFrame:
    """(address, exclude_keywords): 'address' or 'address<TAB>kw1,kw2'."""
    parts = F.split(F.col("value"), "\t", 2)
    kws = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), ","), lambda k: F.trim(k)),
                   lambda k: k != "")
    return (_lines(spark, path)
            .select(F.lower(F.trim(F.try_element_at(parts, F.lit(1)))).alias("address"), kws.alias("exclude_keywords"), "line_no")
            .where(F.col("address") != ""))


def read_tab_rows(spark: SparkSession, path: str) -> DataFrame:
    """S6: 'name<TAB>rest' rows in file order; rows without a tab are dropped."""
    parts = F.split(F.col("value"), "\t", 2)
    return (_lines(spark, path).where(F.size(parts) == 2)
            .select("line_no", F.trim(F.try_element_at(parts, F.lit(1))).alias("name"), F.trim(F.try_element_at(parts, F.lit(2))).alias("rest"))
            .where(F.col("name") != ""))


def industry_rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """S6 as a table (see ``operators.rule_index``): (line_no, name, fields) of each industry line, without the driver."""
    words = F.filter(F.split("rest", "\\s+"), lambda x: x != "")
    return (read_tab_rows(spark, path).where(F.size(words) > 0)
            .select("line_no", "name", F.to_json(F.struct(words.alias("from_any"))).alias("fields")))


def keep_rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """S6 as a table: (line_no, name, fields) of each keep rule; its fragment is read where the line is.  Bad fragments fail."""
    import json

    @F.udf("string")
    def fields(rest):
        return json.dumps(_fragment(rest))
    return read_tab_rows(spark, path).select("line_no", "name", fields("rest").alias("fields"))


def _collect_config(df: DataFrame) -> list:
    """Rows of a rule file, in line order (rules are conditions of the plan, so the driver holds them)."""
    return df.orderBy("line_no").collect()


def industry_rows(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Industry-sender file -> [(label, [addresses])] (addresses separated by spaces)."""
    return [(r.name, [a for a in r.rest.split() if a]) for r in _collect_config(read_tab_rows(spark, path))]


def keep_rules(spark: SparkSession, path: str, mode: str) -> list[Rule]:
    """Keep-rule file -> typed rules for rescue (mode='rescue') or reference labelling.

    A fragment is one or more fields (``_fragment``): from, subject, category
    and label terms, ages and states; anything else is rejected.
    """
    out = []
    for r in _collect_config(read_tab_rows(spark, path)):
        fields = _fragment(r.rest)
        if mode == "rescue":
            out.append(Rule(r.name, **{"in_trash": True, **fields}))
        else:
            out.append(Rule(r.name, **{"not_reference": True, "in_trash": False, **fields}))
    return out


_FIELD = re.compile(r"""(-?)([a-z_]+):(\([^)]*\)|"[^"]*"|\S+)\s*""")
# Flags that a fragment may ask for or exclude.
_STATES = {"is:starred": "starred", "is:important": "important", "in:sent": "sent", "in:chats": "chats", "in:inbox": "in_inbox",
           "in:trash": "in_trash", "is:unread": "unread"}


def _terms(v: str) -> tuple[str, ...]:
    v = v.strip()
    if v.startswith("(") and v.endswith(")"):
        v = v[1:-1]
    return tuple(t.strip().strip('"') for t in v.split(" OR ") if t.strip())


def _fragment(frag: str) -> dict:
    """The fields of a fragment such as ``from:(a OR b) subject:"c d" older_than:1y -is:starred``."""
    out: dict = {}
    at, frag = 0, frag.strip()
    while at < len(frag):
        m = _FIELD.match(frag, at)
        if not m:
            raise ValueError(f"unsupported keep-rule fragment: {frag[at:]!r} in {frag!r}")
        minus, name, value = bool(m[1]), m[2], m[3]
        state = f"{name}:{value.lower()}"
        if name in ("from", "subject", "category", "label") and not (minus and name == "from"):
            out[f"{name}_{'none' if minus else 'any'}"] = _terms(value)
        elif name in ("older_than", "newer_than") and not minus:
            out[name] = value
        elif state == "is:read":
            out["unread"] = minus
        elif state in _STATES:
            out[_STATES[state]] = not minus
        else:
            raise ValueError(f"unsupported keep-rule field: {m[0].strip()!r} in {frag!r}")
        at = m.end()
    if not out:
        raise ValueError("empty keep-rule fragment")
    return out


def build_contacts(connections: DataFrame, other: DataFrame) -> DataFrame:
    """Union of the two contact exports' addresses, lower-cased, distinct, sorted.

    Each input has an ``emailAddresses`` array of structs with ``value``;
    either may be empty (one source failing still yields the other).
    """
    def emails(df: DataFrame) -> DataFrame:
        return (df.select(F.explode_outer("emailAddresses").alias("e"))
                  .select(F.col("e.value").alias("email")).where(F.col("email").isNotNull() & (F.col("email") != "")))
    return (emails(connections).unionByName(emails(other))
            .select(F.lower("email").alias("email")).distinct().orderBy("email"))


PROMPT_SCHEMA = "version string, system_prompt string, keep_criteria array<string>, delete_criteria array<string>, output_format string"


def read_prompts(spark: SparkSession, directory: str, version: str | None = None) -> DataFrame:
    """Prompt catalogue (one YAML file per version) as a small dimension table.

    Raises when a file's ``version`` differs from its file name.
    """
    import yaml
    rows = []
    files = (spark.read.text(directory, wholetext=True, pathGlobFilter="*.yaml")
             .select(F.col("_metadata.file_name").alias("name"), "value"))
    for fn, text in sorted(tuple(r) for r in files.collect()):               # a file a version, on any storage that Spark reads
        d = yaml.safe_load(text)
        if d.get("version") != fn[:-5]:
            raise ValueError(f"{fn}: version {d.get('version')!r} does not match the file name")
        if version is None or d["version"] == version:
            rows.append((d["version"], d.get("system_prompt"), d.get("keep_criteria"), d.get("delete_criteria"),
                         d.get("output_format")))
    return spark.createDataFrame(rows, PROMPT_SCHEMA)
