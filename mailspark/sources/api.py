"""Mailbox-API message JSON (S7) with its native extraction columns.

The nested message (id, threadId, labelIds, payload.headers[], payload.parts[])
is read with an explicit schema; every extraction is a native expression:
headers become a lower-cased map (FIRST value of a repeated header wins),
the sender address is a regex extract, the body is the first HTML part, else
the first plain part before it, else the payload body, base64url-decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import REFERENCE_LABELS

_BODY = T.StructType([T.StructField("data", T.StringType())])
_PART = T.StructType([T.StructField("mimeType", T.StringType()), T.StructField("body", _BODY)])
_HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
API_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("threadId", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("payload", T.StructType([
        T.StructField("mimeType", T.StringType()),
        T.StructField("headers", T.ArrayType(_HEADER)),
        T.StructField("body", _BODY),
        T.StructField("parts", T.ArrayType(_PART)),
    ])),
])
SENDER_RE = "[^<\\s]+@[^>\\s]+"


def read_api_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_SCHEMA).json(path)


def header_map(headers: Column) -> Column:
    """Lower-cased header name -> value; the first occurrence of a name wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(F.coalesce(headers, F.array().cast(T.ArrayType(_HEADER))), empty,
                       lambda acc, h: F.when(F.array_contains(F.map_keys(acc), F.lower(h["name"])), acc)
                       .otherwise(F.map_concat(acc, F.create_map(F.lower(h["name"]), h["value"]))))


def sender_email(from_raw: Column, fallback: bool = True) -> Column:
    """First address-looking token, lower-cased; else the whole header lower-cased."""
    e = F.lower(F.regexp_extract(from_raw, SENDER_RE, 0))
    e = F.regexp_replace(e, "^[<>]+|[<>]+$", "")
    return F.when(e != "", e).otherwise(F.lower(from_raw) if fallback else F.lit(""))


def b64url_text(data: Column) -> Column:
    """Text of base64url data; bytes that are no UTF-8 are replaced, data that is no base64 gives ''."""
    plain = F.regexp_replace(F.translate(data, "-_", "+/"), "[=\\s]+", "")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    text = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(F.coalesce(data, F.lit("")) != "", F.coalesce(text, F.lit("")))


def api_body(payload: Column) -> Column:
    """First html part's body; else the first plain part before it; else payload.body."""
    parts = F.coalesce(payload["parts"], F.array().cast(T.ArrayType(_PART)))
    idx = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    html = F.filter(idx, lambda x: x["p"]["mimeType"] == "text/html")
    html_i = F.coalesce(F.try_element_at(html, F.lit(1))["i"], F.size(parts))
    html_body = b64url_text(F.try_element_at(html, F.lit(1))["p"]["body"]["data"])
    plain = F.filter(idx, lambda x: (x["p"]["mimeType"] == "text/plain") & (x["i"] < html_i)
                     & (F.coalesce(x["p"]["body"]["data"], F.lit("")) != ""))
    plain_body = b64url_text(F.try_element_at(plain, F.lit(1))["p"]["body"]["data"])
    from_parts = F.coalesce(html_body, plain_body, F.lit(""))
    return F.when(F.size(parts) > 0, from_parts).otherwise(F.coalesce(b64url_text(payload["body"]["data"]), F.lit("")))


def api_to_messages(api: DataFrame) -> DataFrame:
    """API messages -> the columns the live path needs."""
    h = header_map(F.col("payload.headers"))
    labels = F.coalesce(F.col("labelIds"), F.array().cast("array<string>"))
    return api.select(
        F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), labels.alias("label_ids"),
        sender_email(F.coalesce(F.try_element_at(h, F.lit("from")), F.lit(""))).alias("from_email"),
        F.lit("").alias("from_name"),
        F.coalesce(F.try_element_at(h, F.lit("subject")), F.lit("(no subject)")).alias("subject"),
        F.coalesce(F.try_element_at(h, F.lit("date")), F.lit("")).alias("date_str"),
        api_body(F.col("payload")).alias("body_text"),
        F.arrays_overlap(labels, F.array(*[F.lit(x) for x in REFERENCE_LABELS])).alias("has_reference"))
