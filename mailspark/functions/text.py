"""Text functions (F1-F7, F16): sanitising untrusted mail text for a classifier.

Everything is native Spark (``regexp_replace`` / ``split`` / ``transform`` /
``from_json``) except HTML entity decoding, which has no native equivalent:
``html_unescape`` is an Arrow-batched pandas UDF and only rows that contain
'&' are sent to Python (the others cross as NULLs, which cost nothing).

Python's string semantics are kept where they matter: ``str.strip`` /
``\\s`` cover Unicode whitespace, ``str.splitlines`` splits on more than
``\\n``, and ``len`` counts code points (as Spark's ``substring`` does).
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import col, ship_package

# Python's whitespace (str.isspace) as a Java character class body, without and with '\n'.
_WS_NO_NL = "\\t\\x0B\\f\\r \\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_WS = "\\n" + _WS_NO_NL
# str.splitlines boundaries, '\r\n' as one; begins with the character class, so that a place without a break fails at once.
LINE_BREAK = "[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029](?:(?<=\\r)\\n)?"

# Injection markers and redaction texts.
INJECTION_PREFIXES = ["Ignore", "System:", "Assistant:", "You are", "INST"]
INJECTION_TOKENS = ["<<SYS>>", "[INST]", "</s>"]
REDACTED = "[REDACTED_INJECTION_ATTEMPT]"
EMAIL_RE = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE_RE = r"(?U)\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
EMAIL_REDACTED = "[EMAIL_REDACTED]"
PHONE_REDACTED = "[PHONE_REDACTED]"
BODY_MAX_CHARS = 2000
CONTENT_OPEN = "[EMAIL_CONTENT]"
CONTENT_CLOSE = "[/EMAIL_CONTENT]"
REVIEW_BODY_CHARS = 400

# HTML patterns.
SCRIPT_STYLE_RE = "(?is)<(script|style)[^>]*>.*?</(script|style)>"
BR_RE = "(?i)<br\\s*/?>"
BLOCK_END_RE = "(?i)</(?:p|div|li|tr|h[1-6]|blockquote)>"
TAG_RE = "<[^>]+>"


def py_strip(c) -> Column:
    """``str.strip()``: remove Python whitespace at both ends."""
    return F.regexp_replace(col(c), f"^[{_WS}]+|[{_WS}]+$", "")


def is_blank(c) -> Column:
    """``not text or not text.strip()``: no non-whitespace character at all."""
    return F.coalesce(~col(c).rlike(f"[^{_WS}]"), F.lit(True))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else None)


def html_unescape(c) -> Column:
    """HTML entity decoding (Python ``html.unescape``) for rows containing '&'."""
    ship_package()
    x = col(c)
    return F.coalesce(_unescape(F.when(x.contains("&"), x)), x)


def strip_html(c, unescape: bool = True) -> Column:
    """HTML -> plain text keeping paragraph breaks as newlines."""
    t = F.regexp_replace(col(c), SCRIPT_STYLE_RE, " ")
    t = F.regexp_replace(t, BR_RE, "\n")
    t = F.regexp_replace(t, BLOCK_END_RE, "\n")
    t = F.regexp_replace(t, TAG_RE, " ")
    if unescape:
        t = html_unescape(t)
    t = F.regexp_replace(t, f"[{_WS_NO_NL}]+", " ")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return py_strip(t)


# One line (after normalising every splitlines() break to '\n') that starts, after
# leading whitespace, with an injection prefix, or contains an injection token.
_REDACT_RE = ("(?m)^(?:[" + _WS_NO_NL + "]*(?:" + "|".join(re.escape(p) for p in INJECTION_PREFIXES) + ")"
              + "|.*(?:" + "|".join(re.escape(t) for t in INJECTION_TOKENS) + ")).*$")


def normalize_lines(c) -> Column:
    """``'\n'.join(text.splitlines())``: every line break becomes '\n', one trailing break dropped."""
    return F.regexp_replace(F.regexp_replace(col(c), LINE_BREAK, "\n"), "\n\\z", "")


def redact_injection(c) -> Column:
    """replace every line carrying an injection marker by the redaction text.

    Two codegen'd regex passes over the whole text (no per-line lambdas):
    normalise the line breaks as ``str.splitlines`` sees them, then replace
    each offending line in multiline mode.
    """
    return F.regexp_replace(normalize_lines(c), _REDACT_RE, REDACTED.replace("[", "\\[").replace("]", "\\]"))


def redact_pii(c) -> Column:
    """e-mail addresses and US phone numbers -> placeholders."""
    t = F.regexp_replace(col(c), EMAIL_RE, EMAIL_REDACTED)
    return F.regexp_replace(t, PHONE_RE, PHONE_REDACTED)


def truncate_body(c, n: int = BODY_MAX_CHARS) -> Column:
    """first ``n`` code points."""
    return F.substring(col(c), 1, n)


def sanitize(c, strip_html_first: bool = True, pii: bool = False) -> Column:
    """strip -> redact injection -> (PII) -> truncate -> wrap in content delimiters."""
    body = col(c)
    if strip_html_first:
        body = strip_html(body)
    body = redact_injection(body)
    if pii:
        body = redact_pii(body)
    body = truncate_body(body)
    wrapped = F.concat(F.lit(CONTENT_OPEN + "\n"), body, F.lit("\n" + CONTENT_CLOSE))
    return F.when(is_blank(c), F.lit(CONTENT_OPEN + "\n" + CONTENT_CLOSE)).otherwise(wrapped)


def _or_default(c, default: str) -> Column:
    x = col(c)
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(x)


def build_user_turn(from_email, from_name, subject, date_str, sanitized) -> Column:
    """'From: …\\nSubject: …\\nDate: …\\n\\n<sanitised body>' with the reference's defaults."""
    sender = F.coalesce(F.when(col(from_email) != "", col(from_email)),
                        F.when(col(from_name) != "", col(from_name)), F.lit("(unknown)"))
    return F.concat(F.lit("From: "), sender, F.lit("\nSubject: "), _or_default(subject, "(no subject)"),
                    F.lit("\nDate: "), F.coalesce(col(date_str), F.lit("")), F.lit("\n\n"), col(sanitized))


def body_preview(c, n: int = REVIEW_BODY_CHARS) -> tuple[Column, Column]:
    """F16: (preview text, truncated flag): sanitised body without delimiters, first n chars."""
    s = sanitize(c, strip_html_first=False)
    body = py_strip(F.replace(F.replace(s, F.lit(CONTENT_OPEN), F.lit("")), F.lit(CONTENT_CLOSE), F.lit("")))
    return F.substring(body, 1, n), F.length(body) > n


# ------------------------------------------------------------ F7 responses
_RESP_SCHEMA = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
LABELS = ("keep", "delete", "uncertain")


def _parse(text: Column) -> Column:
    # what is no object cannot be read as one; the parser's exception a row would cost more than all else
    return F.when(text.startswith("{"), F.from_json(text, _RESP_SCHEMA, _JSON_OPTS))


def _ok(parsed: Column) -> Column:
    return parsed.isNotNull() & parsed["_corrupt"].isNull()


def parse_label_responses(df, raw: str = "raw_response", prefix: str = ""):
    """model replies -> columns label, confidence, reason, error (added to ``df``).

    Attempts, in order: the fence-stripped text; the text up to its last
    '}'; the same with a '"' inserted before that brace when missing.
    Labels are lower-cased and anything outside keep/delete/uncertain
    becomes 'uncertain' (Q11); no parse -> 'uncertain' + 'json_parse_error'.

    Every intermediate is its own projection step, so each regex / JSON
    parse runs once per row (composing them as one expression would repeat
    the shared sub-expressions in every branch).
    """
    c = F.col
    x = df.withColumn("_t0", py_strip(raw))
    nl = F.instr(c("_t0"), "\n")
    x = x.withColumn("_fb", F.when(c("_t0").startswith("```"),
                                   F.when(nl > 0, F.substring(c("_t0"), nl + 1, 1 << 30))
                                    .otherwise(F.substring(c("_t0"), 4, 1 << 30))))
    x = x.withColumn("_t", F.when(c("_fb").isNull(), c("_t0")).otherwise(py_strip(
        F.when(c("_fb").endswith("```"), F.substring(c("_fb"), 1, F.length(c("_fb")) - 3)).otherwise(c("_fb")))))
    rpos = F.instr(F.reverse(c("_t")), "}")
    x = x.withColumn("_lb", F.when(rpos > 0, F.length(c("_t")) - rpos + 1))   # 1-based last '}'
    x = x.withColumn("_p1", _parse(c("_t")))
    x = x.withColumn("_p2", F.when(~_ok(c("_p1")) & (c("_lb") > 1), _parse(F.substring(c("_t"), 1, c("_lb")))))
    quoted = F.concat(F.substring(c("_t"), 1, c("_lb") - 1), F.lit('"'), F.substring(c("_t"), c("_lb"), 1 << 30))
    x = x.withColumn("_p3", F.when(~_ok(c("_p1")) & ~F.coalesce(_ok(c("_p2")), F.lit(False)) & (c("_lb") > 1)
                                   & (F.substring(c("_t"), c("_lb") - 1, 1) != '"'), _parse(quoted)))
    x = x.withColumn("_p", F.when(_ok(c("_p1")), c("_p1")).when(_ok(c("_p2")), c("_p2")).when(_ok(c("_p3")), c("_p3")))
    lab = F.lower(c("_p")["label"])
    x = x.withColumns({
        prefix + "label": F.when(c("_p").isNull(), F.lit("uncertain")).when(lab.isin(*LABELS), lab)
                           .otherwise(F.lit("uncertain")),
        prefix + "confidence": c("_p")["confidence"].try_cast("double"),
        prefix + "reason": c("_p")["reason"],
        prefix + "error": F.when(c("_p").isNull(), F.lit("json_parse_error")),
    })
    return x.drop("_t0", "_fb", "_t", "_lb", "_p1", "_p2", "_p3", "_p")
