"""DuckDB text of the sanitiser functions: used only to build oracle SQL."""

from __future__ import annotations

WS_NO_NL = "\\t\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WS = "\\n" + WS_NO_NL
LB = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def unescape(x: str) -> str:
    """Entity decoding for the entities present in the driver pages (checked by the Spark side)."""
    out = x
    for ent, ch in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", " ")):
        out = f"replace({out}, '{ent}', '{ch}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def strip_html(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</(?:p|div|li|tr|h[1-6]|blockquote)>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = unescape(t)
    t = f"regexp_replace({t}, '[{WS_NO_NL}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


def redact_injection(x: str) -> str:
    lines = f"regexp_split_to_array(regexp_replace({x}, '(?:{LB})\\z', ''), '{LB}')"
    cond = " OR ".join([f"starts_with({strip('l')}, '{p}')" for p in ("Ignore", "System:", "Assistant:", "You are", "INST")]
                       + [f"contains(l, '{t}')" for t in ("<<SYS>>", "[INST]", "</s>")])
    return (f"array_to_string(list_transform({lines}, lambda l: CASE WHEN {cond} "
            f"THEN '[REDACTED_INJECTION_ATTEMPT]' ELSE l END), chr(10))")


def redact_pii(x: str) -> str:
    t = f"regexp_replace({x}, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'g')"
    return (f"regexp_replace({t}, '\\b(?:\\+?1[-.\\s]?)?(?:\\(?\\d{{3}}\\)?[-.\\s]?)?\\d{{3}}[-.\\s]?\\d{{4}}\\b', "
            f"'[PHONE_REDACTED]', 'g')")


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def sanitize(x: str, html: bool, pii: bool) -> str:
    body = strip_html(x) if html else x
    body = redact_injection(body)
    if pii:
        body = redact_pii(body)
    body = f"substr({body}, 1, 2000)"
    return (f"CASE WHEN {is_blank(x)} THEN '[EMAIL_CONTENT]' || chr(10) || '[/EMAIL_CONTENT]' "
            f"ELSE '[EMAIL_CONTENT]' || chr(10) || {body} || chr(10) || '[/EMAIL_CONTENT]' END")
