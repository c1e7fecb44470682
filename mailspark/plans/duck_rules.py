"""DuckDB text of a ``Rule`` predicate: used only to build oracle SQL."""

from __future__ import annotations

import re

from ..functions.predicates import REFERENCE_LABELS, SYSTEM_LABELS, Rule, cutoff_epoch


def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _flag(c: str, v: int) -> str:
    return f"coalesce({c}, 0) = {v}"


def _subject(terms) -> str:
    alts = "|".join(re.escape(t.lower()).replace("\\ ", " ") for t in terms)
    pat = f"(^|[^\\p{{L}}\\p{{N}}])(?:{alts})([^\\p{{L}}\\p{{N}}]|$)"
    return f"coalesce(regexp_matches(lower(subject), '{pat}'), false)"


def _sender(terms) -> str:
    parts = []
    for t in terms:
        t = t.lower()
        if "@" in t:
            parts.append(f"lower(from_email) = '{t}'")
        else:
            parts.append(f"ends_with(lower(from_email), '@{t}') OR ends_with(lower(from_email), '.{t}')")
    return "coalesce(" + " OR ".join(f"({p})" for p in parts) + ", false)"


def _has(names) -> str:
    return f"list_has_any(coalesce(labels, CAST([] AS VARCHAR[])), {_lst(names)})"


def predicate(r: Rule, as_of: int) -> str:
    c = []
    if r.category_any:
        c.append(f"coalesce(lower(category) IN ({', '.join(repr(x.lower()) for x in r.category_any)}), false)")
    if r.category_none:
        c.append(f"NOT coalesce(lower(category) IN ({', '.join(repr(x.lower()) for x in r.category_none)}), false)")
    if r.older_than:
        c.append(f"coalesce(date_ts < {cutoff_epoch(as_of, r.older_than)}, false)")
    if r.newer_than:
        c.append(f"coalesce(date_ts >= {cutoff_epoch(as_of, r.newer_than)}, false)")
    if r.unread is not None:
        c.append(_flag("is_unread", 1 if r.unread else 0))
    if r.in_trash is not None:
        c.append(_flag("in_trash", 1 if r.in_trash else 0))
    if r.in_inbox is not None:
        c.append(_flag("in_inbox", 1 if r.in_inbox else 0))
    if r.not_starred:
        c.append(_flag("is_starred", 0))
    if r.not_important:
        c.append(_flag("is_important", 0))
    if r.not_reference:
        c.append(f"NOT {_has(REFERENCE_LABELS)}")
    if r.not_sent:
        c.append(_flag("in_sent", 0))
    if r.not_chats:
        c.append(f"NOT {_has(['Chats'])}")
    for want, column in ((r.starred, "is_starred"), (r.important, "is_important"), (r.sent, "in_sent")):
        if want is not None:
            c.append(_flag(column, 1 if want else 0))
    if r.chats is not None:
        c.append(("" if r.chats else "NOT ") + _has(["Chats"]))
    if r.label_any:
        c.append(_has(r.label_any))
    if r.label_none:
        c.append(f"NOT {_has(r.label_none)}")
    if r.no_user_labels:
        c.append("len(list_filter(coalesce(labels, CAST([] AS VARCHAR[])), lambda x: NOT starts_with(x, 'Category ') "
                 f"AND NOT list_contains({_lst(SYSTEM_LABELS)}, x))) = 0")
    if r.from_any:
        c.append(_sender(r.from_any))
    if r.subject_any:
        c.append(_subject(r.subject_any))
    if r.subject_none:
        c.append(f"NOT {_subject(r.subject_none)}")
    if r.smaller_than is not None:
        c.append(f"coalesce(body_size_bytes < {r.smaller_than}, false)")
    return "(" + (" AND ".join(c) if c else "true") + ")"


def first_match(rules, as_of: int) -> str:
    return "CASE " + " ".join(f"WHEN {predicate(r, as_of)} THEN {i}" for i, r in enumerate(rules, 1)) + " END"


def names(rules) -> str:
    return _lst([r.name for r in rules])
