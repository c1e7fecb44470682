"""Rule vocabulary (P1-P12): a typed rule row and its ``Column`` predicate.

A rule is data (a ``Rule``), never a query string: every field maps to one
native Spark predicate, so rule matching stays inside whole-stage codegen and
simple comparisons (dates, flags, sizes) push down to the Parquet scan.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import col

# Labels that are not user labels (P10); 'Category …' labels are system too.
SYSTEM_LABELS = ["Inbox", "Unread", "Important", "Starred", "Sent", "Trash", "Spam", "Draft",
                 "Opened", "Archived", "Chats"]
REFERENCE_LABELS = ["Reference", "Label_Reference"]
MIB = 1048576


@dataclass(frozen=True)
class Rule:
    name: str
    category_any: tuple[str, ...] = ()
    category_none: tuple[str, ...] = ()
    older_than: str | None = None
    newer_than: str | None = None
    unread: bool | None = None          # True: is:unread, False: is:read
    in_trash: bool | None = None        # True: in:trash, False: -in:trash
    in_inbox: bool | None = None
    not_starred: bool = False
    not_important: bool = False
    not_reference: bool = False
    not_sent: bool = False
    not_chats: bool = False
    no_user_labels: bool = False
    from_any: tuple[str, ...] = ()
    subject_any: tuple[str, ...] = ()
    subject_none: tuple[str, ...] = ()
    smaller_than: int | None = None
    starred: bool | None = None         # True: is:starred, False: -is:starred
    important: bool | None = None
    sent: bool | None = None
    chats: bool | None = None
    label_any: tuple[str, ...] = ()
    label_none: tuple[str, ...] = ()


def parse_age(spec: str) -> tuple[int, str]:
    """'7d' -> (7, 'd'); units d, m (months), y (years)."""
    mt = re.fullmatch(r"\s*(\d+)\s*([dmy])\s*", spec)
    if not mt:
        raise ValueError(f"bad age: {spec!r}")
    return int(mt.group(1)), mt.group(2)


def parse_size(spec: str | int) -> int:
    """'1M' -> 1048576 bytes; K and M are binary units."""
    if isinstance(spec, int):
        return spec
    mt = re.fullmatch(r"\s*(\d+)\s*([kKmM]?)\s*", spec)
    if not mt:
        raise ValueError(f"bad size: {spec!r}")
    mult = {"": 1, "k": 1024, "m": MIB}[mt.group(2).lower()]
    return int(mt.group(1)) * mult


def cutoff_epoch(as_of_epoch: int, spec: str) -> int:
    """Epoch of ``as_of - spec`` with calendar months/years (day clamped to month end)."""
    n, unit = parse_age(spec)
    t = dt.datetime.fromtimestamp(as_of_epoch, tz=dt.timezone.utc)
    if unit == "d":
        return as_of_epoch - n * 86400
    months = n if unit == "m" else 12 * n
    y, mth = divmod(t.year * 12 + (t.month - 1) - months, 12)
    day = min(t.day, calendar.monthrange(y, mth + 1)[1])
    return int(t.replace(year=y, month=mth + 1, day=day).timestamp())


def _flag_is(c: str, v: int) -> Column:
    return F.coalesce(col(c), F.lit(0)) == v


def has_label(names: list[str], labels: str = "labels") -> Column:
    """Any of ``names`` present (NULL label array = none)."""
    arr = F.coalesce(col(labels), F.array().cast("array<string>"))
    return F.arrays_overlap(arr, F.array(*[F.lit(x) for x in names])) if names else F.lit(False)


def no_user_labels(labels: str = "labels") -> Column:
    """P10: only system labels and 'Category …' labels."""
    arr = F.coalesce(col(labels), F.array().cast("array<string>"))
    user = F.filter(arr, lambda x: ~x.startswith("Category ") & ~x.isin(*SYSTEM_LABELS))
    return F.size(user) == 0


def phrase_pattern(terms) -> str:
    """Whole-token, case-insensitive alternation of literal phrases."""
    alts = "|".join(re.escape(t.lower()).replace("\\ ", " ") for t in terms)
    return f"(?<![\\p{{L}}\\p{{N}}])(?:{alts})(?![\\p{{L}}\\p{{N}}])"


def subject_any(terms, subject: str = "subject") -> Column:
    """Subject contains any phrase as whole tokens (NULL subject never matches)."""
    return F.coalesce(F.lower(col(subject)).rlike(phrase_pattern(terms)), F.lit(False))


def subject_none(terms, subject: str = "subject") -> Column:
    """No phrase present; a NULL subject passes."""
    return ~subject_any(terms, subject)


def sender_any(terms, email: str = "from_email") -> Column:
    """Exact address (term with '@') or address in a domain / sub-domain."""
    e = F.lower(col(email))
    conds = []
    for t in terms:
        t = t.lower()
        if "@" in t:
            conds.append(e == t)
        else:
            conds.append(e.endswith("@" + t) | e.endswith("." + t))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def category_is(cats, category: str = "category") -> Column:
    return F.coalesce(F.lower(col(category)).isin(*[c.lower() for c in cats]), F.lit(False))


def rule_predicate(r: Rule, as_of_epoch: int, date: str = "date_ts") -> Column:
    """The conjunction of every field set on ``r`` (NULL-safe: never NULL)."""
    conds: list[Column] = []
    if r.category_any:
        conds.append(category_is(r.category_any))
    if r.category_none:
        conds.append(~category_is(r.category_none))
    if r.older_than:
        conds.append(F.coalesce(col(date) < F.lit(cutoff_epoch(as_of_epoch, r.older_than)), F.lit(False)))
    if r.newer_than:
        conds.append(F.coalesce(col(date) >= F.lit(cutoff_epoch(as_of_epoch, r.newer_than)), F.lit(False)))
    if r.unread is not None:
        conds.append(_flag_is("is_unread", 1 if r.unread else 0))
    if r.in_trash is not None:
        conds.append(_flag_is("in_trash", 1 if r.in_trash else 0))
    if r.in_inbox is not None:
        conds.append(_flag_is("in_inbox", 1 if r.in_inbox else 0))
    if r.not_starred:
        conds.append(_flag_is("is_starred", 0))
    if r.not_important:
        conds.append(_flag_is("is_important", 0))
    if r.not_reference:
        conds.append(~has_label(REFERENCE_LABELS))
    if r.not_sent:
        conds.append(_flag_is("in_sent", 0))
    if r.not_chats:
        conds.append(~has_label(["Chats"]))
    for want, column in ((r.starred, "is_starred"), (r.important, "is_important"), (r.sent, "in_sent")):
        if want is not None:
            conds.append(_flag_is(column, 1 if want else 0))
    if r.chats is not None:
        conds.append(has_label(["Chats"]) if r.chats else ~has_label(["Chats"]))
    if r.label_any:
        conds.append(has_label(list(r.label_any)))
    if r.label_none:
        conds.append(~has_label(list(r.label_none)))
    if r.no_user_labels:
        conds.append(no_user_labels())
    if r.from_any:
        conds.append(sender_any(r.from_any))
    if r.subject_any:
        conds.append(subject_any(r.subject_any))
    if r.subject_none:
        conds.append(subject_none(r.subject_none))
    if r.smaller_than is not None:
        conds.append(F.coalesce(col("body_size_bytes") < F.lit(r.smaller_than), F.lit(False)))
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out
