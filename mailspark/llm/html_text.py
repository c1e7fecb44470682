"""Main text of web pages by a maximum-scoring subsequence.

A page is a row of tokens: words and tags.  Words score positive, by the
element that holds them; tags score negative, by their name and class.  A
linear scan finds the contiguous region with the best sum, and the region's
text, block by block, is the page's text.

The weights come from labelled pages: pages that mark their article with an
``article`` element.  Over all of them Spark counts, for each kind of token,
how often it lies inside and outside of the article; a weight is the log of
that ratio, held positive for words and negative for tags.  Kinds never seen
have fixed weights.  Kinds are hashed to ``KINDS`` numbers, so the table that
tasks receive is bounded.

Inside the region, elements that are not article text by their name or by
their class, id or role (navigation, asides, notices, adverts, forms,
comments, scripts, styles) are left out.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one line end.  Line breaks end a block.

Cases: null and empty pages have an empty text; repeated rows and null ids are
answered row by row; an unfinished tag at a page's end is dropped; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ids as column_ids
from .base import prepare, text_slices

#: Numbers that kinds of tokens are hashed to.
KINDS = 4096
#: Least size of a weight, and most.
LEAST, MOST = 0.05, 8.0
#: Weights of kinds that no labelled page has.
NEW_WORD, NEW_TAG, NEW_OUTER_TAG = 1.0, -1.0, -4.0

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img".split())
RAW = frozenset("script style noscript template svg math iframe object select textarea title".split())
OUTER = frozenset("nav aside header footer form button menu dialog fieldset head".split()) | RAW
LABEL = "article"
_OUTER_ROLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|disqus|footer|masthead|menu\w*|nav\w*|newsletter|"
    r"notice\w*|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar\w*|social|sponsor\w*|subscribe|widget\w*)"
    r"(?:$|[\s_-])", re.I)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*>|[^>]*(?:>|\Z))""", re.S)
_ROLE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def _kind(text: str) -> int:
    return zlib.crc32(text.encode()) % KINDS


class Page:
    """Tokens of a page in order: (kind, words, text, outer, breaks, label).

    words: 0 for a tag, otherwise the words of a stretch of text; outer: not
    article text by its elements; breaks: a tag that ends a block; label: the
    token lies in the first article element.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[int, int, str, bool, bool, bool]] = []
        self.labelled = False
        stack: list[tuple[str, bool, int]] = []              # name, outer, kind of its words
        outer = inside = 0
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self._text(source[at:m.start()], stack, outer, inside)
            at = m.end()
            if m[2] is None or m[0][-1] != ">":
                continue
            name = m[2].lower()
            breaks = name not in INLINE
            if m[1]:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if k >= 0:
                    for gone, was, _ in stack[k:]:
                        outer -= was
                        inside -= gone == LABEL and not was
                    del stack[k:]
                self.tokens.append((_kind("/" + name), 0, "", outer > 0, breaks, inside > 0))
                continue
            roles = " ".join(a or b or c for a, b, c in _ROLE.findall(m[3]))
            if breaks:                                       # a block ends a paragraph and what is open in it
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    _, was, _ = stack.pop()
                    outer -= was
            own = name + "." + roles.split()[0] if roles else name
            self.tokens.append((_kind(own), 0, "", outer > 0, breaks, inside > 0))
            if name in VOID or m[3].endswith("/>"):
                continue
            off = name in OUTER or bool(roles and _OUTER_ROLE.search(roles))
            outer += off
            if name == LABEL and not off:
                inside += 1
                self.labelled = True
            stack.append((name, off, _kind("word in " + own) if breaks or not stack else stack[-1][2]))
            if name in RAW:                                  # its content is no markup
                end = re.compile(f"</{re.escape(name)}\\b", re.I).search(source, at)
                stop = end.start() if end else n
                if stop > at:
                    self._text(source[at:stop], stack, outer, inside)
                at = stop
        else:
            return
        if at < n:
            self._text(source[at:], stack, outer, inside)

    def _text(self, text, stack, outer, inside):
        text = html.unescape(text)
        self.tokens.append((stack[-1][2] if stack else _kind("word"), len(text.split()), text, outer > 0, False, inside > 0))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Uses of each kind inside and outside of the labelled article."""
        out = np.zeros((2, KINDS))
        for kind, words, text, outer, _, label in self.tokens:
            if words or not text:
                out[0 if label and not outer else 1, kind] += max(words, 1)
        return out[0], out[1]

    def region(self, weights: "Weights") -> tuple[int, int]:
        """The contiguous tokens [a, b) with the best sum."""
        best = total = 0.0
        a = b = start = 0
        for i, (kind, words, text, outer, _, _) in enumerate(self.tokens):
            if words:
                total += 0.0 if outer else words * weights.words[kind]
            elif not text:
                total += weights.outer_tags[kind] if outer else weights.tags[kind]
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, a, b = total, start, i + 1
        return a, b

    def text(self, weights: "Weights") -> str:
        a, b = self.region(weights)
        blocks, part = [], []
        for _, words, text, outer, breaks, _ in self.tokens[a:b]:
            if text:
                if not outer:
                    part.append(text)
            elif breaks and part:
                blocks.append(" ".join("".join(part).split()))
                part = []
        blocks.append(" ".join("".join(part).split()))
        return "\n".join(x for x in blocks if x)


class Weights:
    def __init__(self, inside: np.ndarray, outside: np.ndarray):
        seen = inside + outside > 0
        odds = np.log((inside + 0.1) / (outside + 0.1))
        self.words = np.where(seen, np.clip(odds, LEAST, MOST), NEW_WORD).tolist()
        self.tags = np.where(seen, np.clip(odds, -MOST, -LEAST), NEW_TAG).tolist()
        self.outer_tags = np.where(seen, np.clip(odds, -MOST, -LEAST), NEW_OUTER_TAG).tolist()


def fit(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages."""
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            inside, outside = np.zeros(KINDS), np.zeros(KINDS)
            for _, _, texts in text_slices(batch, html_col):
                for t in texts.to_pylist():
                    p = Page(t)
                    if p.labelled:
                        x, y = p.counts()
                        inside += x
                        outside += y
            used = np.flatnonzero(inside + outside)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(inside[used]), pa.array(outside[used])],
                                             ["kind", "inside", "outside"])
    rows = (pages.select(html_col).mapInArrow(run, "kind int, inside double, outside double")
            .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())  # KINDS rows at most
    counts = np.zeros((2, KINDS))
    for r in rows:
        counts[:, r["kind"]] = r["inside"], r["outside"]
    return Weights(*counts)


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    spark = prepare(pages.sparkSession)
    sent = spark.sparkContext.broadcast(weights or fit(pages, html_col))
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch, html_col):
                out = [Page(t).text(sent.value) if t else "" for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column_ids(batch, id_col).slice(a, b - a), column_ids(batch, url_col).slice(a, b - a),
                     pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
