"""SentencePiece encoding and decoding of merge-type models, by backtracking.

The merges of a piece model need not be replayed over a text.  A segmentation
is the merged one if every two adjacent pieces are compatible, that is if
merging their joined text anew gives just these two.  So: take the longest
piece at a position (an Aho-Corasick automaton lists all matches); if it is
not compatible with the piece before it, or ends at a position known to fail,
take the next shorter one; if none is left, mark the position as failed in a
bit field of failed positions, drop the last piece and go on from there.

No piece of such a model holds a character pair that its vocabulary lacks, so
a text is cut where no piece can reach across, and each distinct stretch is
encoded once (a bounded cache per worker).  Stretches in which equal scores
compete (runs of spaces) are merged in the model's order instead, for the
compatibility rule needs distinct scores.

Characters without a piece become byte pieces.  Spaces are written as the
model's space sign, one of them before the text; decoding undoes both.

Cases: null and empty texts have no ids and decode to an empty text; repeated
rows and null ids are answered row by row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import ids as column_ids
from .base import prepare, text_slices

SPACE = "▁"
_NEVER = float("-inf")
#: Entries of each cache of a worker, in the current generation; as many of the one before are kept.
CACHE = 200_000
#: Longer stretches (characters) are not kept there, so that the caches are bounded in bytes too.
KEPT = 100


class PieceModel:
    """A merge-type model: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id_of = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.unknown = m.unk_id()
        byte_ids = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.bytes_of = [b""] * n
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.is_byte = frozenset(byte_ids.values())
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.most = max(map(len, self.id_of))                # no piece is longer
        # the longest piece that begins each prefix of a piece ("" if none does), and the next shorter one of each piece
        self.within = {"": ""}
        for size in range(1, self.most + 1):
            for p in self.id_of:
                if len(p) >= size:
                    self.within[p[:size]] = p[:size] if p[:size] in self.id_of else self.within[p[:size - 1]]
        self.shorter = {p: self.within[p[:-1]] for p in self.id_of}
        self.pairs = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        seen: dict[float, str] = {}
        self.tied = {q for p, s in self.score.items() if len(p) > 1 for q in (p, seen.setdefault(s, p)) if q != p or seen[s] != p}
        self.tied_pairs = {p[i:i + 2] for p in self.tied for i in range(len(p) - 1)}
        inner = {c for p in self.id_of for c in p} - self.id_of.keys()
        # equal scores may compete in a text, or a character of it is a piece only within longer ones
        self.special = re.compile("|".join(map(re.escape, sorted(self.tied_pairs | inner))) or "(?!)").search
        # words between spaces and line ends may be looked up at once if no piece reaches across
        across = any(a != SPACE and b == SPACE or "\n" in (a, b) for a, b in self.pairs)
        self.groups = None if across else re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.borders: dict[str, object] = {}
        self.fits: dict[str, dict[str, bool]] = {}            # by the left piece
        self.n_fits = 0

    def merge(self, text: str, trace: list | None = None) -> list[str]:
        """The model's own merges: best score first, leftmost among equals; trace gets (score, place) of each."""
        s = list(text)
        score = self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            if trace is not None:
                trace.append((best, at, len(s)))
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def edges(self, piece: str):
        """What stands at a piece's left and right edge while it is merged, each with the score that ends it.

        None if the piece is not what its own text merges to; "odd" if the
        scores of its merges do not fall in order.
        """
        got = self.borders.get(piece, 0)
        if got == 0:
            trace: list[tuple[float, int, int]] = []
            got = None
            if self.merge(piece, trace) == [piece]:
                got = "odd"
                if all(x[0] >= y[0] for x, y in zip(trace, trace[1:])):
                    s, left, right = list(piece), [], []
                    for x, at, n in trace:
                        if at == 0:
                            left.append((s[0], x))
                        if at == n - 2:
                            right.append((s[-1], x))
                        s[at:at + 2] = [s[at] + s[at + 1]]
                    got = ((*left, (piece, _NEVER)), (*right, (piece, _NEVER)))
            self.borders[piece] = got
        return got

    def compatible(self, left: str, right: str) -> bool:
        """Whether the joined text of two pieces merges to these two (left may be empty)."""
        if self.n_fits >= CACHE:
            self.fits.clear()
            self.n_fits = 0
        fits = self.fits.setdefault(left, {})[right] = self.remerged(left, right)
        self.n_fits += 1
        return fits

    def remerged(self, left: str, right: str) -> bool:
        own = self.edges(right)
        if own is None or not left:
            return own is not None
        other = self.edges(left)
        if other is None:
            return False
        if own == "odd" or other == "odd":
            return self.merge(left + right) == [left, right]
        # both sides merge as alone until something merges across: that happens if its score comes before
        # the merge that ends one of the two edges
        score = self.score
        a, b = iter(other[1]), iter(own[0])
        (x, x_ends), (y, y_ends) = next(a), next(b)
        while True:
            across = score.get(x + y)
            if across is not None and across > x_ends and across >= y_ends:
                return False
            if x_ends == _NEVER and y_ends == _NEVER:
                return True
            if x_ends >= y_ends:
                x, x_ends = next(a)
            else:
                y, y_ends = next(b)

    def segment(self, text: str) -> list[str]:
        """Backtracking over the pieces that begin at each position, longest first; every character is a piece."""
        n = len(text)
        fits, longest, most, within, shorter = self.fits, self.automaton.longest_prefix, self.most, self.within, self.shorter
        out: list[str] = []
        failed, any_failed = bytearray((n >> 3) + 1), False  # bit field of positions
        pos, last = 0, ""
        piece = within[text[:longest(text[:most])]]          # no piece from here is longer
        while pos < n:
            known = fits.get(last, {})
            while piece:
                end = pos + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    ok = known.get(piece)
                    if ok or ok is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                pos, last = end, piece
                if pos < n:
                    piece = within[text[pos:pos + longest(text[pos:pos + most])]]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                out.pop()                                    # position 0 cannot fail: the merged segmentation exists
                pos -= len(last)
                piece = shorter[last]
                last = out[-1] if out else ""
        return out

    def part(self, text: str) -> tuple[int, ...]:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            if len(text) > 1:
                pieces = self.runs(text) if self.special(text) else self.segment(text)
            else:
                pieces = [text]
            try:
                got = tuple(map(self.id_of.__getitem__, pieces))
            except KeyError:                                 # a character without a piece
                got = tuple(chain.from_iterable(map(self.piece_ids, pieces)))
            if len(text) <= KEPT:
                self.parts[text] = got
        return got

    def runs(self, text: str) -> list[str]:
        """Merges in the model's order by a heap: for stretches where equal scores compete."""
        import heapq

        s = list(text)
        after = list(range(1, len(s) + 1))
        before = list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i):
            j = after[i]
            if j < len(s):
                x = self.score.get(s[i] + s[j])
                if x is not None:
                    heapq.heappush(heap, (-x, i, s[i] + s[j]))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not s[i] or j >= len(s) or s[i] + s[j] != joined:
                continue
            s[i], s[j] = joined, ""
            after[i] = after[j]
            if after[j] < len(s):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in s if x]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        i = self.id_of.get(piece)
        if i is not None:
            return (i,)
        if self.byte_ids is None:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in piece.encode())

    def group(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch: cut where no piece holds the two characters."""
        pairs = self.pairs
        if pairs.issuperset(zip(text, text[1:])):
            return self.part(text)
        cuts = [i for i, p in enumerate(zip(text, text[1:]), 1) if p not in pairs]
        cuts = [0, *cuts, len(text)]
        return tuple(chain.from_iterable(self.part(text[a:b]) for a, b in zip(cuts, cuts[1:])))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        known = self.known
        groups = self.groups(text) if self.groups else [text]
        new = set(groups).difference(known)
        if new and len(known) >= CACHE:                              # the older generation goes, its words in use come along
            self.older, self.known = known, {}
            known = self.known
            new = set(groups)
        older, long = self.older, []
        for g in new:
            known[g] = older[g] if g in older else self.group(g)
            if len(g) > KEPT:
                long.append(g)
        ids = list(chain.from_iterable(map(known.__getitem__, groups)))
        for g in long:
            del known[g]
        return ids

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self.mended(ids)
        return text[1:] if ids and ids[0] not in self.is_byte and text.startswith(" ") else text

    def mended(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8 become one replacement sign a byte."""
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.is_byte:
                run += self.bytes_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        m = model(path)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    [column_ids(batch, id_col).slice(a, b - a),
                     pa.array([m.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of each row of (id, ids)."""
    prepare(encoded.sparkSession)

    def run(batches):
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [column_ids(batch, "id"), pa.array([m.decode(x or []) for x in column_ids(batch, "ids").to_pylist()], pa.string())],
                ["id", "text"])
    return encoded.select("id", "ids").mapInArrow(run, f"id {dict(encoded.dtypes)['id']}, text string")


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both directions: doc_id, n_tokens, ids, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        m = model(path)
        digits = [str(i) for i in range(len(m.bytes_of))]
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                ids_, first, back = [], [], []
                for t in texts.to_pylist():
                    x = m.encode(t)
                    ids_.append(x)
                    first.append(hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest())
                    back.append(hashlib.sha256(m.decode(x).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [column_ids(batch, id_col).slice(a, b - a), pa.array([len(x) for x in ids_], pa.int64()), pa.array(ids_, pa.list_(pa.int32())),
                     pa.array(first, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Digest of both directions: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return coded(docs, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
