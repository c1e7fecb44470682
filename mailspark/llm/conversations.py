"""Repair of conversation structure by a Viterbi search that emits its edits as survivors coalesce.

A repaired conversation has the roles ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn.  Four states say what came last (nothing,
system, user, assistant); each row is kept, given another role or deleted, and
empty user or assistant turns may be inserted anywhere.  A step keeps, for
each state, the cheapest edits that lead to it, ties going to the ASCII-least
string of the edits' initials.  Two ways to one state that cost the same have
used the same rows, and neither string can begin with the other (an insertion
more would cost more), so the lesser stays the lesser whatever follows.

The steps form a tree of back pointers.  Nodes count their children; a
survivor that nothing extends is released, up to the first node that still
has another child.  As long as the root has one child, all survivors share
it: that child's edits are final and leave the tree at once.  So a task holds
only the rows on which survivors still differ, however long a conversation
is.  (Where the first edits depend on the last row, as among user turns only,
that is the conversation; no method could say them earlier.)  Survivors of
equal cost are compared on the whole of that part: each keeps the rank of its
string among the others', which follows from its parent's rank and its new
edits.  The states "nothing" and "system" are given up once an assistant state
is so much cheaper that they can no longer win or tie (see ``_prune``), or
else the way that deletes everything would hold the whole conversation.

Rows are shuffled once, by conversation, and each partition is read as a
stream in order of turn.  A conversation is one stream in one task, because
the digest of its repaired text is defined over its sequence; the task holds
no more of it than is undecided.

Cases: nulls in role and text are one space, and so are nulls in the text that
decides a row's damage; rows without a conv_id are one conversation; null
turns come first; rows of equal turn are taken in order of role and text;
repeated rows are rows of their own (the later are duplicates); a role is
known by its first letter (an empty or other role can't be kept); a
conversation without rows, or all of whose rows are deleted, is repaired to
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import BATCH_BYTES, BATCH_ROWS, ids, prepare

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK_CHARS = " \t\n\x0b\f\r"
#: Faults of a row, by the number that travels with it.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: what the repaired conversation ends with.
NOTHING, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3

REPAIRED = "conv_id {kind}, pos long, edit string, role string, text string"
DIGESTS = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
           " repaired_sha256 string")


class _Node:
    """The edits of one row on one way: insertions and then the row's own; ``state`` is the state after them."""

    __slots__ = ("parent", "ops", "state", "role", "text", "kids")

    def __init__(self, parent, ops, state, role, text):
        self.parent, self.ops, self.state, self.role, self.text, self.kids = parent, ops, state, role, text, 0


def _put(best: list, state: int, way: tuple) -> None:
    """Keep the better way to ``state``: (cost, rank of the survivor it extends, initials of its new edits, that survivor)."""
    if best[state] is None or way[:3] < best[state][:3]:
        best[state] = way


class Repair:
    """One conversation: ``feed`` its rows in order, then ``close``; both yield (initial, role, text) of final edits."""

    def __init__(self):
        self.root = _Node(None, "", NOTHING, None, None)
        # cheapest (cost, rank, node) of each state; the rank orders the whole strings of the survivors
        self.live = [(0, 0, self.root), None, None, None]
        self.cost = 0
        #: Most steps held at once, for tests.
        self.held = 0

    def _inserted(self) -> list:
        """Ways to each state with insertions after the last row."""
        ways = [None if w is None else (w[0], w[1], "", w[2]) for w in self.live]
        for s in (NOTHING, SYSTEM, ASSISTANT):
            if self.live[s] is not None:
                cost, rank, node = self.live[s]
                _put(ways, USER, (cost + INSERT, rank, "I", node))
        if ways[USER] is not None:
            cost, rank, ops, node = ways[USER]
            _put(ways, ASSISTANT, (cost + INSERT, rank, ops + "I", node))
        return ways

    def feed(self, role: str, text: str, fault: int):
        best: list = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        first = role[:1]
        for s, way in enumerate(self._inserted()):
            if way is None:
                continue
            cost, rank, ops, node = way
            _put(best, s, (cost + DELETE, rank, ops + "D", node))
            if fault in (BLANK, DUPLICATE):
                continue
            if s == USER:
                _put(best, ASSISTANT, (cost + REROLE + extra, rank, ops + "R", node))
                if first == "a":
                    _put(best, ASSISTANT, (cost + KEEP + extra, rank, ops + "K", node))
            else:
                _put(best, USER, (cost + REROLE + extra, rank, ops + "R", node))
                if first == "u":
                    _put(best, USER, (cost + KEEP + extra, rank, ops + "K", node))
                elif first == "s" and s == NOTHING:
                    _put(best, SYSTEM, (cost + KEEP + extra, rank, ops + "K", node))
        self._prune(best)
        old = [w[2] for w in self.live if w is not None]
        self.live = [None] * 4
        # strings of one row number differ before either ends, so those of the parents decide, then the new edits
        order = sorted((way[1], way[2], s) for s, way in enumerate(best) if way is not None)
        for n, (_, ops, s) in enumerate(order):
            parent = best[s][3]
            parent.kids += 1
            self.live[s] = (best[s][0], n, _Node(parent, ops, s, role, text))
        for node in old:
            while node.kids == 0 and node is not self.root:  # nothing extends it: release it
                node = node.parent
                node.kids -= 1
        yield from self._settled()

    @staticmethod
    def _prune(best: list) -> None:
        """Drop states that cannot win any more.

        All that can follow "system" can follow "assistant" as well, at the
        same cost; all that can follow "nothing" too, but for a system row
        kept, which "assistant" would have to delete.
        """
        if best[ASSISTANT] is not None:
            bound = best[ASSISTANT][0]
            if best[SYSTEM] is not None and best[SYSTEM][0] > bound:
                best[SYSTEM] = None
            if best[NOTHING] is not None and best[NOTHING][0] > bound + DELETE:
                best[NOTHING] = None

    def _path(self, node: _Node) -> list:
        chain = []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        return chain

    def _settled(self):
        if self.root.kids != 1:
            return
        chain = self._path(next(w[2] for w in self.live if w is not None))
        self.held = max(self.held, len(chain))
        while chain and self.root.kids == 1:
            node = chain.pop()
            yield from self._edits(self.root.state, node.ops, node)
            node.parent, self.root = None, node

    @staticmethod
    def _edits(state: int, ops: str, node: _Node | None):
        for op in ops:
            if op == "K":
                yield op, node.role, node.text
            elif op == "D":
                yield op, None, None
            else:
                role, state = ("assistant", ASSISTANT) if state == USER else ("user", USER)
                yield op, role, "" if op == "I" else node.text

    def close(self):
        """The rest of the edits; ``cost`` is known then."""
        ways = self._inserted()
        best: list = [None]
        for s in (NOTHING, ASSISTANT):
            if ways[s] is not None:
                _put(best, 0, ways[s])
        self.cost, _, ops, last = best[0]
        state = self.root.state
        for node in reversed(self._path(last)):
            yield from self._edits(state, node.ops, node)
            state = node.state
        yield from self._edits(state, ops, None)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of each row after its damage; a dropped row stays, with ``times`` 0 and no text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 0, None).when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def _fault(first: Column) -> Column:
    tail = F.rtrim("text", F.lit(BLANK_CHARS))
    return (F.when(tail == "", BLANK).when(~first, DUPLICATE)
            .when(F.substring(tail, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)).cast("int")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their fault, by conversation and in order within each partition: one shuffle."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    return (rows.repartition("conv_id")
            .withColumn("fault", _fault(F.row_number().over(seen) == 1))
            .sortWithinPartitions("conv_id", "turn", "role", "text"))


def _events(batches):
    """Yield ("edit", conv_id, number, initial, role, text) as edits become final, and ("end", conv_id, counts)."""
    repair, conv, seen = None, None, False
    n = 0

    def finish():
        nonlocal n
        for e in repair.close():
            yield ("edit", conv, n, *e)
            n += 1
        gaps = high - low + 1 - turns if turns else 0
        yield "end", conv, (gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, repair.cost)

    for batch in batches:
        columns = (ids(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "fault"))
        for own, turn, role, text, times, fault in zip(*columns):
            if not seen or own != conv:
                if seen:
                    yield from finish()
                repair, conv, seen, n = Repair(), own, True, 0
                low = high = last = None
                turns, illegal, faults = 0, 0, [0, 0, 0, 0]
            for copy in range(times):
                if turn is not None and turn != high:        # turns come in order
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if last is not None and last + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                last = role[:1]
                kind = fault if not copy or fault == BLANK else DUPLICATE
                faults[kind] += 1
                for e in repair.feed(role, text, kind):
                    yield ("edit", conv, n, *e)
                    n += 1
    if seen:
        yield from finish()


def _batches(rows, schema: pa.Schema, size):
    """Arrow batches of a stream of tuples, bounded in rows and bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= BATCH_ROWS or total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _digests(events):
    audit, sha, any_text = [], hashlib.sha256(), False
    for event in events:
        if event[0] == "edit":
            _, _, _, op, role, text = event
            audit.append(op)
            if op != "D":
                sha.update(f"{chr(10) if any_text else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_text = True
        else:
            _, conv, counts = event
            yield (conv, *counts, "".join(audit), sha.hexdigest())
            audit, sha, any_text = [], hashlib.sha256(), False


def _first_type(schema: pa.Schema, kind: pa.DataType) -> pa.Schema:
    return schema.set(0, pa.field("conv_id", kind))


def repair(rows: DataFrame) -> DataFrame:
    """Edits of each conversation in order: conv_id, pos, edit (K, R, D or I) and the repaired row's role and text.

    ``rows`` has conv_id, turn, role, text and ``times`` (copies; 0 for a row that is only named), as ``damaged`` gives.
    """
    prepare(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        own = _first_type(schema, head.schema.field("conv_id").type)

        def all_of():
            yield head
            yield from batches
        yield from _batches((e[1:] for e in _events(all_of()) if e[0] == "edit"), own, lambda r: len(r[4] or "") + 32)
    return ordered(rows).mapInArrow(run, REPAIRED.format(kind=kind))


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps and counts of its faults, cost and initials of its edits, digest of its repaired text."""
    prepare(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        own = _first_type(schema, head.schema.field("conv_id").type)

        def all_of():
            yield head
            yield from batches
        yield from _batches(_digests(_events(all_of())), own, lambda r: len(r[7]) + 160)
    return ordered(rows).mapInArrow(run, DIGESTS.format(kind=kind))


def report(conversations: DataFrame) -> DataFrame:
    """``digests`` of the damaged conversations: the registered query."""
    return digests(damaged(conversations))
