"""Conversation repair against a search over whole strings, its memory, and its small cases."""

import hashlib
import random
import re
import zlib

import pytest

from mailspark.llm import conversations
from mailspark.llm.conversations import BLANK, CUT, DUPLICATE, SOUND, Repair

SCHEMA = "conv_id long, turn long, role string, text string, times int, fault int, kind string, pos long"
GRAMMAR = re.compile("(s?(ua)+)?")


def best(rows):
    """Cheapest edits of (role, text, fault) rows with whole strings: every way within a bound on its insertions."""
    ways = {("", ""): (0, [])}                               # (audit, role initials so far) -> cost, repaired
    limit = 4 * len(rows) + 6

    def grown(ways):
        out = dict(ways)
        for _ in range(2):
            for (audit, roles), (cost, text) in list(out.items()):
                for r in ("user", "assistant"):
                    k, v = (audit + "I", roles + r[0]), (cost + 3, text + [f"{r}:"])
                    if v[0] <= limit and prefix(k[1]) and (k not in out or v < out[k]):
                        out[k] = v
        return out

    def prefix(roles):
        return re.fullmatch("s?(ua)*u?", roles) is not None
    for role, text, fault in rows:
        new = {}
        for (audit, roles), (cost, done) in grown(ways).items():
            extra = 3 if fault == CUT else 0
            steps = [("D", "", 4, None)]
            if fault in (SOUND, CUT):
                if role[:1] in ("s", "u", "a"):
                    steps.append(("K", role[0], extra, role))
                steps += [("R", r[0], 3 + extra, r) for r in ("user", "assistant")]
            for op, r, c, own in steps:
                if cost + c <= limit and prefix(roles + r):
                    k, v = (audit + op, roles + r), (cost + c, done + ([] if own is None else [f"{own}:{text}"]))
                    if k not in new or v < new[k]:
                        new[k] = v
        ways = new
    cost, audit, text = min((c, a, t) for (a, r), (c, t) in grown(ways).items() if GRAMMAR.fullmatch(r))
    return cost, audit, "\n".join(text)


def repaired(rows):
    r = Repair()
    edits = []
    for row in rows:
        edits += r.feed(*row)
    edits += r.close()
    return r.cost, "".join(e[0] for e in edits), "\n".join(f"{e[1]}:{e[2]}" for e in edits if e[0] != "D"), r


@pytest.mark.parametrize("seed", range(6))
def test_against_whole_strings(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), f"t{i}",
                 rng.choice([SOUND, SOUND, SOUND, CUT, CUT, BLANK, DUPLICATE])) for i in range(rng.randint(0, 5))]
        assert repaired(rows)[:3] == best(rows), rows


def test_the_edits_of_a_long_conversation_do_not_wait_for_its_end():
    rng = random.Random(5)
    for make in (lambda i: ("user" if i % 2 == 0 else "assistant", f"{i}.", SOUND),
                 lambda i: (rng.choice(["user", "assistant", "system"]), f"{i}.", rng.choice([SOUND, CUT, BLANK])),
                 lambda i: ("user", "", BLANK)):
        r, seen = Repair(), 0
        for i in range(5000):
            seen += sum(1 for _ in r.feed(*make(i)))
            assert seen > i - 400                            # what is still open
        assert r.held < 400


def test_ties_open_to_the_end_take_linear_time():
    """Among user turns the first edit depends on the last row: all is held, and compared by rank."""
    for n in (4, 5):
        rows = [("user", f"{i}.", SOUND) for i in range(n)]
        assert repaired(rows)[:3] == best(rows)
    cost, audit, _, _ = repaired([("user", f"{i}.", SOUND) for i in range(100_000)])
    assert (cost, len(audit)) == (150_000, 100_000)


def expected(rows):
    """The digest row of each conversation, straight from the definition."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            after += [row] * (2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows_in, counts = set(), [], [0, 0, 0, 0]
        for turn, role, text in after:
            tail = text.rstrip(" \t\n\x0b\f\r")
            fault = BLANK if not tail else DUPLICATE if (role, text) in seen else SOUND if tail[-1] in ".!?" else CUT
            seen.add((role, text))
            counts[fault] += 1
            rows_in.append((role, text, fault))
        turns = {t for t, _, _ in after if t is not None}
        initials = [r[:1] for _, r, _ in after]
        cost, audit, text = best(rows_in)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts[BLANK], counts[DUPLICATE], counts[CUT],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def test_damage_and_digests(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 3, 9]), rng.choice(["user", "assistant", "system", None, "tool"]),
                         rng.choice(["yes.", "no", "", " \t", None, "what?  ", "é😀 so!", "yes."])))
    rows.append((99, 0, "user", "x" * 300_000 + "."))
    df = spark.createDataFrame([(*r, 7, 7, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(df).collect()}
    assert got == expected(rows)
    assert conversations.report(df.limit(0)).collect() == []


def test_repaired_rows(spark):
    """The operator's own output: edits in order, with the texts they lead to."""
    rows = [(1, 0, "user", "hello."), (1, 1, "user", "and?"), (1, 2, "assistant", "well"), (2, 0, "system", " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, times int")
    got = [tuple(r) for r in conversations.repair(df).orderBy("conv_id", "pos").collect()]
    # a deletion (4) and the truncated answer (3) cost as much as no cheaper way; the second user turn goes last
    want = {}
    for conv in (1, 2):
        own = [(r[2], r[3], BLANK if not r[3].strip() else SOUND if r[3][-1] in ".?!" else CUT) for r in rows if r[0] == conv]
        want[conv] = best(own)
    for conv in (1, 2):
        mine = [g for g in got if g[0] == conv]
        assert [g[1] for g in mine] == list(range(len(mine)))
        assert "".join(g[2] for g in mine) == want[conv][1]
        assert "\n".join(f"{g[3]}:{g[4]}" for g in mine if g[2] != "D") == want[conv][2]
