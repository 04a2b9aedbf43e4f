"""Conversation repair against the edits tried one by one, and the query against the whole task written plainly."""

import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import shown
from trailmark.llm import conversations as c
from trailmark.llm.queries import op12_conversations

LETTERS = "ABCDEFGHIJKL"


def tried(turns):
    """(cost, audit) by trying all edits: turns are (initial, must go, cut off)."""
    best = [(10**9, "")]

    def go(i, out, cost, audit, inserted):
        if cost > best[0][0] or not re.fullmatch("s?(ua)*u?", out):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit))
        if inserted < 3:
            for role in "ua":
                go(i, out + role, cost + 2, audit + "I", inserted + 1)
        if i < len(turns):
            initial, gone, cut = turns[i]
            go(i + 1, out, cost + 3, audit + "D", 0)
            if not gone:
                go(i + 1, out + initial, cost + cut, audit + "K", 0)
                for role in "ua":
                    go(i + 1, out + role, cost + 2 + cut, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def letter(turn):
    initial, gone, cut = turn
    return c.symbol(initial, c.GONE if gone else c.CUT_OFF if cut else c.FINE)


TURNS = [(i, g, t) for i in "suat" for g, t in ((0, 0), (0, 1), (1, 0))]


def test_cheapest_of_all_edits():
    for n in range(3):
        for turns in itertools.product(TURNS, repeat=n):
            assert c.cheapest(c.parse("".join(map(letter, turns)))) == tried(turns)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([("u", 0, 0), ("a", 0, 0), ("s", 0, 0), ("u", 0, 1), ("a", 1, 0), ("t", 0, 0)]), min_size=3, max_size=6))
def test_cheapest_of_longer_rows(turns):
    assert c.cheapest(c.parse("".join(map(letter, turns)))) == tried(turns)


def test_one_split_is_enough():
    """A whole chart and pairs of neighbours give the same cells."""
    rng = random.Random(3)
    for n in (9, 16, 21):
        letters = "".join(rng.choice(LETTERS) for _ in range(n))
        assert c.parse(letters) == dict(c._chart.__wrapped__(letters))


def test_the_audit_gives_the_order_it_stands_for():
    rng = random.Random(4)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"x{i}.") for i in range(rng.randrange(12))]
        _, audit = c.cheapest(c.parse("".join(c.symbol(r, c.FINE) for r, _ in turns)))
        left, _ = c.applied(iter(turns), audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _, _ in left))


def dp(turns):
    """The least (cost, audit) turn by turn, for rows too long to try."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    at = {"0": (0, "")}

    def inserted(cells):
        for _ in range(4):
            for (p, role), q in step.items():
                if p in cells and role != "s":
                    more = (cells[p][0] + 2, cells[p][1] + "I")
                    cells[q] = min(cells.get(q, more), more)
        return cells

    at = inserted(at)
    for initial, gone, cut in turns:
        after = {}

        def put(q, cost, audit):
            after[q] = min(after.get(q, (cost, audit)), (cost, audit))

        for p, (cost, audit) in at.items():
            put(p, cost + 3, audit + "D")
            for (s, role), q in step.items():
                if s == p and not gone:
                    if role == initial:
                        put(q, cost + cut, audit + "K")
                    if role != "s":
                        put(q, cost + 2 + cut, audit + "R")
        at = inserted(after)
    return min(at[q] for q in ("0", "3") if q in at)


def whole(rows):
    """The query's contract over (conv, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept[conv] += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = []
    for conv, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = dp([(t[1][:1], f in ("b", "d") and 1, f == "t") for t, f in zip(turns, faults)])
        left, i, state = [], 0, "start"
        for edit in audit:
            if edit != "I":
                i += 1
            if edit == "D":
                continue
            role = turns[i - 1][1] if edit == "K" else "assistant" if state == "u" else "user"
            left.append(f"{role}:{'' if edit == 'I' else turns[i - 1][2]}")
            state = role[:1]
        known = [t[0] for t in turns if t[0] is not None]
        firsts = [t[1][:1] for t in turns]
        out.append(
            (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in "bdt"),
             sum(x + y not in ("su", "ua", "au") for x, y in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
        )
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def awkward():
    rng = random.Random(8)
    texts = ["Hello there.", "And you?", "cut off", "", " \t\n", None, "é😀!", "x" * 2000 + ".", "ends.  \n", "\x85", "Hello there.", "nul\0."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 25)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser"]), rng.choice(texts)))
    rows += [rows[0]] * 5 + [(7, None, "user", "Hi.")] * 3 + [(61, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(400)]
    return rows + [(62, 2**62, "user", "far."), (62, -(2**62) - 5, "assistant", "near.")]


def table(spark, rows):
    extra = [(*r, 1, "x", 5) for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, conv int, _lot string, n int")


def test_awkward_rows_gathered_and_in_parts(spark):
    rows = awkward()
    frame, want = table(spark, rows), whole(rows)
    assert rows_of(c.repaired(c.damaged(frame), frame)) == want
    assert rows_of(c.repaired(c.damaged(frame), frame, most_rows=10, most_bytes=500)) == want


def test_one_hot_conversation(spark):
    rng = random.Random(2)
    rows = [(1, rng.randrange(900), rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", "Maybe", ""])) for _ in range(3000)]
    rows += [(1, 5, "user", "copy.")] * 2000 + [(2, 0, "user", "Hi.")]
    frame = table(spark, rows)
    assert rows_of(c.repaired(c.damaged(frame), frame, most_rows=200)) == whole(rows)


def test_all_dropped_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = table(spark, [(gone, 0, "user", "Hi.")])
    assert rows_of(c.repaired(c.damaged(frame), frame)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = frame.where("1 = 0")
    assert rows_of(c.repaired(c.damaged(none), none)) == []


def test_repaired_turns(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", ""), (1, 3, "user", "No")], "conv_id long, turn long, role string, text string")
    reports, parts = c.repair(frame)
    (row,) = reports.collect()
    assert parts is None and (row.blank, row.truncated, row.illegal) == (1, 1, 2)
    assert [(t.role, t.text, t.edit) for t in row.left] == [(r, t, e) for r, t, e in c.applied(iter([("assistant", "Hi."), ("user", "Yes."), ("user", ""), ("user", "No")]), row.audit)[0]]
    _, parts = c.repair(frame, most_rows=2)
    assert sum((list(p.left) for p in sorted(parts.collect(), key=lambda p: (p.task, p.segment))), []) == list(row.left)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op12_conversations(spark, sf_dir)) == whole(rows)
