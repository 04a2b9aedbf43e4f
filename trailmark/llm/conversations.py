"""Repair of conversations: the cheapest edits that give an allowed order of roles, by weighted CYK over spans of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import Staging, fresh, partitions

# Costs of the edits, the turns an edit can make, and what ends or separates words.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"
STOPS = (".", "!", "?")
LEGAL = ("su", "ua", "au")

# The order of roles (s?(ua)+)? as states: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
DONE = (0, 3)

ROWS, BYTES = 1000, 1 << 24  # of a conversation, or a part of one, that one row holds
CHART = 8  # turns parsed by a whole chart

Cell = dict[tuple[int, int], tuple[int, str]]

# -- symbols: a turn as one letter, its role's initial and whether it is in order, cut off, or has to go --

INITIALS = "sua?"
FINE, CUT_OFF, GONE = range(3)


def symbol(role: str, fault: int) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return chr(65 + 3 * INITIALS.index(initial) + fault)


def _meaning(letter: str) -> tuple[str, int]:
    initial, fault = divmod(ord(letter) - 65, 3)
    return INITIALS[initial], fault


def fault_of(text: str) -> str | None:
    """``blank``, ``truncated`` or None; blanks are 0x20 and 0x09-0x0D."""
    text = text.rstrip(BLANKS)
    return "blank" if not text else None if text.endswith(STOPS) else "truncated"


# -- grammar: nonterminal (p, q) stands for turns that lead from state p to state q; (p, q) -> (p, r) (r, q) --


def _joined(left: Cell, right: Cell) -> Cell:
    """A span's cell from those of its two parts: per nonterminal the least (cost, audit).

    Alternatives of one nonterminal and cost over the same turns are never prefixes of each other (one more insertion
    costs more), so the least of joined audits is the join of the least ones.
    """
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (r, q) in right:
                more, tail = right[r, q]
                found = (cost + more, audit + tail)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _better(cell: Cell, key: tuple[int, int], found: tuple[int, str]) -> None:
    if key not in cell or found < cell[key]:
        cell[key] = found


@lru_cache(maxsize=1)
def insertions() -> tuple[tuple[tuple[int, int], tuple[int, str]], ...]:
    """The cell of no turns: what insertions alone lead to, closed under joining."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    for (p, initial), q in STEPS.items():
        if initial in ROLES:
            _better(cell, (p, q), (INSERT, "I"))
    while (wider := _joined(cell, cell)) != cell:
        cell = wider
    return tuple(cell.items())


@lru_cache(maxsize=64)
def _turn(letter: str) -> tuple:
    """The cell of one turn: deleted, kept or with another role, and closed under insertions on both sides."""
    initial, fault = _meaning(letter)
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault != GONE:
        extra = TRUNCATED if fault == CUT_OFF else 0
        for (p, wanted), q in STEPS.items():
            if wanted == initial:
                _better(cell, (p, q), (KEEP + extra, "K"))
            if wanted in ROLES:
                _better(cell, (p, q), (REROLE + extra, "R"))
    empty = dict(insertions())
    return tuple(_joined(_joined(empty, cell), empty).items())


@lru_cache(maxsize=1 << 16)
def _chart(letters: str) -> tuple:
    """Cocke-Younger-Kasami over a few turns: all spans by length, each from all its splits."""
    cells = {(i, i + 1): dict(_turn(c)) for i, c in enumerate(letters)}
    for length in range(2, len(letters) + 1):
        for i in range(len(letters) - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                for key, found in _joined(cells[i, k], cells[k, i + length]).items():
                    _better(cell, key, found)
            cells[i, i + length] = cell
    return tuple(cells[0, len(letters)].items())


def combined(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up: spans of 1, 2, 4, ... parts.

    Every derivation can be bracketed anew ((p, q) goes through some state r at any split), so a long span needs one
    split only, and n turns take n joins instead of n cubed.
    """
    cells = cells or [dict(insertions())]
    while len(cells) > 1:
        cells = [_joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(letters: str) -> Cell:
    """The cell of a row of turns."""
    return combined([dict(_chart(letters[i : i + CHART])) for i in range(0, len(letters), CHART)])


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of an allowed order: nothing, or one that ends behind an assistant."""
    return min(cell[0, q] for q in DONE if (0, q) in cell)


def illegal(letters: str) -> int:
    initials = [_meaning(c)[0] for c in letters]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def applied(turns: Iterator[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[tuple[str, str, str]], int]:
    """The turns left by ``audit`` as (role, text, edit), and the state behind them."""
    out = []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == 2 else "u"]
        out.append((role, text, edit))
        state = STEPS[state, role[:1]]
    return out, state


def _cell_rows(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()]


def _cell(rows: list[dict]) -> Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


# -- Spark --

_TURN = "struct<turn:bigint,role:string,text:string>"
_LEFT = "array<struct<role:string,text:string,edit:string>>"
_CELLS = "array<struct<p:int,q:int,cost:bigint,audit:string>>"
_LEFT_ARROW = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
_CELLS_ARROW = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _left_rows(rows: list[tuple[str, str, str]]) -> list[dict]:
    return [{"role": a, "text": b, "edit": c} for a, b, c in rows]


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit into a row, each gathered and repaired at once."""

    def run(batches):
        for batch in batches:
            numbers, audits, left = {c: [] for c in COUNTS}, [], []
            for turns in batch.column("turns"):
                turns = turns.as_py()
                seen, letters, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
                for t in turns:
                    said = (t["role"], t["text"])
                    fault = fault_of(t["text"])
                    if fault != "blank" and said in seen:
                        fault = "duplicate"
                    seen.add(said)
                    if fault:
                        count[fault] += 1
                    letters.append(symbol(t["role"], FINE if fault is None else CUT_OFF if fault == "truncated" else GONE))
                letters = "".join(letters)
                cost, audit = cheapest(parse(letters))
                known = [t["turn"] for t in turns if t["turn"] is not None]
                gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
                for name, value in {**count, "gaps": min(gaps, (1 << 63) - 1), "illegal": illegal(letters), "cost": cost}.items():
                    numbers[name].append(value)
                audits.append(audit)
                left.append(_left_rows(applied(((t["role"], t["text"]) for t in turns), audit)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *(pa.array(numbers[c], pa.int64()) for c in COUNTS), pa.array(audits, pa.string()), pa.array(left, _LEFT_ARROW)],
                names=["conv", *COUNTS, "audit", "left"],
            )

    kind = rows.schema["conv"].dataType.simpleString()
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return gathered.mapInArrow(run, f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, left {_LEFT}")


def _long(rows: DataFrame, staging: Staging, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length: range-partitioned by turn, parsed in segments whose cells are then combined."""
    kind = rows.schema["conv"].dataType.simpleString()
    parts = partitions(rows.sparkSession)
    # Equal rows are one with a number; the first turn at which something is said decides what is a duplicate.
    copies = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = staging.keep(copies.withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)), "copies")
    first = copies.groupBy("conv", "said").agg(F.min(F.struct("turn")).alias("first")).select(F.col("conv").alias("its"), F.col("said").alias("its_said"), "first.turn").withColumnRenamed("turn", "first")
    found = copies.join(first, copies["conv"].eqNullSafe(first["its"]) & (copies["said"] == first["its_said"]))
    found = found.select("conv", "turn", "role", "text", "n", (~F.col("turn").eqNullSafe(F.col("first"))).alias("again"))
    order = ("conv", "turn", "role", "text")
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())

    def cut(batches):
        held, letters, size, count, current, number = [], [], 0, [0, 0, 0], None, 0

        def segment():
            word = "".join(letters)
            columns = [[current[0]], [current[1]], [number], [word], *([x] for x in count), [held], [_cell_rows(parse(word))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            types = [batch.column("conv").type, pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), _CELLS_ARROW]
            names = ["conv", "task", "segment", "letters", "blank", "duplicate", "truncated", "said", "cells"]
            for row in batch.to_pylist():
                key = (row["conv"], row["task"])
                fault = fault_of(row["text"])
                for i in range(row["n"]):
                    mine = fault if fault == "blank" else "duplicate" if row["again"] or i else fault
                    if held and (key != current or len(held) >= most_rows or size + len(row["text"]) > most_bytes):
                        yield segment()
                        held, letters, size, count, number = [], [], 0, [0, 0, 0], number + 1
                    current = key
                    held.append({"role": row["role"], "text": row["text"]})
                    letters.append(symbol(row["role"], FINE if mine is None else CUT_OFF if mine == "truncated" else GONE))
                    size += len(row["text"])
                    if mine:
                        count[("blank", "duplicate", "truncated").index(mine)] += 1
        if held:
            yield segment()

    shape = f"conv {kind}, task int, segment long, letters string, blank long, duplicate long, truncated long, said array<struct<role:string,text:string>>, cells {_CELLS}"
    segments = staging.keep(ordered.mapInArrow(cut, shape), "segments")

    # A task's segments of one conversation become one cell, then the cells of all tasks: as many as there are tasks.
    def folded(batches):
        for batch in batches:
            rows = [sorted(x.as_py(), key=lambda r: r["at"]) for x in batch.column("spans")]
            cells = [_cell_rows(combined([_cell(r["cells"]) for r in x])) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(["".join(r["letters"] for r in x) for x in rows], pa.string()), pa.array(cells, _CELLS_ARROW)],
                names=[*batch.schema.names[:-1], "letters", "cells"],
            )

    span = lambda at: F.collect_list(F.struct(F.col(at).alias("at"), "letters", "cells")).alias("spans")
    by_task = segments.groupBy("conv", "task").agg(span("segment")).mapInArrow(folded, f"conv {kind}, task int, letters string, cells {_CELLS}")
    whole = by_task.groupBy("conv").agg(span("task")).mapInArrow(folded, f"conv {kind}, letters string, cells {_CELLS}")
    faults = segments.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sort_array(F.collect_list(F.struct("task", "segment", F.length("letters").alias("n")))).alias("places"))
    turns = rows.groupBy("conv", "turn").agg(F.count(F.lit(1))).groupBy("conv")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    turns = turns.agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("known"))
    gaps = F.least(wide("high") - wide("low") + 1 - wide("known"), F.lit((1 << 63) - 1)).cast("long")
    turns = turns.select("conv", F.when(F.col("known") > 0, gaps).otherwise(0).alias("gaps"))
    its = lambda frame, *names: frame.select(F.col("conv").alias("its"), *names)
    join = lambda left, right: left.join(right, left["conv"].eqNullSafe(right["its"])).drop("its")
    summed = join(join(whole, its(faults, "blank", "duplicate", "truncated", "places")), its(turns, "gaps"))

    def decided(batches):
        """The edits, and of them each segment's own with the state before it."""
        for batch in batches:
            costs, audits, breaks, slices = [], [], [], []
            for letters, cells, places in zip(*(batch.column(c).to_pylist() for c in ("letters", "cells", "places"))):
                cost, audit = cheapest(_cell(cells))
                costs.append(cost)
                audits.append(audit)
                breaks.append(illegal(letters))
                at, row, state, own = 0, 0, 0, []
                for i, place in enumerate(places):
                    begin, before, last = at, state, row + place["n"]
                    while at < len(audit) and (row < last or i + 1 == len(places)):
                        edit = audit[at]
                        if edit != "D":
                            initial = _meaning(letters[row])[0] if edit == "K" else "a" if state == 2 else "u"
                            state = STEPS[state, initial]
                        row += edit != "I"
                        at += 1
                    own.append({"task": place["task"], "segment": place["segment"], "state": before, "edits": audit[begin:at]})
                slices.append(own)
            shape = pa.list_(pa.struct([("task", pa.int32()), ("segment", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "gaps", "blank", "duplicate", "truncated")), pa.array(breaks, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(slices, shape)],
                names=["conv", *COUNTS, "audit", "slices"],
            )

    report = staging.keep(
        summed.mapInArrow(decided, f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, slices array<struct<task:int,segment:bigint,state:int,edits:string>>"), "report"
    )
    each = report.select(F.col("conv").alias("its"), F.inline("slices"))
    wanted = segments.select("conv", "task", "segment", "said").join(each.withColumnRenamed("task", "t").withColumnRenamed("segment", "s"), F.col("conv").eqNullSafe(F.col("its")) & (F.col("task") == F.col("t")) & (F.col("segment") == F.col("s")))

    def repaired(batches):
        for batch in batches:
            said, state, edits = (batch.column(c).to_pylist() for c in ("said", "state", "edits"))
            left = [_left_rows(applied(((t["role"], t["text"]) for t in x), audit, s)[0]) for x, s, audit in zip(said, state, edits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "task", "segment")), pa.array(left, _LEFT_ARROW)], names=["conv", "task", "segment", "left"])

    left = wanted.select("conv", "task", "segment", "said", "state", "edits").mapInArrow(repaired, f"conv {kind}, task int, segment long, left {_LEFT}")
    left = staging.keep(left, "left")
    staging.drop("copies", "segments")
    return report.drop("slices"), left


def repair(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = ROWS, most_bytes: int = BYTES
) -> tuple[DataFrame, DataFrame | None]:
    """Each conversation's faults and its cheapest repair: (reports, parts).

    Turns are taken by ``turn`` (nulls first), then role, then text; null roles and texts are one blank. A turn's first fault
    counts: blank (only 0x20, 0x09-0x0D), duplicate (role and text met earlier), truncated (last other character not
    ``.!?``). Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate turns), Insert an
    empty user or assistant turn 2; a truncated turn that stays costs 1 more. The initials of the roles that come out
    must read ``(s?(ua)+)?``; among the cheapest rows of edits the ASCII-least is taken.

    The order of roles is a grammar in Chomsky normal form whose nonterminals are pairs of states. A cell holds the least
    (cost, audit) per nonterminal of a span, closed under insertions. Spans are combined bottom-up by length: whole charts
    over ``CHART`` turns, then neighbouring spans in pairs.

    Reports: ``conv``, ``gaps`` (highest - lowest turn + 1 - distinct ones, nulls passed over, 0 if all are null), ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` (neighbours whose initials are not su, ua, au), ``cost``, ``audit`` (edits' initials), and ``left``:
    the repaired turns as (role, text, edit), for conversations up to ``most_rows`` turns and ``most_bytes``. Longer ones
    are never gathered: ``parts`` (None if there are none) holds their turns in ``task``, ``segment`` order, ``left`` is null. A null
    conversation is one. Repeated rows are turns like others. An empty table has no reports. Other columns are not read.
    """
    staging = Staging(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    large = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes))
    large = staging.keep(large.select(F.col("conv").alias("its")), "large")
    if large.isEmpty():
        return _whole(rows), None
    same = rows["conv"].eqNullSafe(large["its"])
    report, parts = _long(rows.join(large, same, "left_semi"), staging, most_rows, most_bytes)
    return _whole(rows.join(large, same, "left_anti")).unionByName(report.withColumn("left", F.lit(None).cast(_LEFT))), parts


def digests(reports: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The reports with ``repaired_sha256`` for ``left``: of ``role:text`` of all repaired turns, joined with newlines.

    A hash of one long text can't be split; a long conversation's turns run through one task in order, of which it holds
    one part at a time.
    """
    lines = F.array_join(F.transform("left", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = reports.where(F.col("left").isNotNull()).withColumn("repaired_sha256", F.sha2(lines, 256)) if parts is not None else reports.withColumn("repaired_sha256", F.sha2(lines, 256))
    if parts is None:
        return out.drop("left")

    def hashed(batches):
        current, sha, begun = None, None, False
        for batch in batches:
            kind = batch.column("conv").type
            for conv, left in zip(batch.column("conv").to_pylist(), batch.column("left")):
                if sha is None or conv != current:
                    if sha is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([sha.hexdigest()])], names=["its", "repaired_sha256"])
                    current, sha, begun = conv, hashlib.sha256(), False
                for t in left.as_py():
                    sha.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                    begun = True
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([sha.hexdigest()])], names=["its", "repaired_sha256"])

    kind = parts.schema["conv"].dataType.simpleString()
    order = parts.repartition(partitions(parts.sparkSession), "conv").sortWithinPartitions("conv", "task", "segment").select("conv", "left")
    found = order.mapInArrow(hashed, f"its {kind}, repaired_sha256 string")
    long = reports.where(F.col("left").isNull()).join(found, F.col("conv").eqNullSafe(F.col("its"))).drop("its")
    return out.unionByName(long).drop("left")


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the CRC-32 of ``conversation:turn`` modulo 20, for tests of ``repair``; nulls are one blank.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 doubles it, 4 makes the role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot, = fresh(rows, "_lot")
    hit = rows.withColumn(lot, F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20)
    hit = hit.where(F.col(lot) != 0)
    text = F.when(F.col(lot) == 1, F.lit("")).when(F.col(lot) == 2, F.regexp_replace(blank(text_col), "[.!?]", "")).otherwise(blank(text_col))
    role = F.when(F.col(lot) == 4, F.lit("user")).otherwise(blank(role_col))
    hit = hit.select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(F.sequence(F.lit(1), F.when(F.col(lot) == 3, 2).otherwise(1))).alias(lot))
    return hit.drop(lot)


def repaired(rows: DataFrame, given: DataFrame, *, conv_col: str = "conv_id", **options) -> DataFrame:
    """Reports and digests of ``rows`` for every conversation of ``given``; those without a row have zeros and an empty audit."""
    found = digests(*repair(rows, conv_col=conv_col, **options)).withColumnRenamed("conv", "its")
    every = given.select(F.col(conv_col)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(found, every[conv_col].eqNullSafe(found["its"]), "left").select(
        conv_col, *(zero(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
