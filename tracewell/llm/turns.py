"""Repair of damaged conversations by weighted CYK parsing.

A repaired conversation is empty or a derivation of `(s?(ua)+)?` over role initials. The repair
grammar in Chomsky normal form has a nonterminal T(p, q) for each pair of states of that
language (start, after s, after u, after a): T(p, q) -> T(p, r) T(r, q), and T(p, q) -> row for
each way to edit one row between p and q. The cell of a span and a nonterminal holds its least
(cost, audit). Insertions are closed in the cells of single rows: what is inserted stands before
the row that follows it, what follows the last row is closed at the end. So two audits of one
span never are prefixes of each other and the least audit of a span is made of least audits.

T(p, r) T(r, q) over all r gives the same cell wherever a span is split, so bottom-up by span
length one split of each span is enough: spans of 1, 2, 4, ... rows, neighbours combined. A
conversation of any length is cut into stretches where partitions of the sorted table end; their
cells are combined the same way. Its texts then pass once, in order, through the hash.

Defined results: null roles and texts are one space, a null id stands for a space in the damage
key and is a conversation of its own; rows are ordered by turn (nulls first), role and text, so
repeated rows stand together; texts of any length are whole; a conversation without rows has
zeros, an empty audit and the empty hash; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: (from, role initial) -> to
STEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
ROLES = {"u": "user", "a": "assistant"}
BLANK = r"[^\x20\x09-\x0D]"

Cell = dict[tuple[int, int], tuple[int, str]]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows that damage by their key leaves, equal rows counted."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    bare = F.translate(text, ".!?", "")
    return (
        turns.select(
            "conv_id", "turn", kind.alias("kind"),
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind == 1, "").when(kind == 2, bare).otherwise(text).alias("text"),
        )
        .where("kind != 0")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum(F.when(F.col("kind") == 3, 2).otherwise(1)).alias("n"))
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows with `first` (no earlier turn has the role and text), `blank` and `open` (no end mark)."""
    by = ["conv_id", "role", "text"]
    firsts = rows.groupBy(*by).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
    marked = rows.select(*by, "turn", "n").unionByName(
        firsts.select(*by, F.col("least.turn").alias("turn"), F.lit(None).cast("long").alias("n"))
    )
    # every row meets its own mark only, so a text that fills a conversation is no hot key
    joined = marked.groupBy(*by, "turn").agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > F.count("n")).alias("first"))
    last = F.regexp_extract("text", r"(" + BLANK + r")[\x20\x09-\x0D]*\z", 1)
    return joined.select(
        "conv_id", "turn", "role", "text", "n", "first", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")
    )


def row_cell(initial: str, fault: str) -> Cell:
    """Least edits of one row, with insertions before it, for all pairs of states."""
    extra = TRUNCATED if fault == "truncated" else 0
    cell: Cell = {}
    for p in range(4):
        # insertion closure: nothing, or user and assistant in turn, until the states repeat
        opened, at, cost, audit = {}, p, 0, ""
        while at is not None and at not in opened:
            opened[at] = (cost, audit)
            at = STEPS.get((at, "a" if at == USER else "u"))
            cost, audit = cost + INSERT, audit + "I"
        for r, (cost, audit) in opened.items():
            edits = [(r, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                edits += [(STEPS.get((r, initial)), KEEP + extra, "K")]
                edits += [(STEPS.get((r, x)), REROLE + extra, "R") for x in "ua"]
            for q, price, letter in edits:
                found = (cost + price, audit + letter)
                if q is not None and found < cell.get((p, q), (1 << 60, "")):
                    cell[p, q] = found
    return cell


#: nothing but insertions, to the end of a conversation
CLOSING: Cell = {
    (START, START): (0, ""), (ASSISTANT, ASSISTANT): (0, ""), (USER, ASSISTANT): (INSERT, "I"),
    (SYSTEM, ASSISTANT): (2 * INSERT, "II"), (START, ASSISTANT): (2 * INSERT, "II"),
}


def joined_cells(left: Cell, right: Cell) -> Cell:
    """T(p, q) -> T(p, r) T(r, q)."""
    out: Cell = {}
    for (p, r), (c, a) in left.items():
        for (s, q), (d, b) in right.items():
            if r == s:
                now = out.get((p, q))
                if now is None or c + d < now[0] or (c + d == now[0] and a + b < now[1]):
                    out[p, q] = (c + d, a + b)
    return out


class Spans:
    """Cells of a growing row of rows: finished spans of falling powers of two."""

    def __init__(self):
        self.parts: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, size: int = 1) -> None:
        while self.parts and self.parts[-1][0] <= size:
            width, left = self.parts.pop()
            cell, size = joined_cells(left, cell), size + width
        self.parts.append((size, cell))

    def whole(self) -> Cell:
        out = self.parts[-1][1]
        for _, left in reversed(self.parts[:-1]):
            out = joined_cells(left, out)
        return out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
STRETCH = (
    "conv_id long, part int, head string, tail string, low long, high long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, states array<int>, costs array<long>, audits array<string>"
)
LEGAL = {"su", "ua", "au"}


class Stretch:
    """What is known of a run of a conversation's rows within one partition."""

    def __init__(self):
        self.spans, self.cells = Spans(), {}
        self.head = self.tail = self.low = self.high = None
        self.turns = self.illegal = 0
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role: str, fault: str | None) -> None:
        initial = role[:1]
        if (initial, fault) not in self.cells:
            self.cells[initial, fault] = row_cell(initial, fault or "")
        self.spans.add(self.cells[initial, fault])
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        if fault:
            self.n[fault] += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, conv, part: int) -> tuple:
        cell = self.spans.whole()
        return (
            conv, part, self.head, self.tail, self.low, self.high, self.turns, *self.n.values(),
            self.illegal, [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()],
        )


def row_faults(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(conv_id, turn, role, text, fault) of every copy of every row."""
    for conv, turn, role, text, n, first, blank, unended in zip(*(batch.column(i).to_pylist() for i in range(8))):
        once = "blank" if blank else "duplicate" if not first else "truncated" if unended else None
        yield conv, turn, role, text, once
        for _ in range(n - 1):
            yield conv, turn, role, text, "blank" if blank else "duplicate"


def stretches(rows: DataFrame) -> DataFrame:
    """Cells and counts of every conversation's rows in each partition of the sorted table."""

    def run(batches):
        from pyspark import TaskContext

        part, names = TaskContext.get().partitionId(), [f.split()[0] for f in STRETCH.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7,
                 pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
        made = lambda out: pa.record_batch(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names
        )
        now, held, out = object(), None, []
        for batch in batches:
            for conv, turn, role, _, fault in row_faults(batch):
                if held is None or conv != now:
                    if held is not None:
                        out.append(held.row(now, part))
                    now, held = conv, Stretch()
                held.add(turn, role, fault)
            if len(out) > 1000:
                yield made(out)
                out = []
        if held is not None:
            yield made([*out, held.row(now, part)])

    return rows.mapInArrow(run, STRETCH)


def combined(parts: DataFrame) -> DataFrame:
    """gaps, the counts, cost and audit of every conversation from its stretches, in order."""
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in parts.columns if c != "conv_id"]))).alias("parts"))
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string"

    def whole(found: list[dict]) -> tuple:
        spans, n = Spans(), dict.fromkeys(["blank", "duplicate", "truncated", "illegal"], 0)
        tail = low = high = None
        turns = 0
        for s in found:
            spans.add({(k // 4, k % 4): (c, a) for k, c, a in zip(s["states"], s["costs"], s["audits"])})
            for k in n:
                n[k] += s[k]
            if tail is not None and tail + s["head"] not in LEGAL:
                n["illegal"] += 1
            tail = s["tail"]
            if s["low"] is not None:
                turns += s["turns"] - (s["low"] == high)
                low, high = (s["low"] if low is None else low), s["high"]
        best = min(v for (p, _), v in joined_cells(spans.whole(), CLOSING).items() if p == START)
        return (0 if low is None else high - low + 1 - turns, *n.values(), *best)

    def run(batches):
        for batch in batches:
            rows = [whole(found) for found in batch.column(1).to_pylist()]
            kinds = [*[pa.int64()] * 6, pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.record_batch([batch.column(0), *columns], ["conv_id", *COUNTS, "cost", "audit"])

    return listed.mapInArrow(run, schema)


def hashed(rows: DataFrame, repairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation with its repair's hash: its repair comes first, then its rows, as one stream."""
    fields = ", ".join([*(f"{c} long" for c in COUNTS), "cost long", "audit string"])
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lines = [blank("long", c) for c in [*COUNTS, "cost"]] + [blank("string", "audit")]
    row = [blank("long", "turn"), blank("string", "role"), blank("string", "text"), blank("long", "n"),
           *(blank("boolean", c) for c in ("first", "blank_row", "open"))]
    both = (
        rows.select("conv_id", "turn", "role", "text", "n", "first", F.col("blank").alias("blank_row"), "open",
                    F.lit(2).alias("kind"), *lines)
        .unionByName(repairs.select("conv_id", *row, F.lit(1).alias("kind"), *COUNTS, "cost", "audit"))
        .unionByName(ids.select("conv_id", *row, F.lit(0).alias("kind"), *lines))
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "text")]
    sorted_rows = both.repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]

    def run(batches):
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        out: list[tuple] = []
        facts, digest, edits, state, lines = None, None, "", START, 0

        def line(role: str, text: str):
            nonlocal lines
            digest.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1

        def insert(at: int) -> int:
            """Insertions up to the next other edit; returns the place of that."""
            nonlocal state
            while at < len(edits) and edits[at] == "I":
                x = "a" if state == USER else "u"
                line(ROLES[x], "")
                state, at = STEPS[state, x], at + 1
            return at

        def close():
            insert(place)
            out.append((*facts, digest.hexdigest()))

        place = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv, turn, role, text, n, first, empty, unended, kind, *found in zip(*columns):
                if kind == 0:
                    if facts is not None:
                        close()
                    facts, digest, edits, state, lines, place = (conv, *[0] * 6, ""), hashlib.sha256(), "", START, 0, 0
                elif kind == 1:
                    facts, edits = (conv, *found), found[-1]
                else:
                    for _ in range(n):
                        place = insert(place)
                        edit, place = edits[place], place + 1
                        if edit == "D":
                            continue
                        x = role[:1] if edit == "K" else "a" if state == USER else "u"
                        line(role if edit == "K" else ROLES[x], text)
                        state = STEPS[state, x]
            if len(out) > 1000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if facts is not None:
            close()
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return sorted_rows.mapInArrow(run, f"conv_id long, {fields}, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation of `turns` (conv_id, turn, role, text), after damage by row keys."""
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = cut_lineage(faults(damaged(turns)))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    repairs = combined(cut_lineage(stretches(ranges)))
    return hashed(rows, repairs, turns.select("conv_id").distinct())
