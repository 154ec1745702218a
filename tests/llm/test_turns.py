"""Conversation repair against exhaustive search and against its SQL."""

import itertools
import random
import re
import zlib

import duckdb
import pandas as pd

from tracewell.llm.queries import REPAIR_SQL
from tracewell.llm.turns import CLOSING, Spans, joined_cells, repair_conversations, row_cell

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """Least (cost, audit) over all edits with up to two insertions in each gap."""
    def edits(initial, fault):
        yield 2, "D", ""
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            yield extra, "K", initial
            yield from ((1 + extra, "R", x) for x in "ua")

    gaps = [(5 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au", "uu", "aa")]
    options = [gaps]
    for row in rows:
        options += [list(edits(*row)), gaps]
    found = []
    for choice in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(c[2] for c in choice)):
            found.append((sum(c[0] for c in choice), "".join(c[1] for c in choice)))
    return min(found)


def parsed(rows):
    spans = Spans()
    for row in rows:
        spans.add(row_cell(*row))
    cell = joined_cells(spans.whole(), CLOSING)
    return min(v for (p, _), v in cell.items() if p == 0)


def test_cells_like_exhaustive_search():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice("suatx"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 3))]
        assert parsed(rows) == exhaustive(rows), rows


def test_any_split_gives_the_same_cell():
    rng = random.Random(2)
    rows = [(rng.choice("suua"), rng.choice(["", "", "", "blank", "truncated"])) for _ in range(40)]
    whole = Spans()
    for row in rows:
        whole.add(row_cell(*row))
    for cut in (1, 7, 32, 39):
        left, right = Spans(), Spans()
        for row in rows[:cut]:
            left.add(row_cell(*row))
        for row in rows[cut:]:
            right.add(row_cell(*row))
        assert joined_cells(left.whole(), right.whole()) == whole.whole()


def table():
    rng = random.Random(3)
    texts = ["Hi.", "Hi", "", " \t", None, "Ok?\n", "é!", "x. y", "x" * 20_000 + ".", "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, 1, 2, 3, 4, 5, 9]), rng.choices(roles, [9, 9, 4, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += rows[:30]
    # one long conversation, cut into stretches
    rows += [(1000, t, ["user", "assistant"][t % 2], f"line {t % 90}" + ".?! "[t % 4]) for t in range(400)]
    # only rows that damage drops
    rows += [(2000, next(t for t in itertools.count() if zlib.crc32(f"2000:{t}".encode()) % 20 == 0), "user", "gone")]
    return rows


def test_like_the_sql(spark):
    rows = table()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n long, first string").repartition(5)
    # partitions stay as they are, so the long conversation is cut into stretches
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = repair_conversations(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.execute(REPAIR_SQL)
    names = [d[0] for d in want.description]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=key) == sorted(want.fetchall(), key=key)
    empty = [r for r in found.where("conv_id = 2000").collect()]
    assert [tuple(r)[1:8] for r in empty] == [(0, 0, 0, 0, 0, 0, "")]


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
