"""Collocations of two and three words, counted in tiles of frequency-ranked ids.

A unit is a word of a language (later: a frequent pair), known by a 64-bit hash. Units that are
frequent enough get ids by falling frequency. Neighbouring units are counted by tiles of
(left id, right id):

* the first tile, of the `DENSE` most frequent units on both sides, is one dense array per task,
  counted with bincount at the pair's own address;
* all other tiles are sparse: sorted codes with counts (COO), made once per two million words, dealt
  out by tile and stripe, merged there by sorting;
* units beyond the id table (its size is bounded, `IDS` and `PAIR_IDS`) keep their hash as id, and
  their neighbours are counted as rows. The result does not depend on where that border lies.

Frequent pairs are ranked in their turn and are the left units of the next round, which counts
triples. Only numbers move: a text is read by each of the three passes and never shuffled.

Defined results: null texts are empty, null languages are `und`; repeated rows count as often as
they occur; texts of any length are read whole, one at a time; equal scores are ordered by
count and phrase; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.text import LOWER, Rolling, mixed, pieces, strings, words
from tracewell.session import cut_lineage

#: bytes that end a piece, and bytes between words of a piece
BREAK, WORD = np.zeros(256, bool), np.ones(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD[BREAK] = False
WORD[[0x20, 0x09]] = False

LEAST = 10
#: units on each side of the dense tile
DENSE = 1024
#: ids are 20 and 22 bits; sparse tiles are 2**16 ids wide
IDS, PAIR_IDS, SIDE = 1 << 20, 1 << 22, 16
#: words after which a task's sparse counts are written out
CHUNK = 1 << 21
#: different codes that one stripe of a tile should hold at most, and codes in one row: 8 kB, as a
#: batch of rows is held whole at both ends
STRIPE, BLOCK = 1 << 21, 1 << 9
#: rows of codes that a task hands on together
TILE_ROWS = 512


def language(column: str):
    return F.coalesce(F.col(column), F.lit("und")).alias("lang")


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang of the rows, row of each word, hashes, joined to the next word, bytes, starts, ends)."""
    for batch in batches:
        seeds = {v: np.uint64(xxhash.xxh64_intdigest(v.encode())) for v in batch.column(0).unique().to_pylist()}
        rows_lang = batch.column(0).to_pylist()
        seed = np.array([seeds[v] for v in rows_lang], np.uint64)
        for row, end, data, offs in pieces(batch.column(1)):
            data = LOWER[data]
            starts, ends, first = words(data, offs, WORD)
            if not len(starts):
                continue
            own = row + np.repeat(np.arange(end - row), np.diff(first))
            unit = mixed(Rolling(data)(starts, ends) + seed[own])
            piece = np.cumsum(BREAK[data], dtype=np.int64)[starts]
            joined = np.zeros(len(starts), bool)
            joined[:-1] = (piece[1:] == piece[:-1]) & (own[1:] == own[:-1])
            yield rows_lang, own, unit, joined, data, starts, ends


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, unit, word, n of the words of about two million occurrences at a time."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
    seen = 0

    def out():
        unit = np.concatenate([h[0] for h in held])
        count = np.concatenate([h[1] for h in held])
        lang, word = (pa.concat_arrays([h[k] for h in held]) for k in (2, 3))
        _, at, back = np.unique(unit, return_index=True, return_inverse=True)
        n = np.bincount(back, weights=count).astype(np.int64)
        at = pa.array(at)
        return pa.record_batch(
            [lang.take(at), pa.array(unit.view(np.int64)).take(at), word.take(at), pa.array(n)],
            ["lang", "unit", "word", "n"],
        )

    for rows_lang, own, unit, _, data, starts, ends in tokens(batches):
        found, at, n = np.unique(unit, return_index=True, return_counts=True)
        order = np.argsort(at)
        at = at[order]
        cuts = np.stack([starts[at], ends[at]], 1).ravel()
        text = strings(data, np.append(cuts, cuts[-1])).take(pa.array(np.arange(0, 2 * len(at), 2)))
        lang = pa.array([rows_lang[i] for i in own[at].tolist()], pa.string())
        held.append((found[order], n[order], lang, text.cast(pa.large_string()).cast(pa.string())))
        seen += len(found)
        if seen >= CHUNK // 4:
            yield out()
            held, seen = [], 0
    if held:
        yield out()


def distinct_units(counted: DataFrame) -> DataFrame:
    """The table, staged; two different rows with one hash are refused."""
    staged = cut_lineage(counted)
    if staged.count() != staged.select("unit").distinct().count():
        raise ValueError("two different units have one 64-bit hash")
    return staged


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, unit, word, n of every word."""
    rows = texts.mapInArrow(_word_counts, "lang string, unit long, word string, n long")
    return distinct_units(rows.groupBy("lang", "unit", "word").agg(F.sum("n").alias("n")))


class Ranks:
    """Ids of the most frequent units, by falling frequency; `all_known` if there are no others."""

    def __init__(self, units: np.ndarray, all_known: bool):
        order = np.argsort(units)
        self.sorted, self.rank = units[order], order.astype(np.int64)
        self.by_rank, self.all_known = units, all_known

    def __call__(self, units: np.ndarray) -> np.ndarray:
        """The ids, -1 for units without one."""
        if not len(self.sorted):
            return np.full(len(units), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, units), len(self.sorted) - 1)
        return np.where(self.sorted[at] == units, self.rank[at], -1)


def ranked(counts: DataFrame, limit: int) -> Ranks:
    """Ids for at most `limit` units, the bound of what is sent to every task.

    Counts are looked at in steps of a sixteenth of a power of e; steps that fit whole get ids.
    """
    step = F.floor(F.log("n") * 16).cast("int")
    sizes = dict(counts.groupBy(step.alias("step")).count().collect())
    low, total = None, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > limit:
            break
        low, total = k, total + sizes[k]
    if low is None:
        return Ranks(np.zeros(0, np.uint64), not sizes)
    top = counts.where(step >= low).select("unit", "n").toArrow()
    units, n = (top.column(k).to_numpy() for k in (0, 1))
    return Ranks(units[np.lexsort((units, -n))].view(np.uint64), total == sum(sizes.values()))


def pair_unit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) + right * np.uint64(3) + np.uint64(1))


def _blocks(tile: int, stripe: int, codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of at most BLOCK codes, so that an Arrow batch of rows stays small."""
    for k in range(0, len(codes), BLOCK):
        part = (np.ascontiguousarray(x[k : k + BLOCK], np.int64).tobytes() for x in (codes, counts))
        yield tile, stripe, *part


TILES = "tile long, stripe int, codes binary, counts binary, left long, right long, n long"


def _tile_rows(rows: list[tuple]) -> pa.RecordBatch:
    tile, stripe, codes, counts = zip(*rows)
    none = pa.nulls(len(rows), pa.int64())
    return pa.record_batch(
        [pa.array(tile, pa.int64()), pa.array(stripe, pa.int32()), pa.array(codes, pa.binary()),
         pa.array(counts, pa.binary()), none, none, none],
        ["tile", "stripe", "codes", "counts", "left", "right", "n"],
    )


def _far_rows(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    n = np.diff(np.append(new, len(left)))
    blank = pa.nulls(len(new))
    return pa.record_batch(
        [blank.cast(pa.int64()), blank.cast(pa.int32()), blank.cast(pa.binary()), blank.cast(pa.binary()),
         pa.array(left[new].view(np.int64)), pa.array(right[new].view(np.int64)), pa.array(n)],
        ["tile", "stripe", "codes", "counts", "left", "right", "n"],
    )


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tile numbers above, places in the tile below: sorted codes are sorted by tile."""
    low = np.int64((1 << SIDE) - 1)
    tile = (left >> SIDE) << np.int64(12) | (right >> SIDE)
    return tile << np.int64(2 * SIDE) | (left & low) << np.int64(SIDE) | (right & low)


def _ids(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, tile = np.int64((1 << SIDE) - 1), codes >> np.int64(2 * SIDE)
    left = (tile >> np.int64(12)) << np.int64(SIDE) | (codes >> np.int64(SIDE)) & low
    return left, (tile & np.int64((1 << 12) - 1)) << np.int64(SIDE) | codes & low


def _sparse(codes: np.ndarray, stripes: int) -> Iterator[tuple]:
    """Sorted COO blocks of the codes, one and more per tile and stripe."""
    codes, counts = np.unique(codes, return_counts=True)
    tile = codes >> np.int64(2 * SIDE)
    stripe = (mixed(codes.view(np.uint64)) % np.uint64(stripes)).astype(np.int64)
    key = tile * stripes + stripe
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield from _blocks(int(tile[part[0]]), int(stripe[part[0]]), codes[part], counts[part])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, TILE_ROWS)):
        yield _tile_rows(part)


def count_tiles(texts: DataFrame, left: Ranks, right: Ranks, triples: bool, stripes: int, chunk: int) -> DataFrame:
    """Counts of neighbours by tile. Left units are words, or frequent pairs for `triples`."""

    def run(batches):
        dense = np.zeros(DENSE * DENSE, np.int64)
        held: list[np.ndarray] = []
        seen = 0
        for *_, unit, joined, _, _, _ in tokens(batches):
            if triples:
                if len(unit) < 3:
                    continue
                pairs = pair_unit(unit[:-1], unit[1:])
                ids = left(pairs)
                near = joined[:-2] & joined[1:-1]
                if left.all_known:  # both pairs of a frequent triple are frequent
                    near &= (ids[:-1] >= 0) & (ids[1:] >= 0)
                at = np.flatnonzero(near)
                first, second, a = pairs[at], unit[at + 2], ids[at]
                b, near = right(second), np.ones(len(at), bool)
            else:
                ids = left(unit)
                a, b, near = ids[:-1], ids[1:], joined[:-1]
                first, second = unit[:-1], unit[1:]
            known = near & (a >= 0) & (b >= 0)
            core = known & (a < DENSE) & (b < DENSE)
            dense += np.bincount(a[core] * DENSE + b[core], minlength=DENSE * DENSE)
            rest = known & ~core
            held.append(_codes(a[rest], b[rest]))
            seen += len(held[-1])
            far = near & ~known
            far &= ~((a < 0) & left.all_known) & ~((b < 0) & right.all_known)
            if far.any():
                yield _far_rows(first[far], second[far])
            if seen >= chunk:
                yield from _batches(_sparse(np.concatenate(held), stripes))
                held, seen = [], 0
        if seen:
            yield from _batches(_sparse(np.concatenate(held), stripes))
        at = np.flatnonzero(dense)
        yield from _batches(_blocks(-1, 0, at, dense[at]))

    return texts.mapInArrow(run, TILES)


class Merged:
    """Different codes in order, with their counts; what is added is sorted by itself and laid in."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        if not len(codes):
            return
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, counts = codes[first], np.add.reduceat(counts, first)
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        self.counts[at[known]] += counts[known]
        at, new = at[~known], ~known
        self.codes, self.counts = np.insert(self.codes, at, codes[new]), np.insert(self.counts, at, counts[new])


def frequent(tiles: DataFrame, left: Ranks, right: Ranks, least: int) -> DataFrame:
    """left, right, n of the neighbours that occur `least` times and more."""
    schema = "left long, right long, n long"

    def out(key, merged: Merged) -> pa.RecordBatch:
        enough = merged.counts >= least
        code, n = merged.codes[enough], merged.counts[enough]
        a, b = (code // DENSE, code % DENSE) if key[0] < 0 else _ids(code)
        units = (pa.array(side.by_rank[ids].view(np.int64)) for side, ids in ((left, a), (right, b)))
        return pa.record_batch([*units, pa.array(n)], ["left", "right", "n"])

    def run(batches):
        key, merged, codes, counts, fresh = None, Merged(), [], [], 0

        def lay_in():
            nonlocal codes, counts, fresh
            if fresh:
                merged.add(np.concatenate(codes), np.concatenate(counts))
            codes, counts, fresh = [], [], 0

        for batch in batches:
            for tile, stripe, c, n in zip(*(batch.column(i) for i in range(4))):
                now = (tile.as_py(), stripe.as_py())
                if now != key:
                    lay_in()
                    if key is not None:
                        yield out(key, merged)
                    key, merged = now, Merged()
                codes.append(np.frombuffer(c.as_py(), np.int64))
                counts.append(np.frombuffer(n.as_py(), np.int64))
                fresh += len(codes[-1])
                if fresh > STRIPE // 8:
                    lay_in()
        lay_in()
        if key is not None:
            yield out(key, merged)

    blocks = tiles.where("tile is not null").select("tile", "stripe", "codes", "counts")
    near = blocks.repartition("tile", "stripe").sortWithinPartitions("tile", "stripe").mapInArrow(run, schema)
    if left.all_known and right.all_known:
        return near
    rows = tiles.where("tile is null").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return near.unionByName(rows.where(F.col("n") >= least))


def with_unit(pairs: DataFrame) -> DataFrame:
    """The pairs with the hash by which the next round knows them."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield batch.append_column("unit", pa.array(pair_unit(a, b).view(np.int64)))

    return pairs.select("left", "right", "n").mapInArrow(run, "left long, right long, n long, unit long")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    per_lang: int = 2000,
    overlap: int = 50,
    ids: int = IDS,
    pair_ids: int = PAIR_IDS,
    chunk: int = CHUNK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    a, l, r: occurrences of the phrase and of the two parts at its weakest cut; n: words of the
    language. `overlap`: a pair within a triple that makes up this percentage of it is left out.
    """
    texts = docs.select(language(lang_col), F.col(text_col).alias("text"))
    every = word_counts(texts)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = cut_lineage(every.where(F.col("n") >= least))
    volume = every.agg(F.sum("n")).first()[0] or 0
    stripes = 1 + volume // STRIPE // 4
    rank = ranked(singles, ids)
    tiles = count_tiles(texts, rank, rank, False, stripes, chunk)
    # a far pair may hold words that are too rare for any phrase; its own count settles that
    pairs = distinct_units(with_unit(frequent(tiles, rank, rank, least)))
    pair_rank = ranked(pairs, pair_ids)
    tiles = count_tiles(texts, pair_rank, rank, True, stripes, chunk)
    found = cut_lineage(frequent(tiles, pair_rank, rank, least))
    # a far triple may begin with a pair that is no frequent one: the join leaves it out
    triples = found.select(F.col("left").alias("unit"), F.col("right").alias("third"), F.col("n").alias("a")).join(
        pairs.select("unit", F.col("left").alias("first"), F.col("right").alias("second"), F.col("n").alias("head")), "unit"
    )
    tails = pairs.select(
        F.col("left").alias("second"), F.col("right").alias("third"), F.col("n").alias("tail"), F.col("unit").alias("tail_unit")
    )
    triples = cut_lineage(triples.join(tails, ["second", "third"]))
    inside = triples.select("unit", "a").union(triples.select(F.col("tail_unit"), "a"))
    longest = inside.groupBy("unit").agg(F.max("a").alias("longer"))
    kept = (
        pairs.join(longest, "unit", "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < overlap * F.col("n")))
        .select(F.col("left").alias("first"), F.col("right").alias("second"), F.col("n").alias("a"))
    )
    word = lambda k: singles.select(
        F.col("unit").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"), F.col("lang").alias(f"{k}_lang")
    )

    def score(a, l, r):  # noqa: E741
        return F.expr(
            f"cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))"
            f" div (cast({l} as decimal(19,0)) * cast({r} as decimal(18,0)))"
        )

    two = (
        kept.join(word("first"), "first").join(word("second"), "second")
        .select(
            F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "a",
            F.col("first_n").alias("l"), F.col("second_n").alias("r"), score("a", "first_n", "second_n").alias("score"),
        )
    )
    three = (
        triples.join(word("first"), "first").join(word("second").select("second", "second_word"), "second")
        .join(word("third"), "third")
        .withColumn("one", score("a", "first_n", "tail")).withColumn("two", score("a", "head", "third_n"))
        .withColumn("early", F.col("one") <= F.col("two"))
        .select(
            F.col("first_lang").alias("lang"),
            F.concat_ws(" ", "first_word", "second_word", "third_word").alias("phrase"), "a",
            F.when(F.col("early"), F.col("first_n")).otherwise(F.col("head")).alias("l"),
            F.when(F.col("early"), F.col("tail")).otherwise(F.col("third_n")).alias("r"),
            F.least("one", "two").alias("score"),
        )
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranks = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_lang)
    joined = ranks.join(totals, "lang")
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
