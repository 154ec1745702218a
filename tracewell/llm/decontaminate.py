"""Benchmark decontamination: word n-grams as seeds, Smith-Waterman on what they find.

The benchmark is a stated set of queries. It is worked on in blocks of a bounded number of bytes,
and only a block is sent to the executors. For each block one pass finds its n-grams in the
documents and aligns the words around them with the item by Smith-Waterman. Every n-gram of a
passage is a seed: an edited copy breaks the n-grams around its edits, and which ones are left
cannot be told from how often they occur. The texts are at hand in the pass, so only verified
leaks leave a task.

The score is the alignment's (a match counts 1, a mismatch or a gap costs one half) divided by
the words of the item's passage. Long items are cut into overlapping passages, so an alignment
is bounded; documents are worked on in bounded pieces of neighbouring rows.

Words are compared in lower case, of any script. Defined results: null and empty texts hold
no leak; an item with fewer words than an n-gram
matches nothing; repeated items and repeated documents each give their own rows; an empty
table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import ALNUM, Rolling, mixed, pieces, tidy, utf8, words

GRAM = 3
PASSAGE, OVERLAP = 128, 32
MIN_SCORE = 0.5
PENALTY = 0.5
#: bytes of item texts that one pass over the documents is made for
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, score double, n_words int, first_word int, last_word int"


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all rows, first word of each row and the total)."""
    starts, ends, first = words(data, offs, ALNUM)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return Rolling(data)(starts, ends), first


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, wherever rows end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out) + hashes[k : k + n]
    return mixed(out)


def whole_grams(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of n grams whether it lies in one row."""
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= row_end


class Passages:
    """A block of items: their passages as word hashes, and all their n-grams as seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int):
        self.size = size
        data, offs = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        hashes, first = word_hashes(data, offs)
        self.item: list[int] = []
        self.words: list[np.ndarray] = []
        for i, item in enumerate(ids):
            mine = hashes[first[i] : first[i + 1]]
            for at in range(0, max(1, len(mine) - OVERLAP), PASSAGE - OVERLAP):
                part = mine[at : at + PASSAGE]
                if len(part) >= size:
                    self.item.append(item)
                    self.words.append(part)
        seeds: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(self.words):
            for i, gram in enumerate(gram_hashes(w, size).tolist()):
                seeds.setdefault(gram, []).append((p, i))
        #: seeds, sorted, and the (passage, offset) places of each
        self.seeds = np.array(sorted(seeds), np.uint64)
        self.places = [seeds[g] for g in self.seeds.tolist()]
        self.filter = bits_of(self.seeds)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """A table that tells most hashes outside the set at once."""
    size = 1 << max(16, int(len(hashes)).bit_length() + 5)
    out = np.zeros(size, bool)
    out[hashes & np.uint64(size - 1)] = True
    return out


def hits(grams: np.ndarray, known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in grams, places in known) of all grams that are known."""
    maybe = np.flatnonzero(table[grams & np.uint64(len(table) - 1)])
    at = np.searchsorted(known, grams[maybe])
    at[at == len(known)] = 0
    sure = known[at] == grams[maybe] if len(known) else np.zeros(len(maybe), bool)
    return maybe[sure], at[sure]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """(best local score, end of that alignment in the text); the earliest end on ties."""
    steps = PENALTY * np.arange(1, len(text) + 1)
    row = np.zeros(len(text))
    best, end = 0.0, 0
    for word in item:
        step = np.where(text == word, 1.0, -PENALTY)
        diagonal = step.copy()
        diagonal[1:] += row[:-1]
        row = np.maximum(np.maximum(diagonal, row - PENALTY), 0.0)
        # gaps in the item: the best cell to the left, less a penalty for each step
        row = np.maximum.accumulate(row + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at + 1
    return best, end


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score, first word, end word) of the best local alignment of the item in the text."""
    best, end = smith_waterman(item, text)
    if best <= 0:
        return 0.0, 0, 0
    _, back = smith_waterman(item[::-1], text[:end][::-1])
    return best, end - back, end


def leaks_of_row(hashes: np.ndarray, found: list[tuple[int, int, int]], known: Passages, min_score: float) -> dict:
    """item -> (score, passage words, first, last word); found: (passage, offset, place)."""
    ranges: dict[int, list[list[int]]] = {}
    for p, offset, place in sorted(found, key=lambda f: (f[0], f[2])):
        m = len(known.words[p])
        # a leak's gaps are fewer than the item's words, so it lies within them on either side
        lo, hi = max(0, place - offset - m), min(len(hashes), place - offset + 2 * m)
        mine = ranges.setdefault(p, [])
        # neighbouring candidates share a window, but a window stays bounded
        if mine and lo <= mine[-1][1] and hi - mine[-1][0] <= 8 * m:
            mine[-1][1] = max(hi, mine[-1][1])
        else:
            mine.append([lo, hi])
    out: dict[int, tuple[float, int, int, int]] = {}
    for p, windows in ranges.items():
        item = known.words[p]
        for lo, hi in windows:
            text = hashes[lo:hi]
            # an alignment cannot score more than the item's words that the window holds
            if np.isin(item, text).sum() < min_score * len(item):
                continue
            score, first, end = align(item, text)
            share = score / len(item)
            if share >= min_score and share > out.get(known.item[p], (0.0,))[0]:
                out[known.item[p]] = (share, len(item), lo + first, lo + end - 1)
    return out


def leaks_in(known: Passages, column: pa.Array, size: int, min_score: float):
    """(row, item, share, words, first, last word) of every leak in a text column."""
    for row, _, data, offs in pieces(pc.utf8_lower(column)):
        hashes, first = word_hashes(data, offs)
        grams = gram_hashes(hashes, size)
        place, at = hits(grams, known.seeds, known.filter)
        whole = whole_grams(first, len(grams), size)[place]
        place, at = place[whole], at[whole]
        of = np.searchsorted(first, place, side="right") - 1
        by_row: dict[int, list[tuple[int, int, int]]] = {}
        for r, w, seed in zip(of.tolist(), place.tolist(), at.tolist()):
            for p, offset in known.places[seed]:
                by_row.setdefault(r, []).append((p, offset, w - int(first[r])))
        for r, found in by_row.items():
            mine = hashes[first[r] : first[r + 1]]
            for item, leak in leaks_of_row(mine, found, known, min_score).items():
                yield row + r, item, *leak


def find_leaks(docs: DataFrame, block, size: int, min_score: float) -> DataFrame:
    @tidy
    def run(batches):
        for batch in batches:
            rows = list(leaks_in(block.value, batch.column(1), size, min_score))
            if rows:
                of, item, score, n, lo, hi = zip(*rows)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(of)), pa.array(item, pa.int64()), pa.array(score, pa.float64()),
                        *(pa.array(x, pa.int32()) for x in (n, lo, hi)),
                    ],
                    ["doc_id", "item_id", "score", "n_words", "first_word", "last_word"],
                )

    return docs.mapInArrow(run, SCHEMA)


def drop_leaks(docs: DataFrame, block, text_col: str, size: int, min_score: float) -> DataFrame:
    place = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[leak[0] for leak in leaks_in(block.value, batch.column(place), size, min_score)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def seeded_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, size: int, block_bytes: int):
    """The benchmark in blocks with their seeds, each sent to the executors."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()
        known = Passages([r.item for r in rows], [r.body for r in rows], size)
        if len(known.seeds):
            yield spark.sparkContext.broadcast(known)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = GRAM,
    min_score: float = MIN_SCORE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, score, n_words, first_word, last_word of every leak, the best per pair.

    A passage that leaked with a run of `size` words unharmed is always found.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in seeded_blocks(benchmark, item_col, item_text_col, size, block_bytes):
        out = out.union(find_leaks(chosen, block, size, min_score))
    return out


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = GRAM,
    min_score: float = MIN_SCORE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that hold no leak, with all their columns; no shuffle."""
    for block in seeded_blocks(benchmark, item_col, item_text_col, size, block_bytes):
        docs = drop_leaks(docs, block, text_col, size, min_score)
    return docs
