"""Removal of repeated windows by a depth-limited most-significant-digit radix sort.

A window is a number of neighbouring symbols: bytes, or words (known by 64-bit hashes). Suffixes are
only ordered through the window's length, and only as far as needed to tell whether a group has
more than one member. The digits of a window, most significant first:

1. its key: the `digit` symbols within it whose hash is least (the leftmost on ties), found for all
   windows of a text at once by a sliding minimum. Neighbouring windows share their key, so a
   stretch of windows, not each window, is one row. Keys seen once end here: their windows cannot
   be repeated. Where a text has a period, neighbouring stretches are equal; such a run is one row.
2. its stretch: all symbols of the windows that share the key. Equal stretches are runs of
   repeated windows, however many copies there are; one of each is kept to compare others with.
3. for keys with different stretches only: blocks of neighbouring windows. Windows of a block
   share its core; a core that is alone ends its windows, a block that is repeated whole
   decides them.
4. the whole window, where blocks differ. Groups of two and more are exactly the repeated
   windows.

Windows of bytes and of words go through the same passes side by side, so texts move once for both.
Equal strings have equal digits in every pass, so no repeated window is lost; digits of 64-bit
hashes are compared together, at least 128 bits in all for any window that is removed.

Defined results: null and empty texts have no windows and nothing to remove; repeated rows
repeat each other; equal ids with different texts are different documents. Texts are worked
on in stretches, so a long text needs memory for itself once, not for its windows. Empty
tables give empty results. Other columns are neither read nor touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import PIECE_BYTES, SPACE, Rolling, pieces, tidy, utf8, words
from tracewell.session import settled

WINDOW, WORDS = 400, 50
#: bytes of the first digit: longer ones end more windows early, shorter ones give fewer rows
DIGIT, WORD_DIGIT = 100, 10
ROW = ["doc_id", "mark"]


@dataclass(frozen=True)
class Windows:
    """What a window is made of ("bytes" or "words"), its symbols and those of its first digit."""

    of: str
    window: int
    digit: int

    def symbols(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, symbols, offsets of the rows) of all rows, in pieces."""
        if self.of == "bytes":
            yield 0, *utf8(column)
            return
        for row, _, data, offs in pieces(column):
            starts, ends, first = words(data, offs, ~SPACE)
            yield row, word_hashes(data, starts, ends), first

    def of_text(self, text: bytes) -> tuple[bytes, int]:
        """(the symbols as one string, bytes of each)."""
        if self.of == "bytes":
            return text, 1
        data, starts, ends = text_words(text)
        return word_hashes(data, starts, ends).tobytes(), 8

    def byte_spans(self, text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if self.of == "bytes" or not spans:
            return spans
        _, starts, ends = text_words(text)
        return [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in spans]


def text_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ~SPACE)
    return data, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; long texts are hashed in stretches of whole words."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, side="right")))
        base = starts[at]
        out[at:until] = Rolling(data[base : ends[until - 1]])(starts[at:until] - base, ends[at:until] - base)
        at = until
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima from both sides of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(
    data: np.ndarray, offs: np.ndarray, window: int, digit: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key's place, key) of all runs of windows sharing a key."""
    n = len(data)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    rolling = Rolling(data)
    at = np.arange(n - digit + 1)
    hashes = rolling(at, at + digit)
    low = np.uint64((1 << n.bit_length()) - 1)
    least = sliding_minimum((hashes & ~low) | at.astype(np.uint64), window - digit + 1)
    usable = np.zeros(n + 1, np.int8)
    lengths = np.diff(offs)
    long = lengths >= window
    usable[offs[:-1][long]] = 1
    np.add.at(usable, offs[1:][long] - window + 1, -1)
    place = np.flatnonzero(np.cumsum(usable[: n - window + 1], dtype=np.int8))
    owner = (least[place] & low).astype(np.int64)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.diff(owner)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(place)]]) - 1
    own = owner[first]
    return place[first], place[last], own, hashes[own]


def cuts(offs: np.ndarray, window: int, limit: int = PIECE_BYTES):
    """(first row, end row, first byte, end byte) of work pieces; long rows in several.

    Pieces of one row overlap by window - 1 bytes, so every window is in exactly one.
    """
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        if end > row:
            yield row, end, offs[row], offs[end]
            row = end
            continue
        for start in range(offs[row], max(offs[row] + 1, offs[row + 1] - window + 1), limit):
            yield row, row + 1, start, min(offs[row + 1], start + limit + window - 1)
        row += 1


def first_digits(docs: DataFrame, kinds: Sequence[Windows]) -> DataFrame:
    """kind, key, stretch, doc_id, mark, lo, hi, at, until: a row for each run of windows with one key.

    Equal runs that follow each other are one row: the first is lo to hi, the last ends at `until`.
    """
    schema = "kind int, key long, stretch long, doc_id long, mark int, lo int, hi int, at int, until int"

    @tidy
    def run(batches):
        for batch in batches:
            for k, kind in enumerate(kinds):
                for base_row, data, offs in kind.symbols(batch.column(2)):
                    yield from digits_of(batch, k, kind, base_row, data, offs)

    def digits_of(batch, k, kind, base_row, data, offs):
        window = kind.window
        for row, end, a, b in cuts(offs, window):
            part = data[a:b]
            inner = np.clip(offs[row : end + 1], a, b) - a
            lo, hi, at, key = stretches(part, inner, window, kind.digit)
            if not len(lo):
                continue
            raw, whole, width = part.tobytes(), xxhash.xxh3_64_intdigest, part.itemsize
            spans = zip((lo * width).tolist(), ((hi + window) * width).tolist())
            same = np.array([whole(raw[x:y]) for x, y in spans], np.uint64)
            of = row + np.searchsorted(inner, lo, side="right") - 1
            new = np.ones(len(lo), bool)
            for x in (of, key, same, hi - lo):
                new[1:] &= x[1:] == x[:-1]
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            until = hi[np.append(first[1:], len(lo)) - 1]
            lo, hi, at, key, same, of = (x[first] for x in (lo, hi, at, key, same, of))
            base = offs[of] - a
            owner = pa.array(base_row + of)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(lo), k, np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(same.view(np.int64)),
                    batch.column(0).take(owner),
                    batch.column(1).take(owner),
                    *(pa.array((x - base).astype(np.int32)) for x in (lo, hi, at, until)),
                ],
                ["kind", "key", "stretch", "doc_id", "mark", "lo", "hi", "at", "until"],
            )

    return docs.mapInArrow(run, schema)


def members(rows: DataFrame) -> Column:
    """How many rows these are, where equal neighbours count one by one."""
    return F.sum(F.expr("(until - lo + 1) div (hi - lo + 1)")) if "until" in rows.columns else F.count(F.lit(1))


def several(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups of two members and more. They are staged: a join with them then reads both sides from
    shuffles, so a hot group's partition can be split."""
    found = rows.groupBy(*by).agg(members(rows).alias("n")).where(F.col("n") > 1)
    return settled(found.select(*by))


def with_text(docs: DataFrame, per_row: DataFrame, how: str) -> DataFrame:
    left = docs.alias("l")
    right = per_row.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    return left.join(right, same, how)


def shared_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows that are not alone in their group."""
    return settled(rows.join(several(rows, group), group, "left_semi"))


def refined(alive: DataFrame, group: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose kind occurs again in their group, one row of each kind of undecided groups).

    A group is undecided if it has several kinds, one of them alone. Only counts and one row
    per kind are gathered, never a group.
    """
    kinds = settled(
        alive.groupBy(*group, kind).agg(
            members(alive).alias("n"), F.min(F.struct(*ROW, "lo", "hi", "at")).alias("one")
        )
    )
    last = F.col("until" if "until" in alive.columns else "hi").alias("hi")
    equal = alive.join(kinds.where("n > 1").select(*group, kind), [*group, kind], "left_semi")
    mixed = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    undecided = settled(mixed.where("kinds > 1 and least = 1").select(*group))
    return equal.select("kind", *ROW, "lo", last), kinds.join(undecided, group, "left_semi").select("kind", "key", "one.*")


def digests(docs: DataFrame, ranges: DataFrame, step: int, kinds: Sequence[Windows]) -> DataFrame:
    """The next digit of given stretches: of blocks of `step` neighbouring windows.

    Blocks are cut by the windows' distance from the key, so equal windows are in equal blocks.
    `core` is a hash of the symbols that all windows of a block share, `whole` of all their symbols.
    `ranges`: kind, doc_id, mark, key, lo, hi, at. The stretches of a document are gathered in its
    row; there are never more of them than the document has keys.
    """
    listed = ranges.groupBy(*ROW).agg(F.collect_list(F.struct("kind", "key", "lo", "hi", "at")).alias("found"))
    schema = "kind int, key long, block int, core long, whole long, doc_id long, mark int, lo int, hi int, at int"

    def hashed(batch):
        digest = xxhash.xxh3_64_intdigest
        for row, ranges_of in enumerate(batch.column(3)):
            text, symbols = batch.column(2)[row].as_py().encode(), {}
            for r in ranges_of.as_py():
                k, key, lo, hi, at = r["kind"], r["key"], r["lo"], r["hi"], r["at"]
                if k not in symbols:
                    symbols[k] = kinds[k].of_text(text)
                (raw, width), window = symbols[k], kinds[k].window
                for block in range((at - hi) // step, (at - lo) // step + 1):
                    last = at - block * step
                    low, high = max(lo, last - step + 1), min(hi, last)
                    core = digest(raw[last * width : (last - step + 1 + window) * width])
                    # the seed keeps blocks apart that are cut short on different sides
                    whole = digest(raw[low * width : (high + window) * width], (last - high) * step + high - low)
                    yield row, k, key, block, core, whole, low, high, at

    @tidy
    def run(batches):
        for batch in batches:
            rows = hashed(batch)
            while out := list(islice(rows, 100_000)):
                of, kind, key, block, core, whole, lo, hi, at = zip(*out)
                yield pa.record_batch(
                    [
                        pa.array(kind, pa.int32()),
                        pa.array(key, pa.int64()),
                        pa.array(block, pa.int32()),
                        *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (core, whole)),
                        batch.column(0).take(pa.array(of)),
                        batch.column(1).take(pa.array(of)),
                        *(pa.array(x, pa.int32()) for x in (lo, hi, at)),
                    ],
                    ["kind", "key", "block", "core", "whole", "doc_id", "mark", "lo", "hi", "at"],
                )

    joined = with_text(docs, listed, "inner").select("l.doc_id", "l.mark", "l.text", "r.found")
    return joined.mapInArrow(run, schema)


#: windows of a block of the third digit
STEP = 16


def repeated_spans(docs: DataFrame, kinds: Sequence[Windows]) -> tuple[DataFrame, DataFrame]:
    """(kind, doc_id, mark, lo, hi of all repeated windows, runs together; the texts they are in).

    Texts are shuffled whole once, to keep those that share any key; later passes move these.
    """
    firsts = settled(first_digits(docs, kinds))
    by_key = ["kind", "key"]
    shared = shared_rows(firsts, by_key)
    touched = shared.select(*ROW).distinct()
    near = settled(with_text(docs, touched, "left_semi"))
    equal, ranges = refined(shared, by_key, "stretch")
    step = min(STEP, *(k.window for k in kinds))  # windows of a block share symbols
    blocks = settled(digests(near, ranges, step, kinds))
    same = [*by_key, "block", "core"]
    also, ranges = refined(shared_rows(blocks, same), same, "whole")
    windows = settled(digests(near, ranges, 1, kinds))
    twice = windows.join(several(windows, same), same, "left_semi").select("kind", *ROW, "lo", "hi")
    window = F.element_at(F.array(*(F.lit(k.window) for k in kinds)), F.col("kind") + 1)
    return equal.union(also).union(twice).withColumn("hi", F.col("hi") + window), near


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark and text; the mark tells rows with one id and different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), mark_of(text_col).alias("mark"), text.alias("text")
    )


def mark_of(text_col: str) -> Column:
    return F.hash(F.coalesce(F.col(text_col), F.lit("")))


def cleaned(docs: DataFrame, kinds: Sequence[Windows], texts: bool) -> DataFrame:
    """doc_id, mark and found of the documents that lose anything: for each kind of windows, in
    order, n_removed (bytes), n_spans, kept_sha256 and kept (with `texts`); null where the kind
    removes nothing.

    `docs` is marked(). Bytes are removed as they are counted; where that would halve a
    character, the kept text leaves the rest of it out.
    """
    spans, near = repeated_spans(docs, kinds)
    spans = spans.groupBy(*ROW).agg(F.collect_set(F.struct("kind", "lo", "hi")).alias("spans"))
    joined = with_text(near, spans, "inner").select("l.doc_id", "l.mark", "l.text", "r.spans")
    one = "struct<n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: string>"
    fields = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def without(raw: bytes, gone: list[tuple[int, int]]) -> dict | None:
        if not gone:
            return None
        rest, at = [], 0
        for lo, hi in gone:
            rest.append(raw[at:lo])
            at = hi
        left = b"".join([*rest, raw[at:]])
        return {
            "n_removed": len(raw) - len(left), "n_spans": len(gone),
            "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode("utf-8", "ignore") if texts else None,
        }

    @tidy
    def run(batches):
        for batch in batches:
            found = []
            for text, spans_of in zip(batch.column(2), batch.column(3)):
                raw, all_spans = text.as_py().encode(), spans_of.as_py()
                gone = (merged([x for x in all_spans if x["kind"] == k]) for k in range(len(kinds)))
                found.append([without(raw, kind.byte_spans(raw, g)) for kind, g in zip(kinds, gone)])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(fields))], ["doc_id", "mark", "found"]
            )

    # rows that are repeated whole have equal results
    return joined.mapInArrow(run, f"doc_id long, mark int, found array<{one}>").dropDuplicates(ROW)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    digit: int = DIGIT,
    words: int | None = None,
    word_digit: int = WORD_DIGIT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, by windows of bytes.

    With `words`, the same by windows of so many words follows: word_bytes_removed, word_spans,
    word_kept_sha256.
    """
    kinds = [Windows("bytes", window, digit)]
    if words is not None:
        kinds.append(Windows("words", words, min(words, word_digit)))
    chosen = marked(docs, id_col, text_col)
    found = cleaned(chosen, kinds, texts=False)
    parts = [F.col("found")[k][f].alias(f"{f}_{k}") for k in range(len(kinds)) for f in ("n_removed", "n_spans", "kept_sha256")]
    changed = found.select(*ROW, *parts)
    facts = chosen.select(
        "doc_id", "mark",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("whole_sha256"),
    )
    joined = with_text(facts, changed, "left")
    zero = F.lit(0).cast("long")

    def result(k: int, names: Sequence[str]) -> list[Column]:
        values = F.coalesce(f"n_removed_{k}", zero), F.coalesce(f"n_spans_{k}", zero), F.coalesce(f"kept_sha256_{k}", "whole_sha256")
        return [v.alias(n) for v, n in zip(values, names)]

    out = result(0, ["n_removed", "n_spans", "kept_sha256"])
    if words is not None:
        out += result(1, ["word_bytes_removed", "word_spans", "word_kept_sha256"])
    return joined.select("l.doc_id", "n_bytes", *out)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """All rows of `docs`, their texts without the passages of `words` words that also stand elsewhere.

    Every occurrence goes, with the white space inside it; no row goes, even if it is emptied. A column
    n_chars follows the text. Null texts stay null; rows of equal id and text have equal results; names
    of other columns are free.
    """
    found = cleaned(marked(docs, id_col, text_col), [Windows("words", words, min(words, WORD_DIGIT))], texts=True)
    changed = found.select(F.col("doc_id").alias("id"), "mark", F.col("found")[0]["kept"].alias("kept"))
    # the input's columns are one struct, so no name of theirs meets one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").cast("long").alias("row_id"), mark_of(f"row.`{text_col}`").alias("row_mark")
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_mark") == F.col("mark"))
    joined = rows.join(changed, same, "left")
    values = {c: F.col(f"row.`{c}`") for c in docs.columns}
    values[text_col] = F.coalesce("kept", values[text_col])
    if "n_chars" in docs.columns:
        length = F.when(F.col("kept").isNotNull(), F.char_length("kept")).otherwise(values["n_chars"])
        values["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return joined.select(*(v.alias(c) for c, v in values.items()))
