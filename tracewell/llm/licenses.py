"""License notices in texts, exact and with bounded errors.

A notice that occurs with at most e edits and is split into e + 1 pieces has at least one piece
unharmed (pigeonhole), so exact searches for the pieces, over many texts in one buffer, find
all candidates. Around these the regex library matches the notice with at most e edits and gives
label, edits and place.

Texts are compared as words: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, one blank
between them. A phrase of the base list counts wherever its words stand consecutively.

Defined results: null and empty texts have no words, no places, empty labels and score 0;
repeated rows give repeated rows; the whole of every text is searched; empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import ALNUM, LOWER, pieces

# Phrases whose exact places are counted, with their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices searched with errors, with their labels
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "this work is licensed under": "licensed",
    "all rights reserved": "reserved",
}
#: one edit for as many characters of a notice
CHARS_PER_EDIT = 10

SPANS = "array<struct<label string, notice string, edits int, first_word int, last_word int>>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    f"base_labels string, labels string, score double, spans {SPANS}"
)


def split_evenly(notice: str, parts: int) -> list[bytes]:
    raw = notice.encode()
    borders = [round(i * len(raw) / parts) for i in range(parts + 1)]
    return [raw[a:b] for a, b in zip(borders, borders[1:])]


def single_blanks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words with a blank after each, offsets of the rows, words per row)."""
    n = len(data)
    if n == 0:
        return data, offs, np.zeros(len(offs) - 1, np.int64)
    data = LOWER[data]
    within = ALNUM[data]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    before = np.zeros(n, bool)
    before[1:] = within[:-1]
    before &= ~border[:-1]
    keep = within | before
    kept = np.concatenate([[0], np.cumsum(keep)])[offs]
    started = np.concatenate([[0], np.cumsum(within & ~before)])[offs]
    return np.where(within, data, np.uint8(0x20))[keep], kept, np.diff(started)


def occurrences(raw: bytes, piece: bytes) -> list[int]:
    out, at = [], raw.find(piece)
    while at >= 0:
        out.append(at)
        at = raw.find(piece, at + 1)
    return out


def matches(pattern, part: bytes) -> list[tuple[int, bytes, int]]:
    """(start, match, edits) of matches that do not overlap, in order; better ones are taken first.

    The search gives the best match of a stretch, so the stretches before and behind it follow.
    They reach to the blanks around it: words stay whole.
    """
    out, todo = [], [(0, len(part))]
    while todo:
        lo, hi = todo.pop()
        if lo < hi and (m := pattern.search(part, lo, hi)):
            out.append((m.start(), m.group(), sum(m.fuzzy_counts)))
            if m.start() < m.end():
                todo += [(lo, m.start()), (m.end(), hi)]
    return sorted(out)


class Searcher:
    """Patterns and pieces of the phrase lists; made once per task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        import regex

        self.base = [(regex.compile(rb"(?<![^ ])%s(?![^ ])" % p.encode()), label) for p, label in base.items()]
        self.seeds: dict[bytes, list[int]] = {p.encode(): [] for p in base}
        self.notices = []
        for k, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // chars_per_edit
            # best match first, so that edits are as few as can be
            pattern = regex.compile(rb"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (notice.encode(), edits))
            self.notices.append((pattern, label, notice, edits))
            for piece in split_evenly(notice, edits + 1):
                self.seeds.setdefault(piece, []).append(k)

    def row(self, raw: bytes, found: dict[int, list[int]]) -> tuple[list[tuple[int, str]], list[dict]]:
        """(places of base phrases, spans of notices); found: notice -> places of its pieces."""
        def word(at: int) -> int:
            return raw.count(b" ", 0, at)

        exact = [(word(m.start()), label) for pattern, label in self.base for m in pattern.finditer(raw)]
        spans = []
        for k, places in found.items():
            pattern, label, notice, edits = self.notices[k]
            reach = len(notice) + edits + 1
            ranges: list[list[int]] = []
            for at in sorted(places):
                lo, hi = max(0, at - reach), min(len(raw), at + 2 * reach)
                lo = raw.rfind(b" ", 0, lo) + 1 if lo else 0  # whole words
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1][1] = max(hi, ranges[-1][1])
                else:
                    ranges.append([lo, hi])
            for lo, hi in ranges:
                hi = len(raw) if (end := raw.find(b" ", hi)) < 0 else end
                for start, match, n in matches(pattern, raw[lo:hi]):
                    first = word(lo + start)
                    last = first + match.strip().count(b" ")
                    spans.append({"label": label, "notice": notice, "edits": n, "first_word": first, "last_word": last})
        return exact, spans


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE,
    notices: dict[str, str] = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One narrow pass. score: the share of characters unharmed in the best match, 1 for an exact
    phrase, 0 without any match.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def found_in(raw: bytes, offs: np.ndarray, searcher: Searcher) -> dict[int, dict[int, list[int]]]:
        rows: dict[int, dict[int, list[int]]] = {}
        for seed, owners in searcher.seeds.items():
            at = np.array(occurrences(raw, seed), np.int64)
            for row, place in zip((np.searchsorted(offs, at, side="right") - 1).tolist(), at.tolist()):
                of = rows.setdefault(row, {})
                for k in owners:
                    of.setdefault(k, []).append(place - int(offs[row]))
        return rows

    def run(batches):
        searcher = Searcher(base, notices, chars_per_edit)
        for batch in batches:
            for row, end, data, offs in pieces(batch.column(1)):
                words, at, n_words = single_blanks(data, offs)
                raw = words.tobytes()
                n = end - row
                n_base = np.zeros(n, np.int64)
                first, last = [None] * n, [None] * n
                base_labels, labels, score, spans = [""] * n, [""] * n, np.zeros(n), [[] for _ in range(n)]
                for i, of in found_in(raw, at, searcher).items():
                    exact, fuzzy = searcher.row(raw[at[i] : at[i + 1]], of)
                    mine = {label for _, label in exact}
                    n_base[i] = len(exact)
                    if exact:
                        first[i], last[i] = min(exact)[0], max(exact)[0]
                    base_labels[i] = ",".join(sorted(mine))
                    labels[i] = ",".join(sorted(mine | {s["label"] for s in fuzzy}))
                    best = [1 - s["edits"] / len(s["notice"]) for s in fuzzy]
                    score[i] = max([*best, 1.0 if exact else 0.0])
                    spans[i] = fuzzy
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, n), pa.array(n_words), pa.array(n_base),
                        pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                        pa.array(base_labels, pa.string()), pa.array(labels, pa.string()),
                        pa.array(score), pa.array(spans, SPAN_TYPE),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return chosen.mapInArrow(run, SCHEMA)


SPAN_TYPE = pa.list_(
    pa.struct(
        [("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]
    )
)
