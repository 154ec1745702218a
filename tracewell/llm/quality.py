"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its potential comes from binned features of itself and of
both neighbouring lines, and neighbouring labels have weights of their own. Forward-backward
gives each line's probability of being bad; the mean of these, weighted by the lines' lengths,
becomes the document's score through a logistic curve.

Labels are known per document only. Lines start with the label of their document; after a fit,
lines of bad documents that look good are good for the next fit, at least one line stays bad.

The fit uses a bounded sample: at most `max_docs` labelled documents, the first by hash, of each at
most `max_chars` characters from a hashed place on. Every document is scored whole.

Defined results: null and empty texts have no line and get the score that the curve gives to the
training share of bad documents without text, 0.0 if there was none; ties do not arise, as
documents are scored apart; repeated rows get equal scores. Without training rows, or with one
label only, the score is the share of good training rows, 0.5 without any. Only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import SPACE, Rolling, mixed, pieces, tidy, words

MAX_DOCS, MAX_CHARS = 2500, 12_000
ROUNDS, STEPS, RIDGE = 3, 120, 1.0
SCHEMA = "doc_id long, score double, predicted int, n_lines int, bad_share double"

#: byte classes counted per line, two to a 64-bit counter
CLASSES = ("upper", "lower", "digit", "blank", "shout", "symbol", "bar", "other")


def class_table() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"))
    kind[0x41:0x5B] = CLASSES.index("upper")
    kind[0x61:0x7B] = CLASSES.index("lower")
    kind[0x80:0x100] = CLASSES.index("lower")
    kind[0x30:0x3A] = CLASSES.index("digit")
    kind[SPACE] = CLASSES.index("blank")
    for name, chars in (("shout", b"!?"), ("symbol", b"#*$%&<>=_~^"), ("bar", b"|")):
        kind[list(chars)] = CLASSES.index(name)
    out = np.zeros((len(CLASSES) // 2, 256), np.uint64)
    for k in range(len(CLASSES)):
        out[k // 2, kind == k] = np.uint64(1) << np.uint64(32 * (k % 2))
    return out


TABLE = class_table()
SHARES = np.array([0.01, 0.05, 0.15, 0.3, 0.5, 0.75])
#: per feature: its bin borders
BORDERS: dict[str, np.ndarray] = {
    "upper": SHARES, "digit": SHARES, "blank": SHARES, "shout": SHARES / 3, "symbol": SHARES / 3,
    "bar": SHARES / 5, "other": SHARES / 3,
    "word_length": np.array([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0]),
    "words": np.array([2.0, 4.0, 8.0, 16.0, 64.0, 256.0]),
    "same_as_before": SHARES,
    "line_again": np.array([0.5]),
    "text_words": np.array([5.0, 10.0, 20.0, 50.0, 100.0, 1000.0]),
    "text_again": SHARES,
}
#: bins of one feature, bin 0 for "no such line"
WIDTH = 1 + max(len(b) + 1 for b in BORDERS.values())
FEATURES = len(BORDERS) * 3
INPUTS = FEATURES * WIDTH


@dataclass
class Lines:
    """Lines with a word of some rows: their row, length, and active inputs, in order."""

    row: np.ndarray
    length: np.ndarray
    inputs: np.ndarray
    rows: int


def lines_of(data: np.ndarray, offs: np.ndarray) -> Lines:
    rows = len(offs) - 1
    starts, ends, first = words(data, offs, ~SPACE)
    if not len(starts):
        return Lines(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FEATURES), np.int32), rows)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 0x0A
    cut[offs] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))
    # the line of each word; lines without any go
    of = np.searchsorted(begin, starts, side="right") - 1
    n_words = np.bincount(of, minlength=len(begin))
    keep = np.flatnonzero(n_words)
    begin, end, n_words = begin[keep], end[keep], n_words[keep]
    at = np.concatenate([[0], np.cumsum(n_words)])
    row = np.searchsorted(offs, begin, side="right") - 1
    length = (end - begin).astype(float)
    counts = {}
    for k in range(0, len(CLASSES), 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[k // 2][data])])
        both = sums[end] - sums[begin]
        counts[CLASSES[k]] = (both & np.uint64(0xFFFFFFFF)).astype(float)
        counts[CLASSES[k + 1]] = (both >> np.uint64(32)).astype(float)
    rolling = Rolling(data)
    hashes = rolling(starts, ends)
    again = np.zeros(len(starts) + 1)
    again[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    last = at[1:]
    same = again[last] - again[np.minimum(at[:-1] + 1, last)]
    # a line's bytes without what surrounds its words, so a last line without a line end is equal too
    whole = mixed(rolling(starts[at[:-1]], ends[last - 1]) + mixed(row.astype(np.uint64)))
    _, group, size = np.unique(whole, return_inverse=True, return_counts=True)
    repeated = size[group] > 1
    text_length = np.bincount(row, length, minlength=rows)[row]
    text_again = np.bincount(row, length * repeated, minlength=rows)[row] / text_length
    values = {k: counts[k] / length for k in ("upper", "digit", "blank", "shout", "symbol", "bar", "other")}
    values |= {
        "word_length": (length - counts["blank"]) / n_words,
        "words": n_words.astype(float),
        "same_as_before": same / n_words,
        "line_again": repeated.astype(float),
        "text_words": np.diff(first)[row].astype(float),
        "text_again": text_again,
    }
    bins = np.stack([1 + np.searchsorted(b, values[k], side="right") for k, b in BORDERS.items()], axis=1)
    neighbour = np.zeros_like(bins)
    neighbour[1:] = np.where((row[1:] == row[:-1])[:, None], bins[:-1], 0)
    follower = np.zeros_like(bins)
    follower[:-1] = np.where((row[1:] == row[:-1])[:, None], bins[1:], 0)
    every = np.concatenate([neighbour, bins, follower], axis=1)
    return Lines(row, length, (every + WIDTH * np.arange(FEATURES)).astype(np.int32), rows)


def joined(texts: pa.Array) -> Lines:
    """The lines of all texts, found a piece at a time."""
    parts = [(row, lines_of(data, offs)) for row, _, data, offs in pieces(texts)]
    return Lines(
        np.concatenate([row + part.row for row, part in parts]),
        np.concatenate([part.length for _, part in parts]),
        np.concatenate([part.inputs for _, part in parts]),
        len(texts),
    )


@dataclass
class Field:
    """Weights: of the inputs for "bad", of neighbouring labels, and the document's curve."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(INPUTS))
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    empty: float = 0.0
    constant: float | None = None

    def potentials(self, lines: Lines) -> np.ndarray:
        return self.weights[lines.inputs].sum(axis=1)

    def marginals(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """(P(bad) of each line, P(labels of the line before and of the line), 2 x 2 each).

        All rows take a step together: the k-th lines of all rows that have so many.
        """
        n = len(lines.row)
        local = np.zeros((n, 2))
        local[:, 1] = np.clip(self.potentials(lines), -30, 30)
        local = np.exp(local - local.max(axis=1, keepdims=True)) if n else local
        move = np.exp(self.change)
        count = np.bincount(lines.row, minlength=lines.rows)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        order = np.argsort(-count, kind="stable")
        deep = count[order]
        ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
        steps = int(count.max()) if n else 0
        active = [first[order[: np.searchsorted(-deep, -k, side="left")]] + k for k in range(steps)]
        for k, at in enumerate(active):
            score = local[at] if k == 0 else (ahead[at - 1] @ move) * local[at]
            ahead[at] = score / score.sum(axis=1, keepdims=True)
        for at in reversed(active[1:]):
            score = (local[at] * behind[at]) @ move.T
            behind[at - 1] = score / score.sum(axis=1, keepdims=True)
        both = ahead * behind
        bad = (both[:, 1] / both.sum(axis=1)) if n else both[:, 0]
        pair = np.zeros((n, 2, 2))
        inner = np.concatenate(active[1:]) if steps > 1 else np.zeros(0, np.int64)
        joint = ahead[inner - 1][:, :, None] * move * (local[inner] * behind[inner])[:, None, :]
        pair[inner] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return bad, pair

    def fit(self, lines: Lines, bad: np.ndarray, steps: int, ridge: float) -> None:
        """Raises the conditional likelihood of the labels by Adam steps over the whole sample."""
        n = max(1, len(bad))
        inner = np.flatnonzero(np.diff(lines.row, prepend=-1) == 0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (bad[inner - 1], bad[inner]), 1)
        m = [np.zeros(INPUTS), np.zeros((2, 2))]
        v = [np.zeros(INPUTS), np.zeros((2, 2))]
        for step in range(1, steps + 1):
            chance, pair = self.marginals(lines)
            miss = np.repeat(bad - chance, FEATURES)
            slope = [
                np.bincount(lines.inputs.ravel(), miss, minlength=INPUTS) - ridge * self.weights,
                seen - pair.sum(axis=0) - ridge * self.change,
            ]
            for k, part in enumerate((self.weights, self.change)):
                g = slope[k] / n
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.98 * v[k] + 0.02 * g * g
                part += 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-9)

    def bad_shares(self, lines: Lines) -> np.ndarray:
        """Per row the mean of its lines' P(bad), weighted by length; nan without lines."""
        bad, _ = self.marginals(lines)
        weight = np.bincount(lines.row, lines.length, minlength=lines.rows)
        with np.errstate(invalid="ignore"):
            return np.bincount(lines.row, lines.length * bad, minlength=lines.rows) / weight

    def scores(self, shares: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(shares), self.constant)
        x = design(np.nan_to_num(shares))
        out = 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -30, 30)))
        return np.where(np.isnan(shares), self.empty, out)


def design(shares: np.ndarray) -> np.ndarray:
    inside = np.clip(shares, 1e-4, 1 - 1e-4)
    return np.stack([np.ones_like(shares), -np.log(inside / (1 - inside)), -shares], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(texts: list[str], good: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, ridge: float = RIDGE) -> Field:
    model = Field()
    if not len(good) or good.min() == good.max():
        model.constant = float(good.mean()) if len(good) else 0.5
        return model
    lines = joined(pa.array(texts, pa.string()))
    of_doc = 1 - good[lines.row]
    bad = of_doc.copy()
    for _ in range(rounds):
        model.fit(lines, bad, steps, ridge)
        chance, _ = model.marginals(lines)
        top = np.zeros(lines.rows)
        np.maximum.at(top, lines.row, chance)
        bad = (of_doc == 1) & ((chance > 0.5) | (chance >= top[lines.row]))
        bad = bad.astype(np.int64)
    shares = model.bad_shares(lines)
    known = ~np.isnan(shares)
    model.curve = tuple(logistic(design(shares[known]), good[known]).tolist())
    without = good[~known]
    model.empty = float(without.mean()) if len(without) else 0.0
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_docs: int, max_chars: int) -> list:
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn
    )
    chosen = (
        known.groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    from_ = F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length(text) - max_chars, F.lit(0)) + 1)
    # at most max_docs ids: small enough to send to the texts
    rows = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "y", F.substring(text, from_.cast("int") + 1, F.lit(max_chars)).alias("text")
    )
    return sorted(rows.distinct().collect(), key=lambda r: (r.doc_id, r.text))


def learned(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = MAX_DOCS,
    max_chars: int = MAX_CHARS,
) -> Field:
    """The model of labelled documents; `learn` tells the labels to learn from."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = sample(known, labels, label, F.lit(True) if learn is None else learn, max_docs, max_chars)
    return train([r.text for r in rows], np.array([r.y for r in rows], np.int64))


def scored(model: Field, column: pa.Array):
    """(first row, end row, scores, lines per row, bad shares) of pieces of a text column."""
    for row, end, data, offs in pieces(column):
        lines = lines_of(data, offs)
        shares = model.bad_shares(lines)
        yield row, end, model.scores(shares), np.bincount(lines.row, minlength=lines.rows), shares


def score_quality(
    docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score, predicted, n_lines, bad_share of every document."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed number of inputs

    @tidy
    def run(batches):
        for batch in batches:
            for row, end, score, count, shares in scored(sent.value, batch.column(1)):
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(np.nan_to_num(shares)),
                    ],
                    ["doc_id", "score", "predicted", "n_lines", "bad_share"],
                )

    return chosen.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows whose text scores one half or more, with all their columns; no shuffle."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch in batches:
            for row, end, score, _, _ in scored(sent.value, batch.column(place)):
                yield batch.slice(row, end - row).filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
