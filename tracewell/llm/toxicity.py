"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

Terms are the words of a text and what they begin with (3 to 9 characters), in lower case, each
in steps of frequency: a text with five of them has the terms "once", "twice", "3 times" and "5 times",
so a vector of length one still tells one slip from many. Document frequencies are counted over
all documents. The terms that say something about the label on the
training rows (a chi-squared test) are the vocabulary, and a text's vector has
their idf, of length one.

The index lists, per term, the training examples by blocks with the largest weight of each block.
A text's upper bound for a block is its weights times these maxima; blocks are opened from the
highest bound down until the k-th best similarity reaches the next bound. What is never
opened cannot be among the nearest, so the neighbours are exact.

Neighbours vote with their similarity, against a prior of one vote for the training share of the
label; the share of the votes is calibrated by a logistic curve fitted on votes among
the training examples, each without itself. The neighbours are the evidence of the score.

The fit uses a bounded sample of labelled rows (`max_examples`, by hash, and of equal texts
one); document frequencies, the search and the scores use all documents.

Defined results: null, empty and unknown texts have no neighbours and get the calibrated
prior; ties in similarity go to the smaller id; without training rows every score is 0. Rows
with a null label or id are not learned from. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import ALNUM, gather, pieces, strings, words
from tracewell.session import cut_lineage

MAX_EXAMPLES = 6000
MAX_TERMS = 4000
MIN_CHI2 = 25.0
NEIGHBOURS = 15
BLOCK = 32
PREFIXES = range(3, 10)
TIMES = (1, 2, 3, 5, 8)
SCHEMA = (
    "doc_id long, score double, predicted int, "
    "evidence array<struct<example_id long, label int, similarity double>>"
)


def coded_words(column: pa.Array):
    """(first row, end row, distinct words, code per word, first word of each row) of pieces."""
    for row, end, data, offs in pieces(pc.utf8_lower(column)):
        starts, ends, first = words(data, offs, ALNUM)
        cut = np.zeros(len(data) + 1, bool)
        cut[[0, len(data)]] = True
        cut[starts] = cut[ends] = True
        coded = strings(data, np.flatnonzero(cut)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = codes[(np.cumsum(cut) - 1)[starts]]  # without what stands between words
        yield row, end, coded.dictionary, codes, first


def prefixes_of(word: bytes) -> list[bytes]:
    text = word.decode("utf-8", "replace")
    return [word, *(("^" + text[:k]).encode() for k in PREFIXES if len(text) >= k)]


class Terms:
    """Finds the vocabulary's terms in texts; each word is looked up once."""

    def __init__(self, terms: list[tuple[bytes, int]]):
        #: per stem, of which stems are many fewer than words: (times, term)
        self.stems = {stem: i for i, stem in enumerate(sorted({t for t, _ in terms}))}
        self.steps: list[list[tuple[int, int]]] = [[] for _ in self.stems]
        for i, (stem, times) in enumerate(terms):
            self.steps[self.stems[stem]].append((times, i))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = tuple(self.stems[t] for t in prefixes_of(word) if t in self.stems)
            self.known[word] = found
        return found

    def found(self, column: pa.Array):
        """(row, its terms, ascending) of every row, in order."""
        none = np.zeros(0, np.int64)
        for row, end, distinct, codes, first in coded_words(column):
            of = [self.of_word(w) for w in distinct.to_pylist()]
            useful = np.array([len(x) > 0 for x in of], bool)
            hit = np.flatnonzero(useful[codes]) if len(codes) else none
            row_of = np.searchsorted(first, hit, side="right") - 1
            ends = np.searchsorted(row_of, np.arange(end - row + 1))
            for r in range(end - row):
                mine = hit[ends[r] : ends[r + 1]]
                count: dict[int, int] = {}
                for w in codes[mine].tolist():
                    for stem in of[w]:
                        count[stem] = count.get(stem, 0) + 1
                terms = [i for stem, n in count.items() for times, i in self.steps[stem] if n >= times]
                yield row + r, np.array(sorted(terms), np.int64) if terms else none


@dataclass
class Index:
    """Training examples as unit vectors, in blocks of neighbours by content."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    idf: np.ndarray
    prior: float
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        #: neighbours of vectors met before; the object stays in its worker from task to task
        self.answers: dict[bytes, tuple[list[int], list[float]]] = {}
        n, terms = len(self.ids), len(self.idf)
        self.blocks = -(-n // BLOCK) if n else 0
        lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for i, (at, weight) in enumerate(self.vectors):
            for t, w in zip(at.tolist(), weight.tolist()):
                lists[t].append((i, w))
        self.examples = [np.array([i for i, _ in x], np.int64) for x in lists]
        self.weights = [np.array([w for _, w in x]) for x in lists]
        #: per term: its blocks, where each begins in the list, and each block's largest weight
        self.block_of, self.block_start, self.block_max = [], [], []
        for of, weight in zip(self.examples, self.weights):
            found, start = np.unique(of // BLOCK, return_index=True)
            self.block_of.append(found)
            self.block_start.append(np.append(start, len(of)))
            self.block_max.append(np.maximum.reduceat(weight, start) if len(of) else weight)

    def vector(self, terms: np.ndarray) -> np.ndarray:
        weight = self.idf[terms]
        size = np.sqrt((weight**2).sum())
        return weight / size if size > 0 else weight

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int, without: int = -1):
        """(examples, similarities) of the k most similar, best first; exact."""
        bound = np.zeros(self.blocks)
        for t, w in zip(terms.tolist(), weight.tolist()):
            bound[self.block_of[t]] += w * self.block_max[t]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, score, at, take = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order):
            # a tie may hold a smaller id, so only lower bounds end the search
            if len(found) == k and bound[order[at]] < score[-1] - 1e-9:
                break
            # ever more blocks at once, so many ties cost few steps
            opened = order[at : at + take]
            at, take = at + take, 2 * take
            part = self.similarities(opened, terms, weight)
            where = np.flatnonzero(part > 0)
            example = opened[where // BLOCK] * BLOCK + where % BLOCK
            kept = example != without
            found = np.concatenate([found, example[kept]])
            score = np.concatenate([score, part[where[kept]]])
            best = np.lexsort((self.ids[found], -score))[:k]
            found, score = found[best], score[best]
        return found.tolist(), score.tolist()

    def similarities(self, opened: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Similarity to all examples of the opened blocks, block by block."""
        out = np.zeros(len(opened) * BLOCK)
        for t, w in zip(terms.tolist(), weight.tolist()):
            if not len(self.block_of[t]):
                continue
            at = np.searchsorted(self.block_of[t], opened)
            at[at == len(self.block_of[t])] = 0
            place = np.flatnonzero(self.block_of[t][at] == opened)
            first, last = self.block_start[t][at[place]], self.block_start[t][at[place] + 1]
            posts = gather(np.arange(len(self.weights[t])), first, last - first)
            where = self.examples[t][posts] % BLOCK + np.repeat(place, last - first) * BLOCK
            out[where] += w * self.weights[t][posts]
        return out

    def neighbours(self, terms: np.ndarray, k: int) -> tuple[list[int], list[float]]:
        """nearest() of a text's terms; texts with equal terms have equal vectors."""
        key = terms.tobytes()
        if key not in self.answers:
            if len(self.answers) > 100_000:
                self.answers.clear()
            self.answers[key] = self.nearest(terms, self.vector(terms), k)
        return self.answers[key]

    def vote(self, examples: list[int], similar: list[float]) -> float:
        """Log odds of the votes, similarities as weights, one vote for the prior."""
        s = np.array(similar)
        toxic = float(s[self.labels[examples] == 1].sum()) if examples else 0.0
        share = (toxic + self.prior) / (float(s.sum()) + 1)
        return float(np.log(share / (1 - share)))

    def calibrate(self, k: int) -> None:
        """Logistic curve over the votes among the examples, each without itself."""
        x = np.array(
            [self.vote(*self.nearest(t, w, k, without=i)) for i, (t, w) in enumerate(self.vectors)]
        )
        y, a, b = self.labels.astype(float), 1.0, 0.0
        for _ in range(50):  # Newton steps with a little ridge
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-9)
            gradient = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
            second = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
            step = np.linalg.solve(second, gradient)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(a), float(b)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -30, 30))))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """doc_id, y, text of at most `limit` labelled rows to learn from, the first by hash of id."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn
    )
    chosen = (
        known.groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # at most `limit` ids: small enough to send to the texts
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    one = rows.groupBy(F.xxhash64("text").alias("same"), "text").agg(F.min(F.struct("doc_id", "y")).alias("first"))
    return cut_lineage(one.select("first.doc_id", "first.y", "text").repartition(32, "doc_id"))


def choose_terms(rows: DataFrame, limit: int, min_chi2: float) -> list[tuple[bytes, int]]:
    """Terms whose presence goes with the label, by chi-squared, the strongest first."""

    def run(batches):
        total: dict[tuple[bytes, int], list[int]] = {}
        for batch in batches:
            y = batch.column(1).to_pylist()
            for row, _, distinct, codes, first in coded_words(batch.column(2)):
                stems = [prefixes_of(w) for w in distinct.to_pylist()]
                for r in range(len(first) - 1):
                    count: dict[bytes, int] = {}
                    mine = np.unique(codes[first[r] : first[r + 1]], return_counts=True)
                    for w, c in zip(*(x.tolist() for x in mine)):
                        for stem in stems[w]:
                            count[stem] = count.get(stem, 0) + c
                    for stem, c in count.items():
                        for times in TIMES:
                            if c >= times:
                                both = total.setdefault((stem, times), [0, 0])
                                both[0] += 1
                                both[1] += y[row + r]
        items = iter(total.items())
        while part := list(islice(items, 50_000)):
            terms, counts = zip(*part)
            yield pa.record_batch(
                [
                    pa.array([t for t, _ in terms], pa.binary()), pa.array([n for _, n in terms], pa.int32()),
                    pa.array([n for n, _ in counts], pa.int64()), pa.array([n for _, n in counts], pa.int64()),
                ],
                ["stem", "times", "n", "toxic"],
            )

    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counted = rows.mapInArrow(run, "stem binary, times int, n long, toxic long").groupBy("stem", "times").agg(
        F.sum("n").cast("double").alias("c"), F.sum("toxic").cast("double").alias("a")
    )
    a, c = F.col("a"), F.col("c")
    top = n * F.pow(a * (n - positive - c + a) - (c - a) * (positive - a), F.lit(2))
    under = c * (n - c) * (float(positive) * (n - positive))
    strong = counted.where((c > 1) & (under > 0)).withColumn("chi2", top / under).where(F.col("chi2") >= min_chi2)
    best = strong.orderBy(F.desc("chi2"), "stem", "times").limit(limit)
    return [(bytes(r.stem), r.times) for r in best.collect()]


def examples(rows: DataFrame, terms: list[tuple[bytes, int]]) -> list:
    """doc_id, y and terms of the examples; not their texts."""

    def run(batches):
        known = Terms(terms)
        for batch in batches:
            found = [t.tolist() for _, t in known.found(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "y", "terms"])

    return sorted(rows.mapInArrow(run, "doc_id long, y int, terms array<long>").collect())


def document_frequencies(docs: DataFrame, terms: list[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def run(batches):
        known, total, n = Terms(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, found in known.found(batch.column(0)):
                total[found] += 1
                n += 1
        yield pa.record_batch(
            [pa.array([*range(len(terms)), -1], pa.int64()), pa.array([*total.tolist(), n], pa.int64())], ["term", "n"]
        )

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counted.collect()}  # a row per term of the vocabulary
    return np.array([found.get(i, 0) for i in range(len(terms))]), found.get(-1, 0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    max_examples: int = MAX_EXAMPLES,
    max_terms: int = MAX_TERMS,
    min_chi2: float = MIN_CHI2,
    k: int = NEIGHBOURS,
) -> tuple[list[tuple[bytes, int]], Index] | None:
    rows = sample(docs, labels, label, learn, max_examples)
    terms = choose_terms(rows, max_terms, min_chi2)
    found = examples(rows, terms)
    if not found:
        return None
    frequency, n = document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + frequency)) + 1 if terms else np.zeros(0)
    y = np.array([r.y for r in found])
    blank = Index(np.zeros(0, np.int64), y[:0], [], idf, 0.5)
    at = [np.array(r.terms, np.int64) for r in found]
    vectors = [(t, blank.vector(t)) for t in at]
    # examples with the same leading term are neighbours, so blocks differ in their maxima
    lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    order = sorted(range(len(found)), key=lambda i: (y[i], lead[i], found[i].doc_id))
    prior = float(np.clip(y.mean(), 0.5 / len(y), 1 - 0.5 / len(y)))
    index = Index(np.array([found[i].doc_id for i in order]), y[order], [vectors[i] for i in order], idf, prior)
    index.calibrate(k)
    return terms, index


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = NEIGHBOURS,
    **settings,
) -> DataFrame:
    """doc_id, score, predicted, evidence of every document; `learn` tells labels to learn from."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(chosen, labels, label, F.lit(True) if learn is None else learn, k=k, **settings)
    if model is None:
        none = F.array().cast("array<struct<example_id:bigint,label:int,similarity:double>>")
        return chosen.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("evidence"))
    # bounded by max_examples and max_terms
    sent = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        terms, index = sent.value
        counter = Terms(terms)
        for batch in batches:
            scores, evidence = [], []
            for _, found in counter.found(batch.column(1)):
                examples, similar = index.neighbours(found, k)
                scores.append(index.score(index.vote(examples, similar)))
                evidence.append(
                    [
                        {"example_id": int(index.ids[e]), "label": int(index.labels[e]), "similarity": s}
                        for e, s in zip(examples, similar)
                    ]
                )
            score = np.array(scores, np.float64)
            yield pa.record_batch(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, EVIDENCE)],
                ["doc_id", "score", "predicted", "evidence"],
            )

    return chosen.mapInArrow(run, SCHEMA)


EVIDENCE = pa.list_(
    pa.struct([("example_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())])
)
