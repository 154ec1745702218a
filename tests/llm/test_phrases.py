"""Collocations against a direct reading of their definition."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import phrases
from tracewell.llm.phrases import collocations

COLUMNS = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def direct(rows, least, per_lang):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for size in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranks = []
        for p, a in chosen.items():
            longer = [b for q, b in chosen.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranks.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for k, (score, a, phrase, left, right) in enumerate(sorted(ranks)[:per_lang], 1):
            out.append((lang, k, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    vocabulary = ["Ab", "ab", "cd", "é", "ef g", "x\x00y", "zz", "q", "w1", "w2", "w3", "w4"]
    rows = []
    for k in range(90):
        ws = rng.choices(vocabulary, weights=range(1, 13), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", "\n", " "]) for w in ws)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return [*rows, *rows[:20], ("en", None), (None, ""), ("fr", " .,; "), ("en", "New York City. " * 40)]


# small tables of ids send the rest through the rows of hashes
@pytest.mark.parametrize("ids,pair_ids,chunk", [(1 << 20, 1 << 22, 1 << 21), (5, 1 << 22, 64), (1 << 20, 3, 64), (0, 0, 64), (9, 9, 64)])
def test_like_the_definition(spark, ids, pair_ids, chunk):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "unit long, lang string, text string, word string")
    found = collocations(docs.repartition(3), least=6, per_lang=25, ids=ids, pair_ids=pair_ids, chunk=chunk)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == direct(rows, 6, 25)


def test_sparse_tiles_reach_beyond_the_dense_one(spark):
    # 1,500 words of falling frequency: ids on both sides of the dense tile's border
    rows = [("en", f"w{k} w{k} v{k % 7}") for k in range(1500) for _ in range(2 + (k % 3))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations(docs.repartition(2), least=2, per_lang=5000)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == direct(rows, 2, 5000)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_a_batch_of_tile_rows_is_small():
    # a batch has up to 1,000 rows (small_batches); both ends hold it whole
    codes = np.arange(100_000)
    rows = list(phrases._blocks(0, 0, codes, codes))
    assert max(len(c) + len(n) for _, _, c, n in rows) * 1000 <= 16 << 20
    assert b"".join(c for _, _, c, _ in rows) == codes.tobytes()


def test_a_full_stripe_is_merged_in_little_memory():
    rng = np.random.default_rng(5)
    merged, total = phrases.Merged(), Counter()
    for _ in range(20):
        codes, counts = rng.integers(0, 300, 50), rng.integers(1, 9, 50)
        merged.add(codes, counts)
        for c, n in zip(codes.tolist(), counts.tolist()):
            total[c] += n
    assert dict(zip(merged.codes.tolist(), merged.counts.tolist())) == total
    assert (np.diff(merged.codes) > 0).all()

    full = phrases.Merged()
    full.codes, full.counts = 2 * np.arange(phrases.STRIPE), np.ones(phrases.STRIPE, np.int64)
    codes = rng.integers(0, 2 * phrases.STRIPE, phrases.STRIPE // 8)
    tracemalloc.start()
    full.add(codes, np.ones(len(codes), np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
