"""Removal of repeated windows against a direct reading of its definition."""

import hashlib
import random
from collections import Counter

import pytest

from tracewell.llm.queries import op10_suffix_array_dedup
from tracewell.llm.repeats import Windows, first_digits, marked, remove_repeats, without_passages


def direct(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(5, 40)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            cut = rng.randint(0, len(piece) // 2)
            parts += [piece[cut : len(piece) - rng.randint(0, 9)], text(rng.randint(0, 10))]
        out.append("".join(parts))
    return [*out, *out[:5], None, "", "a" * 700, "ab" * 300, "é" * 90, out[7] + "x"]


@pytest.mark.parametrize("seed,alphabet,window,digit", [(1, "abcdefgh", 60, 20), (2, "aé", 40, 10), (3, "abc", 30, 30)])
def test_like_the_definition(spark, seed, alphabet, window, digit):
    texts = corpus(seed, alphabet)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    rows = remove_repeats(docs, window=window, digit=digit).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == dict(enumerate(direct(texts, window)))


def test_repeated_rows_and_ids(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(90))
    rows = [(None, text), (None, text), (3, text[:50]), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(docs, window=40, digit=10).collect())
    assert got == [(5, 0), (50, 50), (90, 90), (90, 90)]
    assert remove_repeats(docs.limit(0), window=40, digit=10).count() == 0


def by_words(texts, window):
    """Byte spans of repeated word windows, read from the definition."""
    import re

    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    raws = [(t or "").encode() for t in texts]
    grams = [[tuple(r[a:b] for a, b in f[i : i + window]) for i in range(len(f) - window + 1)] for r, f in zip(raws, found)]
    seen = Counter(g for gs in grams for g in gs)
    out = []
    for raw, f, gs in zip(raws, found, grams):
        covered = {w for i, g in enumerate(gs) if seen[g] > 1 for w in range(i, i + window)}
        gone = bytearray(len(raw))
        for w in covered:  # with the white space between two covered words
            a, b = f[w][0], f[w + 1][0] if w + 1 in covered else f[w][1]
            gone[a:b] = b"\1" * (b - a)
        kept = bytes(c for c, x in zip(raw, gone) if not x)
        out.append((sum(gone), kept))
    return out


@pytest.mark.parametrize("seed,alphabet,window,digit", [(4, "abcd", 8, 3), (5, "aé", 5, 5), (6, "ab", 12, 2)])
def test_word_windows_like_the_definition(spark, seed, alphabet, window, digit):
    texts = [*corpus(seed, alphabet), "a \t" * 40, "b\n" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = remove_repeats(docs, window=40, digit=10, words=window, word_digit=digit).collect()
    got = {r.doc_id: (r.word_bytes_removed, r.word_kept_sha256) for r in rows}
    want = {k: (n, hashlib.sha256(kept).hexdigest()) for k, (n, kept) in enumerate(by_words(texts, window))}
    assert got == want
    both = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert both == dict(enumerate(direct(texts, 40)))


def test_passages_leave_other_columns_alone(spark):
    texts = [*corpus(7, "abcdef"), None]
    rows = [(k, t, "a", 1, 2, None if t is None else len(t)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, kept string, mark int, _kept int, n_chars int"
    docs = spark.createDataFrame(rows, schema)
    found = without_passages(docs, words=9)
    assert found.schema == docs.schema or found.dtypes == docs.dtypes
    want = [kept.decode() for _, kept in by_words(texts, 9)]
    for r in found.collect():
        if texts[r.doc_id] is None:
            assert r.text is None and r.n_chars is None
        else:
            assert (r.text, r.n_chars) == (want[r.doc_id], len(want[r.doc_id]))
        assert (r.kept, r.mark, r["_kept"]) == ("a", 1, 2)
    assert without_passages(docs.limit(0)).count() == 0


def test_a_text_with_a_period_is_few_rows(spark):
    texts = ["in on " * 200, "x " + "in on " * 150, "in on " * 26 + "end", "a" * 3000, "ab" * 1500 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [Windows("bytes", 400, 100), Windows("words", 50, 10)]
    # 4,426 rows when each period was one
    assert first_digits(marked(docs, "doc_id", "text"), kinds).count() <= 20
    rows = remove_repeats(docs, words=50).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(direct(texts, 400)))
    want = {k: (n, hashlib.sha256(kept).hexdigest()) for k, (n, kept) in enumerate(by_words(texts, 50))}
    assert {r.doc_id: (r.word_bytes_removed, r.word_kept_sha256) for r in rows} == want


def test_query_catches_short_passages(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n, size: " ".join("".join(rng.choices("abcdefghijklm", k=size)) for _ in range(n))
    short, long = text(60, 4), text(60, 8)  # 299 and 539 bytes
    texts = [f"{text(40, 5)} {p} {text(30, 5)}" for p in (short, short, long, long)] + [text(130, 5), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    # the contract's columns leave what is below 400 bytes, those of words do not
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in rows.items()} == dict(enumerate(direct(texts, 400)))
    want = [(n, hashlib.sha256(kept).hexdigest()) for n, kept in by_words(texts, 50)]
    assert {k: (r.word_bytes_removed, r.word_kept_sha256) for k, r in rows.items()} == dict(enumerate(want))
    assert [rows[k].n_removed > 0 for k in range(6)] == [False, False, True, True, False, False]
    assert [rows[k].word_bytes_removed > 0 for k in range(6)] == [True] * 4 + [False] * 2
