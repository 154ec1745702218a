"""Quality, toxicity, decontamination, licenses and host rules on small planted tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontaminate, hostrules, licenses, quality, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("", "n", "ra", "vel", "ti", "pos")]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + (".\n" if k % 12 == 11 else " "))
    return "".join(out).strip()


def edges():
    return [None, "", " \n\n ", "\n", "word", "word\nword\n", "x" * 50_000, "a " * 20_000, "é \x85 ¿"]


# quality -------------------------------------------------------------------------------------


def quality_rows(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(30, 150))
        bad = rng.random() < 0.4
        if bad:
            junk = rng.choice(["BUY!! NOW!! BEST!! DEAL!!", "go go go go go go go", "a$$$ b%%% c&&& d###"])
            text = text[: rng.randint(0, 200)] + ("\n" + junk) * rng.randint(4, 30)
        rows.append((i, text, 1 - bad))
    return rows


def test_quality_on_held_out_documents(spark):
    rows = quality_rows(1)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = quality.learned(docs, labels, learn=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    wrong = [i for i, _, y in rows if i % 3 == 1 and got[i].predicted != y]
    assert len(got) == len(rows) and len(wrong) <= 2
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i in got if got[i].predicted == 1}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(edges())], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learned(docs, none)
    assert {r.score for r in quality.score_quality(docs, model).collect()} == {0.5}
    rows = quality_rows(2, 60)
    model = quality.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(edges()) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_marginals_are_those_of_all_label_sequences():
    rng = np.random.default_rng(4)
    model = quality.Field(weights=rng.normal(0, 1, quality.INPUTS), change=rng.normal(0, 1, (2, 2)))
    lines = quality.joined(pa.array(["one two\nTHREE!!\nfour\nfive | six", "alone", "", "x\ny\nz"]))
    got, _ = model.marginals(lines)
    score = model.potentials(lines)
    at = 0
    for n in np.bincount(lines.row, minlength=lines.rows):
        total, bad = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            s = sum(score[at + k] for k in range(n) if y[k]) + sum(model.change[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            bad += np.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], bad / total if n else [])
        at += n


# toxicity ------------------------------------------------------------------------------------


def toxic_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 80)).split(" ")
        bad = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["Grobnak", "vilefum,", "grobnaks"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    rows = toxic_rows(1)
    extra = [(10_000 + i, t, None) for i, t in enumerate(edges())]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows + extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, learn=F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == len(rows) + len(extra)
    assert sum(got[i].predicted != y for i, _, y in rows if i % 5 == 0) <= 1
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[10_000].evidence
    some = next(got[i] for i, _, y in rows if y and i % 5 == 0)
    assert some.evidence[0].label == 1 and some.evidence[0].similarity > 0.5
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_block_maxima_lose_no_neighbour():
    rng = np.random.default_rng(2)
    terms = 40
    vectors = []
    for _ in range(300):
        at = np.sort(rng.choice(terms, rng.integers(0, 8), replace=False))
        w = rng.random(len(at)) + 0.1
        vectors.append((at, w / np.sqrt((w**2).sum()) if len(w) else w))
    ids = rng.permutation(300)
    index = toxicity.Index(ids, rng.integers(0, 2, 300), vectors, np.ones(terms), 0.3)
    dense = np.zeros((300, terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(0, 300, 7):
        at, w = vectors[i]
        found, similar = index.nearest(at, w, 10)
        exact = dense[:, at] @ w if len(at) else np.zeros(300)
        best = sorted(((round(s, 9), -ids[k]) for k, s in enumerate(exact) if s > 0), reverse=True)[:10]
        assert [(round(s, 9), -ids[k]) for k, s in zip(found, similar)] == best


# decontamination -----------------------------------------------------------------------------


def smith_waterman(a, b):
    best = 0.0
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = 1.0 if a[i - 1] == b[j - 1] else -0.5
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
            best = max(best, h[i, j])
    return best


def test_alignment_scores():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        score, first, end = decontaminate.align(a, b)
        assert score == smith_waterman(a, b)
        assert not score or smith_waterman(a, b[first:end]) == score


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_exact_and_edited_leaks_are_found(spark, block_bytes):
    rng = random.Random(8)
    item = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    items = [item(rng.choice([15, 40, 300])) for _ in range(12)]
    docs, planted = [], set()
    for d in range(80):
        words = item(60)
        if d % 4 == 0:
            k = d // 4 % 12
            copy = list(items[k])
            for _ in range(len(copy) // 10 if d % 8 == 0 else 0):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], ["two", "more"]])
            words[30:30] = copy
            planted.add((d, k))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper() if d % 16 == 0 else " ".join(words), "c"))
    docs += [(900 + i, t, "c") for i, t in enumerate(edges())] + [(None, " ".join(items[0]), "c")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id long, text string"
    )
    got = decontaminate.contamination(table, benchmark, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(None, 0)}
    kept = decontaminate.without_leaks(table, benchmark, block_bytes=block_bytes).collect()
    assert {r.doc_id for r in kept} == {d for d, _, _ in docs} - {d for d, _ in planted} - {None}
    assert decontaminate.contamination(table, benchmark.limit(0)).count() == 0
    assert decontaminate.contamination(table.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("exact_copy", [False, True])
def test_leaks_edited_every_five_words_are_those_of_alignment(spark, exact_copy):
    rng = random.Random(12)
    item = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    items = [item(15 + k) for k in range(26)]
    docs = [items[k] if exact_copy else item(20) for k in range(26)]
    for k, words in enumerate(items):
        for kind in ("replace", "delete", "insert", "mixed"):
            copy = list(words)
            for at in reversed(range(4, len(copy), 5)):
                how = rng.choice(["replace", "delete", "insert"]) if kind == "mixed" else kind
                copy[at : at + (how != "insert")] = [] if how == "delete" else [f"new{k}"]
            docs.append(item(30) + copy + item(30))
    # a leak may be stretched by nearly as many gaps as it has words
    docs.append(item(5) + [w for i, v in enumerate(items[25]) for w in ([v] if i % 4 else [*item(3), v])] + item(5))
    got = decontaminate.contamination(
        spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
    ).collect()
    number = {w: i for i, w in enumerate(sorted({w for words in items + docs for w in words}))}
    coded = lambda words: np.array([number[w] for w in words])
    exact = {
        (d, k): score / len(words)
        for d, text in enumerate(docs) for k, words in enumerate(items)
        if (score := decontaminate.smith_waterman(coded(words), coded(text))[0]) >= 0.5 * len(words)
    }
    assert len(exact) >= 26 * 4
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(exact)


def test_a_common_item_is_found_everywhere(spark):
    rng = random.Random(5)
    item = [rng.choice(WORDS) + str(k) for k in range(20)]
    docs = spark.createDataFrame([(d, " ".join(item) + f" tail {d}") for d in range(200)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.contamination(docs, benchmark).count() == 200


# licenses ------------------------------------------------------------------------------------


def test_license_places_and_fuzzy_notices(spark):
    texts = [
        "Released under the MIT License. mit-license; MIT\n\tLicense!", "mit licensed, permit license, mit éicense", "CC BY 4.0 cc, by ccby CC-BY-SA",
        "GNU General Public License and the Apache License, Version 2.0", "gnu genral public licence text", "Apache Licence Version 2.0 applies",
        "Permission is hereby granted, free of charge, to any person obtaining a coppy", *edges(), "cc by",
    ]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places = [
            (k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.score == 1.0 if places else 0 <= r.score < 1
    assert got[4].labels == "gpl" and 0 < got[4].score < 1 and got[4].spans[0].edits == 2
    assert got[5].labels == "apache" and got[6].labels == "mit"
    assert (got[6].spans[0].first_word, got[6].spans[0].last_word) == (0, 12)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_notice_of_a_row_of_notices_has_its_span(spark):
    rng = random.Random(4)
    notice = "mozilla public license"
    texts, planted = ["mozila public license x y mozilla public license "], [[(0, 2, 1), (5, 7, 0)]]
    for _ in range(40):
        words, spans = [], []
        for _ in range(rng.randint(1, 12)):
            words += ["zz"] * rng.randint(0, 3)
            copy, edits = list(notice), rng.randint(0, 2)
            for at in rng.sample([i for i, c in enumerate(notice) if c != " "], edits):
                copy[at] = "q"
            spans.append((len(words), len(words) + 2, edits))
            words += "".join(copy).split()
        texts.append(" ".join(words))
        planted.append(spans)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in licenses.scan(docs).collect()}
    for i, spans in enumerate(planted):
        mine = [(s.first_word, s.last_word, s.edits) for s in got[i] if s.notice == notice]
        assert mine == spans


# host rules ----------------------------------------------------------------------------------


def test_a_bad_host_takes_its_documents_along(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 120), f"host{i % 9}") for i in range(900)]
    rows += [(2000 + i, prose(rng, 60) + " $$$$ %%%%" * 30, "spam") for i in range(150)]
    rows += [(3000 + i, prose(rng, 120), "spam") for i in range(10)] + [(4000, prose(rng, 120), None)]
    rows += [(5000 + i, t, None) for i, t in enumerate(edges())]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in hostrules.host_rules(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(900)) and not got[4000].kept
    assert not any(got[3000 + i].kept or got[3000 + i].base_failed for i in range(10))
    assert all(got[5000 + i].base_failed for i in range(len(edges())))
    assert hostrules.host_rules(docs.limit(0)).count() == 0


def test_repeated_windows_are_counted_as_words(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in hostrules.host_rules(docs).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})
