"""The pipeline's stages against brute force on one small planted corpus."""

import pathlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from test_near_duplicates import jaccard
from test_repeats import by_words
from test_text_operators import WORDS, prose, quality_rows
from tracewell.llm import text

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, mark int, kept string, row string, _row_mark string, _row_id int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    item = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [item(20) for _ in range(4)]
    passage = item(90)  # over 400 bytes
    rows = quality_rows(3, 200)
    texts = {i: t for i, t, _ in rows}
    clean = [i for i, _, y in rows if y]
    plan = {"copy": (300, clean[0]), "leak": (301, clean[1]), "passage": [(302, clean[2]), (303, clean[3])]}
    texts[300] = texts[clean[0]].upper()
    texts[301] = texts[clean[1]] + " " + items[2] + " " + item(30)
    for doc, base in plan["passage"]:
        texts[doc] = prose(rng, 60) + " " + passage + " " + prose(rng, 50)
    texts |= {400: None, 401: "", 402: " \n "}
    path = str(tmp_path_factory.mktemp("tables"))
    table = [(i, t, "en", None, len(t or ""), 1, "k", None, "m", 7) for i, t in texts.items()]
    table += [(None, texts[clean[4]] + " tail of its own", None, "s", None, None, None, "r", None, None)] + [table[clean[5]]] * 2
    spark.createDataFrame(table, EXTRA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, table, items, clean


def test_stages(spark, folder):
    path, table, items, clean = folder
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, run in corpus_pipeline.STAGES:
        before, docs = docs, run(spark, docs, path)
        docs = docs.persist()
        rows = docs.collect()
        seen[name] = rows
        if name != "SentencePiece encoding":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    ids = lambda name: [r.doc_id for r in seen[name]]
    first, second, third, fourth, last = (name for name, _ in corpus_pipeline.STAGES)
    assert sum(i in ids(first) for i in clean) >= len(clean) - 1
    # one document of each group of similar texts, the smallest id
    kept = sorted({(r.doc_id, r.text) for r in seen[first]}, key=lambda k: (k[0] is None, k[0] or 0))
    groups = []
    for key in kept:
        near = [g for g in groups if any(jaccard(key[1], other[1]) >= 0.8 for other in g)]
        groups = [g for g in groups if g not in near] + [[*sum(near, []), key]]
    assert sorted(ids(second), key=str) == sorted((min(g, key=lambda k: (k[0] is None, k[0] or 0))[0] for g in groups), key=str)
    # repeated passages of 50 words go, everything else stays
    texts = [r.text for r in seen[second]]
    want = dict(zip(ids(second), by_words(texts, 50)))
    for r in seen[third]:
        gone, kept = want[r.doc_id]
        assert (r.text or "").encode() == kept
        assert not gone or r.n_chars == len(r.text)
    assert sorted(ids(third), key=str) == sorted(ids(second), key=str) and any(w[0] for w in want.values())
    assert set(ids(third)) - set(ids(fourth)) == {301}
    assert sorted(set(ids(last)), key=str) == sorted(set(ids(fourth)), key=str)
    assert all(r.text_crc32 == r.decoded_crc32 for r in seen[last])


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    assert corpus_pipeline.run(spark, path).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_has_one_python_worker_a_task(spark, folder):
    path, _, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plan = corpus_pipeline.encoding(spark, docs, path)._jdf.queryExecution().executedPlan().toString()
    # encoding and decoding chained: two workers for every task, which all wait beside later stages
    assert plan.count("MapInArrow") == 1


def test_workers_give_back_what_a_task_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(text, "give_back", lambda: calls.append(1))

    @text.tidy
    def run(batches):
        yield from batches

    assert list(run(iter("abc"))) == ["a", "b", "c"] and calls == [1]
    some = run(iter("abc"))
    next(some)
    some.close()  # a consumer that stops early, as a limit does
    assert calls == [1, 1]


def test_freed_memory_goes_back():
    def held():
        rollup = pathlib.Path("/proc/self/smaps_rollup").read_text()
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup)[1]) / 1024

    small = [np.ones(10_000) for _ in range(2000)]  # 160 MB below the size that is mapped apart
    last = np.ones(10_000)  # keeps the heap's end
    del small
    before = held()
    text.give_back()
    assert held() < before - 100 and last.sum() == 10_000
