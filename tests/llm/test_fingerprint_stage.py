"""The near-duplicate stage links by fingerprints, and by the exact join behind them."""

import corpus_pipeline
from tracewell.llm import simhash

SCHEMA = "doc_id long, text string"


def kept(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())


def test_links_of_fingerprints_and_of_the_exact_join(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [
        # one fingerprint, few shingles in common
        (5, " ".join(["red", "green", "blue"] * 300 + words[:40])),
        (3, " ".join(["red", "green", "blue"] * 300 + words[40:80])),
        # similar by the exact join, fingerprints far apart
        (7, " ".join(words[100:200])),
        (8, " ".join(words[100:195])),
        (9, " ".join(words[200:300])),
    ]
    fps = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bin(fps[5] ^ fps[3]).count("1") <= 2 < bin(fps[7] ^ fps[8]).count("1")
    assert kept(spark, rows) == [3, 7, 9]


def test_a_link_of_one_kind_joins_groups_of_the_other(spark):
    base = ["red", "green", "blue"] * 300
    a, b = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(1, " ".join(base + a)), (2, " ".join(base + a[:-1])), (3, " ".join(base + b)), (4, " ".join(base + b[:-1]))]
    assert kept(spark, rows) == [1]
