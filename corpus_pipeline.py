"""The corpus pipeline: stages over `documents`, each written and read again by the next.

Each stage is one operator of tracewell.llm with its production parameters. Columns are those of
the documents until the last stage; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from tracewell.llm import decontaminate, quality, repeats, simhash, subwords
from tracewell.llm.text import remainder, small_batches
from tracewell.session import cut_lineage


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good stay."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learned(docs, labels, learn=remainder("doc_id", 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id.

    Similar: SimHash fingerprints of three-word shingles within 2 bits, or, as those miss most edited
    copies, five-word shingles with a similarity of 0.8 or more.
    """
    small_batches(spark)
    return simhash.one_of_similar(docs, size=5, similarity=0.8, fp_size=3, radius=2)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every passage of 50 words that occurs elsewhere; no document goes."""
    small_batches(spark)
    return repeats.without_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, long ones in chunks, with the checksum of what they decode to."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    # written before it is decoded: in one stage every task has two Python workers, which stay until the end
    encoded = cut_lineage(subwords.encode(docs, vocabulary))
    decoded = subwords.decode(encoded, vocabulary)
    crc = F.crc32("text").alias("decoded_crc32")
    return decoded.select("doc_id", "chunk", "n_chunks", "n_tokens", "ids", "text_crc32", crc)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_dedup),
    ("repeated passages", repeat_removal),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: a trained model, hashes and alignments are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
