"""Token files: blocks round trip, ids are the library's, starts follow id order."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import tokenfile
from tracewell.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's 'said' they'll a1b22c don't,stop", None, "", " \n\t ", "naïve café — “quoted” ５ Å Å x́",
    "<|endoftext|> in the middle", "line\r\nbreak\x1codd space", "x" * 5000, "'''ll's'S", "日本語 text 12'3", "İstanbul ΣΑΣ ς",
    "a b.c,d--e_f(g)[h]{i}|j~k", "123456 7,8.9 1st 2nd", "tab\tsep\tvalues", "dup", "dup",
]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.floats(0.5, 1.0))
def test_blocks_round_trip(values, percentile):
    raw = tokenfile.encode_block(np.array(values, np.uint64), percentile)
    assert tokenfile.decode_block(raw).tolist() == values


def test_outliers_go_to_the_exception_list():
    values = np.array([1000 + i % 16 for i in range(4000)] + [2**40] * 10, np.uint64)
    assert len(tokenfile.encode_block(values)) < 4010 * 4 / 8 + 12 * 10 + 40


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shuffle", [1, 5])
def test_files_hold_the_librarys_ids(spark, shuffle):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i - 3, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(shuffle)
    got = tokenfile.token_files(docs, VOCABULARY, 2).collect()
    assert sorted(map(tuple, got)) == expected([(i - 3, t) for i, t in rows])


def test_blocks_are_read_alone_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more " * 40) for i in range(300)], "doc_id long, text string")
    table = tokenfile.write_token_files(docs, VOCABULARY, scratch_path(spark, "t"), 2)
    path = table.first().path
    file = tokenfile.TokenFile(path)
    whole = np.concatenate(list(file.blocks("ids")))
    assert file.read("ids", 5000, 200).tolist() == whole[5000:5200].tolist()
    assert tokenfile.token_files(docs.limit(0), VOCABULARY, 2).count() == 0


def test_whole_texts_of_the_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, tokenfile.token_files(docs, VOCABULARY, 2).collect())) == expected(rows)
