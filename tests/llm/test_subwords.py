"""Max-plus segmentation: chunks give the path of the whole text, decoding gives the text."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tracewell.llm import subwords

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    syllables = ["the", "er", "ing", "é", "ß", "▁", " ", "  ", "\n", "characteristics", "日本", "x", "=", "\t", "🙂", "----"]
    made = ["".join(rng.choice(syllables) for _ in range(n)) for n in (1, 40, 200, 900, 2500)]
    return [
        *made, None, "", " ", "   ", "▁", "recommendations" * 90, "=" * 700, " " * 500, "\n" * 300, "a\x00b",
        "no blanks" + "zqxjk" * 300, *made[:2],
    ]


def total(words, ids):
    weight = {i: words.weight[text] for text, i in words.ids.items()}
    spelled = b"".join(words.bytes_of[i] for i in ids if i not in weight)
    return sum(weight.get(i, 0) for i in ids) + words.unknown * len(spelled.decode())


@pytest.mark.parametrize("chunk", [20, 64, 100_000])
def test_chunks_give_the_path_of_the_whole(spark, chunk):
    words = subwords.Vocabulary(MODEL)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, chunk int, part string")
    encoded = subwords.encode(docs, MODEL, chunk=chunk)
    got, back = defaultdict(list), defaultdict(str)
    for r in sorted(subwords.decode(encoded, MODEL).collect(), key=lambda r: (r.doc_id, r.chunk)):
        got[r.doc_id] += r.ids
        back[r.doc_id] += r.text
        assert len(r.ids) == r.n_tokens
    for i, text in rows:
        assert back[i] == (text or "")
        # equal pieces in another order score the same: the sums decide
        assert total(words, got[i]) == (words.forward(" " + text, 0)[-1] if text else 0)
        if text and (len(text) + 1 < 2 * chunk or "rec" in text):
            assert got[i] == words.encode_word(" " + text)


def test_many_levels(spark):
    subwords_text = "zqxjk" * 20_000  # no place to cut, 5,000 chunks: two levels of blocks
    docs = spark.createDataFrame([(1, subwords_text)], "doc_id long, text string")
    encoded = subwords.encode(docs, MODEL, chunk=20)
    rows = sorted(encoded.collect(), key=lambda r: r.chunk)
    words = subwords.Vocabulary(MODEL)
    assert total(words, [i for r in rows for i in r.ids]) == words.forward(" " + subwords_text, 0)[-1]


def test_scores_are_the_librarys():
    """The library's own Viterbi search over the same pieces finds no better segmentation."""
    proto = pb.ModelProto.FromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = subwords.Vocabulary(MODEL)
    for text in ["the characteristics", "unhappily ever after", "Éclair de thé", "rerererering", "internationalisation"]:
        score = lambda ids: sum(library.get_score(i) for i in ids)
        assert score(words.encode_word(" " + text)) >= score(library.encode(text))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert subwords.decode(subwords.encode(docs, MODEL), MODEL).count() == 0
