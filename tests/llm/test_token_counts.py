import public_tokenizers
import pytest
import sentencepiece

from conftest import SMALL
from perilake.llm.token_counts import PretokenCounter, UnsafeVocabulary, count_tokens, prove_separable

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "\n\n", " \n", "\n ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\ta\t b", "a▁b", "▁", "x▁ y", " ▁▁z",
    "<s>hello</s>", "<unk>", "<0x0A>", "½ ﬁ é", "　x", "﻿x", "x\x00y", "\r\nx\r\n", "日本語 text", "🙂🙂 🙂", "a" * 5000, " " * 300 + "end",
    "https://x.y/z?q=1&r=2", "naïve Straße", "\n\n\n   \n",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_same_as_library(spark, model):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*texts, None, None])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(frame, MODEL).collect()}
    assert len(got) == len(texts) + 2
    for i, text in enumerate([*texts, "", ""]):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(model.encode(text)), len(text.encode())), text[:50]
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_whole_tokens_are_proven(model):
    counter = PretokenCounter(model)
    assert len(counter.whole) > 20_000
    for word in list(counter.whole)[:2000]:
        assert counter.alone(word) == 1


def test_crossing_vocabulary_is_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

        is_control = is_unknown = is_byte = lambda self, i: False

    with pytest.raises(UnsafeVocabulary):
        prove_separable(Crossing())


def test_repeated_missing_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, count_tokens(frame, MODEL).collect()), key=str) == [(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False)]
    assert count_tokens(frame.limit(0), MODEL).collect() == []
