"""Token counts of a SentencePiece model by the whole-token shortcut.

The model writes a space as U+2581 and merges neighbouring symbols by rank. If no vocabulary string
has that mark after another character, and none holds a line feed, no merge can reach across the
start of a run of spaces or across a line feed: a text's count is the sum over its pre-tokens
(spaces and what follows them up to the next space or line feed). That is proven for the given
vocabulary before anything is counted; a vocabulary without the property is refused.

Offline each vocabulary string is encoded alone. The pre-tokens that come out as one token make the
table of whole tokens, which count 1 without any merging. The rest is encoded by the library, once
per distinct pre-token and task as far as a bounded cache holds.

Defined results: a missing text is empty and has no tokens; special strings inside a text are
ordinary text; every row gives one row, also with repeated or missing ids; an empty table gives an
empty result. Texts are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, int64, query, table

SPACE = "▁"
PRETOKEN = re.compile(r"\n| *[^ \n]+| +")
CACHE_WORDS = 500_000


class UnsafeVocabulary(ValueError):
    """Some vocabulary string could be merged across a pre-token's edge."""


def vocabulary(model: sentencepiece.SentencePieceProcessor) -> list[str]:
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)]


def prove_separable(model: sentencepiece.SentencePieceProcessor) -> None:
    """Refuse a vocabulary or a normaliser under which pre-tokens aren't independent."""
    crossing = [p for p in vocabulary(model) if not re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", p)]
    if crossing:
        raise UnsafeVocabulary(f"vocabulary strings cross pre-token edges: {crossing[:5]}")
    kept = model.encode(" a  b \n c", out_type=str)
    if "".join(kept).replace("<0x0A>", "\n") != f"{SPACE * 2}a{SPACE * 2}b{SPACE}\n{SPACE}c":
        raise UnsafeVocabulary("the model rewrites spaces or line feeds")


class PretokenCounter(dict):
    """Tokens of a pre-token: 1 from the table of whole tokens, else by encoding it alone."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        prove_separable(model)
        self.model = model
        self.feed = len(model.encode("\n"))
        whole = (p.replace(SPACE, " ") for p in vocabulary(model) if p.strip(SPACE))
        self.whole = {w: 1 for w in whole if self.alone(w) == 1}
        self.update(self.whole)

    def alone(self, pretoken: str) -> int:
        # The library puts one space before any text: it stands for a leading space, and a line
        # feed shields a pre-token that has none.
        if pretoken == " ":
            return 1
        if pretoken.startswith(" "):
            return len(self.model.encode(pretoken[1:]))
        return len(self.model.encode("\n" + pretoken)) - self.feed

    def __missing__(self, pretoken: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.whole)
        count = self.alone(pretoken) if pretoken != "\n" else 1
        if len(pretoken) <= 64:
            self[pretoken] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PRETOKEN.findall(" " + text.replace(SPACE, " "))))


@lru_cache(maxsize=2)
def counter_of(model_file: str) -> PretokenCounter:
    return PretokenCounter(sentencepiece.SentencePieceProcessor(model_file=model_file))


def count_tokens(
    documents: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096,
) -> DataFrame:
    """Per row: ``doc_id``, UTF-8 length ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``model_file`` is a path that executors can open, as tokenizer files are installed with the library.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_file)
        for batch in batches:
            texts = [t or "" for t in column_values(batch, "__text")]
            counts = int64([counter.count(t) for t in texts])
            sizes = int64([len(t.encode()) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=["doc_id", "n_bytes", "n_tokens"])

    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    counted = named.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
