"""Lexical index of hashed term counts: exact top-k by cosine over inverted lists with score bounds.

A text is kept as counts per slot, a hash of the word; weights (term frequency x inverse document
frequency, unit length) are made when a question is asked, from document frequencies that add
up over parts of the index. So a text that comes or goes changes its own counts and one number a slot.

A text is one row, ``key, slots, tfs``, made where the text is. The index is dealt to shards of texts and
every question visits every shard: a task holds one shard as inverted lists, adds up the lists of a
question's slots and keeps its k best texts. So no pair of a question and a text is written or shuffled
but those k of each shard. Nothing is approximate. :func:`reading_order` and :func:`lists_to_read` tell
which lists could be left out under the bound of the first ones.

Products are summed as whole numbers (units of 1e-12), so a score does not depend on the order of
addition, and equal texts have equal scores. Ties, at nine decimals, go to the smaller key.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.functions.text import words
from perilake.operators.documents import EMBEDDING_SIZE
from perilake.session import durable

# Functions that run inside tasks travel with the task, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

SLACK = 1e-6  # bounds are kept above what rounding can add
SHARD_TEXTS = 16_384  # texts one task holds


def slot_of(word: Column, size: int = EMBEDDING_SIZE) -> Column:
    """Slot of a word: the first 32 bits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(word, 256), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def term_counts(texts: DataFrame, key: str, text: str = "chunk_text", size: int = EMBEDDING_SIZE) -> DataFrame:
    """``key, slot, tf`` of each text; rows without a key or without words give none. A key counts as one text."""
    each = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(words(F.lower(text))).alias("word"))
    return each.groupBy("key", slot_of(F.col("word"), size).alias("slot")).agg(F.count(F.lit(1)).alias("tf"))


class Slots(dict):
    """:func:`slot_of` of words, remembered up to a bound."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = int(hashlib.sha256(word.encode()).hexdigest()[:8], 16) % self.size
        return value


def term_vectors(texts: DataFrame, key: str, text: str = "chunk_text", size: int = EMBEDDING_SIZE) -> DataFrame:
    """``key, slots, tfs``, the rows of :func:`term_counts` in one row a key, written down once.

    Counted where the texts are. Only texts that share a key are brought together: their counts add up.
    """
    each = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_join(words(F.lower(text)), " ").alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Slots(size)
        for batch in batches:
            kept, slots, tfs = [], [], []
            for n, value in enumerate(batch.column("words").to_pylist()):
                if value:
                    found = [known[w] for w in value.split(" ")]
                    counted = np.bincount(np.array(found))
                    slots.append(np.flatnonzero(counted))
                    tfs.append(counted[slots[-1]])
                    kept.append(n)
            cuts = pa.array(np.cumsum([0, *(len(s) for s in slots)]).astype(np.int32))
            flat = lambda parts: pa.array(np.concatenate([np.empty(0, dtype=np.int32), *parts]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(cuts, flat(slots)), pa.ListArray.from_arrays(cuts, flat(tfs))],
                names=["key", "slots", "tfs"])

    one = durable(each.mapInArrow(count, f"key {each.schema['key'].dataType.simpleString()}, slots array<int>, tfs array<int>"))
    again = durable(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    if not again.head(1):
        return one
    added = one.join(again, "key", "left_semi").select("key", F.inline(F.arrays_zip("slots", "tfs"))).groupBy("key", "slots").agg(F.sum("tfs").cast("int").alias("tf"))
    merged = added.groupBy("key").agg(F.collect_list("slots").alias("slots"), F.collect_list("tf").alias("tfs"))
    return durable(one.join(again, "key", "left_anti").unionByName(merged))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``slot, df``: texts a slot is in. Frequencies of disjoint parts may be added."""
    return counts.groupBy("slot").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequencies(frequencies: DataFrame, texts: int) -> list[tuple[int, float]]:
    """(slot, inverse document frequency), one a slot whatever the number of texts."""
    found = frequencies.select("slot", F.log((F.lit(float(texts)) + 1) / (F.col("df") + 1)).alias("idf")).collect()
    return [(r.slot, r.idf) for r in found]


def weighted(counts: DataFrame, frequencies: DataFrame, texts: int, by: str = "key") -> DataFrame:
    """``by, slot, w``: unit vectors without their zeros; a text all of whose words are everywhere has none."""
    idf = F.log((F.lit(float(texts)) + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1))
    raw = counts.join(F.broadcast(frequencies), "slot", "left").select(by, "slot", (F.col("tf") * idf).alias("v"))  # one row a slot
    squares = F.sum(F.round(F.col("v") * F.col("v") * 1e6).cast("long")).over(Window.partitionBy(by))
    return raw.withColumn("w", F.col("v") / F.sqrt(F.nullif(squares, F.lit(0)) / 1e6)).filter("w > 0").select(by, "slot", "w")


def _added(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.round(F.col("qw") * F.col("w") * 1e12).cast("long")).alias("units"))


def reading_order(questions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Lists of each question, most promising first: ``reach`` is what one can add, ``onward`` what it and all later ones can.

    ``lead`` marks the first lists, half of the reach. A question has at most one list a slot.
    """
    reached = questions.join(F.broadcast(bounds), "slot").withColumn("reach", F.col("qw") * F.col("most"))
    order = Window.partitionBy("query_id").orderBy(F.col("reach").desc(), "slot")
    onward = F.sum("reach").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("reach").over(Window.partitionBy("query_id"))
    return reached.withColumns({"onward": onward, "lead": onward > total / 2})


def lists_to_read(ordered: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, read for new candidates; lists left for completion; the bound of each question)."""
    first = _added(ordered.filter("lead").select("query_id", "slot", "qw").join(postings, "slot"), "query_id", "key")
    place = Window.partitionBy("query_id").orderBy(F.col("units").desc())
    bound = first.withColumn("n", F.row_number().over(place)).filter(F.col("n") == k).select("query_id", (F.col("units") / 1e12 - SLACK).alias("bound"))
    judged = ordered.join(F.broadcast(bound), "query_id", "left").withColumn("needed", F.col("onward") >= F.coalesce("bound", F.lit(0.0)))
    return judged.filter("lead OR needed"), judged.filter("NOT lead AND NOT needed"), bound


def nearest_lexical(postings: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``query_id, key, score, rank`` of the k best texts of each question, by :func:`weighted` rows of both."""
    vectors = postings.groupBy("key").agg(F.collect_list("slot").alias("slots"), F.collect_list("w").alias("ws"))
    return _nearest(durable(vectors.withColumn("tfs", F.lit(None).cast("array<int>"))), questions, k, None)


def nearest_texts(vectors: DataFrame, frequencies: DataFrame, texts: int, questions: DataFrame, k: int) -> DataFrame:
    """:func:`nearest_lexical` for texts by ``key, slots, tfs``; they get the weights of :func:`weighted` where they are compared.

    ``vectors`` is counted and then dealt, so it should be a table.
    """
    return _nearest(vectors.withColumn("ws", F.lit(None).cast("array<double>")), questions, k, inverse_frequencies(frequencies, texts))


def _half_up(values: np.ndarray) -> np.ndarray:
    """Nearest whole numbers of values that are not negative, halves upwards, as SQL rounds."""
    low = np.floor(values)
    return low + (values - low >= 0.5)


class Lists:
    """Inverted lists of the texts of a shard, their numbers in the order of the keys."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], idf: np.ndarray | None):
        sizes = np.array([len(s) for s in slots])
        texts, slot, value = np.repeat(np.arange(len(slots)), sizes), np.concatenate(slots), np.concatenate(values).astype(np.float64)
        if idf is not None:
            value = value * idf[slot]
            squares = np.bincount(texts, weights=_half_up(value * value * 1e6), minlength=len(slots))  # whole numbers, added exactly
            with np.errstate(invalid="ignore", divide="ignore"):
                value = value / np.sqrt(squares / 1e6)[texts]
            value[squares[texts] == 0] = 0.0
        kept = np.flatnonzero(value > 0)
        order = kept[np.argsort(slot[kept], kind="stable")]
        self.texts, self.value, slot = texts[order], value[order], slot[order]
        self.n = len(slots)
        self.cuts = np.searchsorted(slot, np.arange((int(slot[-1]) if len(slot) else -1) + 2))

    def best(self, slots: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, units) of the k best texts that share a slot, ties at nine decimals to the smaller number."""
        inside = [(s, w) for s, w in zip(slots.tolist(), weights.tolist(), strict=True) if s + 1 < len(self.cuts) and self.cuts[s + 1] > self.cuts[s]]
        if not inside:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        places = [slice(self.cuts[s], self.cuts[s + 1]) for s, _ in inside]
        texts = np.concatenate([self.texts[p] for p in places])
        units = np.bincount(texts, weights=np.concatenate([_half_up(w * self.value[p] * 1e12) for p, (_, w) in zip(places, inside, strict=True)]), minlength=self.n)
        shared = np.zeros(self.n, dtype=bool)
        shared[texts] = True
        found = np.flatnonzero(shared)
        score = (units[found].astype(np.int64) + 500) // 1000
        if len(found) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= least], score[score >= least]
        found = found[np.lexsort((found, -score))][:k]
        return found, units[found].astype(np.int64)


def _nearest(vectors: DataFrame, questions: DataFrame, k: int, inverse: list[tuple[int, float]] | None) -> DataFrame:
    """Deals texts to shards, shows every question to every shard on the executors, keeps the k best of all shards."""
    shards = max(1, -(-vectors.count() // SHARD_TEXTS))
    key_kind, query_kind = vectors.schema["key"].dataType.simpleString(), questions.schema["query_id"].dataType.simpleString()
    asked = questions.groupBy("query_id").agg(F.collect_list("slot").alias("slots"), F.collect_list("w").alias("ws"))
    idf = None
    if inverse is not None:
        idf = np.zeros(max([s for s, _ in inverse], default=0) + 1)
        for s, value in inverse:
            idf[s] = value

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists, names, slots, values = None, None, [], [], []
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            kind = {c: column(c).type for c in ("query_id", "key")}
            out: tuple[list, list, list] = ([], [], [])
            read = {c: (column(c).offsets.to_numpy(), column(c).values.to_numpy(zero_copy_only=False)) for c in ("slots", "tfs", "ws")}
            cut = lambda c, n: read[c][1][read[c][0][n] : read[c][0][n + 1]]  # noqa: B023, E731
            for n, (at, asks, name, question) in enumerate(zip(*(column(c).to_pylist() for c in ("shard", "asks", "key", "query_id")), strict=True)):
                if at != shard:
                    shard, lists, names, slots, values = at, None, [], [], []
                if not asks:
                    names.append(name)
                    slots.append(cut("slots", n).copy())
                    values.append(cut("ws" if idf is None else "tfs", n).copy())
                    continue
                if lists is None and names:
                    lists, slots, values = Lists(slots, values, idf), [], []
                if lists is not None:
                    found, units = lists.best(cut("slots", n), cut("ws", n), k)
                    out[0].extend([question] * len(found))
                    out[1].extend(names[i] for i in found)
                    out[2].extend(units.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind["query_id"]), pa.array(out[1], kind["key"]), pa.array(out[2], pa.int64())], names=["query_id", "key", "units"])

    index = vectors.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "key", F.lit(None).cast(query_kind).alias("query_id"), "slots", "tfs", "ws")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.lit(None).cast(key_kind).alias("key"), "query_id",
                         "slots", F.lit(None).cast("array<int>").alias("tfs"), "ws")
    dealt = index.unionByName(every).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "key")
    found = dealt.mapInArrow(answer, f"query_id {query_kind}, key {key_kind}, units long")
    scored = found.select("query_id", "key", F.round(F.col("units") / 1e12, 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
