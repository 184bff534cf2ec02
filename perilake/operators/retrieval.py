"""Nearest chunks and cited answers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.functions.text import is_object_uri, present

# Functions that run inside tasks travel with the task, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

# Fixed value: results per question.
TOP_K = 4
# Index rows one task holds, and questions compared with them at a time.
SHARD_ROWS = 16_384
QUERY_BLOCK = 256


def _best_of_shard(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, index row, score) of the k best rows per question, ties to the earlier row."""
    with np.errstate(invalid="ignore", divide="ignore"):
        scores = (queries @ rows.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1))
    scores = np.where(np.isfinite(scores), scores, -np.inf)
    last = min(k, scores.shape[1]) - 1
    least = -np.partition(-scores, last, axis=1)[:, last]
    asked, found = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))  # more than k where scores tie
    order = np.lexsort((found, -scores[asked, found], asked))
    asked, found = asked[order], found[order]
    place = np.arange(len(asked)) - np.searchsorted(asked, asked, "left")
    return asked[place < k], found[place < k], scores[asked, found][place < k]


def _search_shards(k: int):
    """Streams (shard, index rows by key before questions) and answers the questions block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kind, ids, rows, names, asked = None, None, [], [], [], []

        def answer() -> pa.RecordBatch | None:
            out = None
            if ids and names:
                q, i, score = _best_of_shard(np.stack(asked), np.stack(rows), k)
                out = pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in q], pa.string()), pa.array([ids[x] for x in i], kind), pa.array(score)],
                    names=["query_id", "id", "score"])
            names.clear()
            asked.clear()
            return out

        for batch in batches:
            vectors = batch.column("embedding")
            flat, cuts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            kind = batch.schema.field("id").type
            keys = (batch.column(c).to_pylist() for c in ("shard", "asks", "id", "query_id"))
            for n, (at, asks, name, question) in enumerate(zip(*keys, strict=True)):
                if at != shard:
                    if (out := answer()) is not None:
                        yield out
                    shard, ids, rows = at, [], []
                vector = flat[cuts[n] : cuts[n + 1]].astype(np.float64)
                if not asks:
                    ids.append(name)
                    rows.append(vector)
                else:
                    names.append(question)
                    asked.append(vector)
                    if len(names) == QUERY_BLOCK and (out := answer()) is not None:
                        yield out
        if (out := answer()) is not None:
            yield out

    return run


def nearest_chunks(
    index: DataFrame, queries: DataFrame, *, key: str, embedding: str = "embedding", query_key: str = "query_id",
    k: int = TOP_K, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Top-k cosine matches per question: (query_id, key, score, rank), exact.

    The index is dealt to shards of about ``shard_rows`` rows by a hash of the key, one task a shard.
    Every question visits every shard, on the executors: a task holds one shard and one block of
    questions, gives the best k rows per question, and the k best of all shards are kept. No question
    passes through the driver and no pair is materialised. Keys keep their type; index rows and
    questions without a key or a vector take no part. Ties go to the key that sorts first.
    """
    kind = index.schema[key].dataType.simpleString()
    known = lambda frame, name: frame.filter(F.col(name).isNotNull() & F.col(embedding).isNotNull())
    vector = F.col(embedding).cast("array<double>").alias("embedding")
    side = known(index, key).select(F.col(key).alias("id"), vector)
    shards = max(1, -(-side.count() // shard_rows))
    stored = side.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "id", F.lit(None).cast("string").alias("query_id"), "embedding")
    asked = known(queries, query_key).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(True).alias("asks"),
        F.lit(None).cast(kind).alias("id"), F.col(query_key).cast("string").alias("query_id"), vector)
    placed = stored.unionByName(asked).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("asks", "id")
    partial = placed.mapInArrow(_search_shards(k), f"query_id string, id {kind}, score double")
    return top_k_per_query(partial, "query_id", "score", "id", k).withColumnRenamed("id", key)


def top_k_per_query(scored: DataFrame, query: str, score: str, tie: str, k: int = TOP_K) -> DataFrame:
    """Best k rows per query; Spark keeps k per query and map task before the shuffle."""
    window = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def retrieve(index: DataFrame, queries: DataFrame, *, key: str, text: str = "chunk_text", uri: str = "uri", k: int = TOP_K) -> DataFrame:
    """Best chunks per question with score, text and uri, ready to be cited.

    The k hits per question are joined back to the index for their text."""
    hits = nearest_chunks(index, queries, key=key, k=k)
    return hits.join(index.select(key, F.col(text).alias("text"), F.col(uri).alias("uri")), key).select(
        "query_id", "rank", "score", "text", "uri"
    )


# --- citations --------------------------------------------------------------------------


def citation_uris(citations: str | Column) -> Column:
    """Flatten nested references to their non-blank URIs, first occurrence first.

    Shape: array<struct<retrievedReferences: array<struct<location: struct<s3Location: struct<uri>>>>>>.
    """
    nested = F.col(citations) if isinstance(citations, str) else citations
    per_citation = F.transform(nested, lambda c: F.coalesce(
        F.transform(c["retrievedReferences"], lambda r: r["location"]["s3Location"]["uri"]), F.array().cast("array<string>")
    ))
    found = F.filter(F.flatten(per_citation), lambda u: u.isNotNull() & (u != ""))
    return F.array_distinct(found)


def citation_error(answer: str, uris: str) -> Column:
    """Why an answer may not be shown as grounded, or NULL."""
    return (
        F.when(~present(answer) | (F.coalesce(F.size(uris), F.lit(0)) <= 0), "a non-empty answer and at least one citation are required")
        .when(F.exists(uris, lambda u: ~is_object_uri(u)), "citation uri must be an s3:// URI")
    )


def cited_answer(answer: str, uris: str, titles: str | None = None) -> Column:
    """Answer followed by numbered sources; NULL when it may not be shown."""
    sources = F.transform(F.sequence(F.lit(1), F.greatest(F.size(uris), F.lit(1))), lambda i: F.concat(
        F.lit("["), i.cast("string"), F.lit("] "),
        F.trim(F.coalesce(F.get(titles, i - 1), F.get(uris, i - 1)) if titles else F.get(uris, i - 1)),
        F.lit(" — "), F.trim(F.get(uris, i - 1)),
    ))
    text = F.concat(F.regexp_replace(F.col(answer), r"\s+$", ""), F.lit("\n\nSources:\n"), F.array_join(sources, "\n"))
    return F.when(citation_error(answer, uris).isNull(), text)


def citations_present(response: str, expected: str) -> Column:
    """Non-blank response that contains every expected URI."""
    return present(response) & F.forall(expected, lambda u: F.contains(F.col(response), u))
