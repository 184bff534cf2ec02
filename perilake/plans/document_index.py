"""Incremental document index: a document that comes, changes or goes rewrites its own bucket only.

Each document is one row of a bucketed state (:mod:`perilake.sources.state`): its chunks and their
term counts. Weights are not stored. Document frequencies are kept per bucket and generation
and added up over the current ones when a question is asked, so no vector has to be made
again because another document moved. Answers equal those of an index built from nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.functions.text import WORD_BREAK
from perilake.operators import documents, lexical, retrieval
from perilake.operators.changes import live
from perilake.plans.documents import SyncBlocked, SyncResult
from perilake.session import durable
from perilake.sources.state import Fold, StateTable
from perilake.sources.tables import Lakehouse


def index_state(lake: Lakehouse, buckets: int = 64) -> StateTable:
    return StateTable(lake, "document_terms", "document_id", buckets)


def _frequencies(lake: Lakehouse) -> str:
    return f"{lake.root}/control/document_frequencies"


def indexed_documents(texts: DataFrame, version: int) -> DataFrame:
    """State rows of documents (source, document_id, document_version, text): chunks with their term counts."""
    pieces = documents.chunk_documents(texts).withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_no"))
    counted = pieces.withColumn("slots", F.transform(F.filter(F.split(F.lower("chunk_text"), WORD_BREAK), lambda w: w != ""), lambda w: lexical.slot_of(w)))
    terms = F.transform(F.array_distinct("slots"), lambda s: F.struct(s.alias("slot"), F.size(F.filter("slots", lambda x: x == s)).cast("long").alias("tf")))
    chunk = F.struct("chunk_no", "chunk_id", F.col("chunk_text").alias("text"), terms.alias("terms"))
    whole = counted.groupBy("source", "document_id", "document_version").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))  # the chunks of one text
    return _enveloped(whole, "U", version)


def _enveloped(rows: DataFrame, operation: str, version: int) -> DataFrame:
    return rows.withColumns({
        "_operation": F.lit(operation), "_source_order": F.lit(version).cast("long"),
        "_source_change_id": F.sha2(F.concat_ws("||", "document_id", F.coalesce("document_version", F.lit("")), F.lit(operation)), 256)})


def run_document_increment(lake: Lakehouse, corpus: DataFrame, run_id: str, buckets: int = 64) -> SyncResult:
    """Bring the lexical index up to date with a corpus of (source, content).

    As in a full synchronisation nothing is indexed while a document is rejected or a moved one
    carries a credential. Only documents that moved are read as text, chunked and counted.
    The manifest is replaced last, so an interrupted run is repeated, with the same result.
    """
    staged = lake.stage(documents.document_manifest(corpus), "silver", "document_index_manifest", run_id)
    manifest = lake.staged_frame(staged)
    previous = lake.table_or_none("silver", "document_index_manifest")
    previous = manifest.limit(0) if previous is None else previous
    moves = durable(documents.manifest_changes(previous, manifest))
    decision = documents.sync_decision(moves, manifest).first()
    counts = {k: decision[k] for k in ("moved", "documents_discovered", "documents_valid", "documents_rejected")}
    if decision.decision == "BLOCKED":
        manifest.filter(F.col("status") == "REJECTED").select("source", "failure_reason").write.mode("overwrite").json(lake.quarantine_path("documents", "document", run_id))
        raise SyncBlocked(f"{decision.documents_rejected} rejected documents must not be synchronised")
    if decision.decision == "SKIP":
        return SyncResult("SKIP", counts)

    state = index_state(lake, buckets)
    version = state.current()[0] + 1
    arrived = moves.filter(F.col("change").isin("added", "changed")).select("document_id")
    ids = manifest.join(arrived, "document_id").select("source", "document_id", "document_version")
    text = durable(corpus.join(ids, "source").select("source", F.col("content").cast("string").alias("text"), "document_id", "document_version"))
    leaks = documents.credential_scan(text).filter(F.size("credentials") > 0).count()
    if leaks:
        raise SyncBlocked(f"{leaks} documents contain credentials")
    fresh = indexed_documents(text, version)
    kinds = {f.name: f.dataType for f in fresh.schema}
    gone = moves.filter(F.col("change") == "deleted").select(
        "document_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("source", "document_version", "chunks")])
    fold = state.fold(durable(fresh.unionByName(_enveloped(gone, "D", version))), run_id)
    if fold.touched:
        _write_frequencies(lake, state, fold)
        state.commit(fold)
    lake.release(staged)
    return SyncResult("SYNC", {**counts, "buckets": len(fold.touched), "documents": sum(e.live for e in fold.entries)})


def _chunks(rows: DataFrame) -> DataFrame:
    return live(rows).select("bucket", "generation", "source", F.explode("chunks").alias("c"))


def _terms(rows: DataFrame) -> DataFrame:
    return _chunks(rows).select("bucket", "generation", F.col("c.chunk_id").alias("key"), F.explode("c.terms").alias("t")).select("bucket", "generation", "key", "t.slot", "t.tf")


def _write_frequencies(lake: Lakehouse, state: StateTable, fold: Fold) -> None:
    """Texts and document frequencies of the new buckets; a run that failed before it committed is written over by none."""
    new = lake.spark.table(state.name).filter(F.col("generation") == fold.generation)
    texts = _chunks(new).groupBy("bucket", "generation").agg(F.count(F.lit(1)).alias("df")).withColumn("slot", F.lit(-1))  # slot -1: number of texts
    each = _terms(new).groupBy("bucket", "generation", "slot").agg(F.count(F.lit(1)).alias("df"))
    each.unionByName(texts.select("bucket", "generation", "slot", "df")).coalesce(1).write.mode("append").partitionBy("generation").parquet(_frequencies(lake))


def ask_index(lake: Lakehouse, questions: DataFrame, k: int = retrieval.TOP_K, buckets: int = 64) -> DataFrame:
    """Best chunks for questions (query_id, question), with score, rank, text and uri."""
    state = index_state(lake, buckets)
    _, entries = state.current()
    if not entries:
        raise LookupError("the document index is empty")
    rows = state.rows(entries)
    current = lake.spark.createDataFrame([(e.bucket, e.generation) for e in entries], "bucket int, generation string")
    summed = durable(lake.spark.read.parquet(_frequencies(lake)).join(F.broadcast(current), ["bucket", "generation"], "left_semi").groupBy("slot").agg(F.sum("df").alias("df")))
    texts = summed.filter("slot = -1").select("df").first()
    frequencies = summed.filter("slot >= 0")
    n = texts.df if texts else 0
    vectors = durable(_chunks(rows).select(F.col("c.chunk_id").alias("key"), F.col("c.terms.slot").alias("slots"), F.col("c.terms.tf").cast("array<int>").alias("tfs")))
    asked = lexical.term_counts(questions, "query_id", "question").withColumnRenamed("key", "query_id")
    found = lexical.nearest_texts(vectors, frequencies, n, durable(lexical.weighted(asked, frequencies, n, "query_id")), k)
    named = _chunks(rows).select(F.col("c.chunk_id").alias("key"), F.col("c.text").alias("text"), F.col("source").alias("uri"))
    return found.join(named, "key").select("query_id", "rank", "score", "text", "uri")
