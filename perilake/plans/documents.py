"""Document run: manifest, change detection, chunking, embedding, retrieval and citation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.operators import documents, retrieval
from perilake.sources.tables import Lakehouse


class SyncBlocked(RuntimeError):
    """Rejected documents or credentials keep the corpus from being synchronised."""


@dataclass(frozen=True)
class SyncResult:
    decision: str
    counts: dict[str, int]


def run_document_sync(lake: Lakehouse, corpus: DataFrame, run_id: str) -> SyncResult:
    """Bring the chunk index up to date with a corpus of (source, content).

    Nothing is indexed when a document is rejected or carries a credential, or when no
    document changed. Documents are compared by content hash. The manifest is replaced last,
    so an interrupted run is repeated in full.
    """
    staged = lake.stage(documents.document_manifest(corpus), "silver", "document_manifest", run_id)
    manifest = lake.staged_frame(staged)
    previous = lake.table_or_none("silver", "document_manifest")
    if previous is None:
        previous = manifest.limit(0)
    decision = documents.sync_decision(documents.manifest_changes(previous, manifest), manifest).first()
    counts = {k: decision[k] for k in ("moved", "documents_discovered", "documents_valid", "documents_rejected")}
    if decision.decision == "BLOCKED":
        rejected = manifest.filter(F.col("status") == "REJECTED").select("source", "failure_reason")
        rejected.write.mode("overwrite").json(lake.quarantine_path("documents", "document", run_id))
        raise SyncBlocked(f"{decision.documents_rejected} rejected documents must not be synchronised")
    if decision.decision == "SKIP":
        return SyncResult("SKIP", counts)

    text = corpus.select("source", F.col("content").cast("string").alias("text"))
    leaks = documents.credential_scan(text).filter(F.size("credentials") > 0).count()
    if leaks:
        raise SyncBlocked(f"{leaks} documents contain credentials")
    ids = manifest.select("source", "document_id", "document_version")
    chunked = documents.chunk_documents(text.join(ids, "source"))
    pieces = lake.stage(chunked.withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_no")), "silver", "document_chunks", run_id)
    chunks = lake.staged_frame(pieces)
    model = documents.fit_embedding(chunks)
    model.write().overwrite().save(_model_path(lake, run_id))
    index = documents.embed(model, chunks).withColumnRenamed("source", "uri").withColumn("embedding_run", F.lit(run_id))
    indexed = lake.stage(index, "gold", "document_index", run_id)
    for one in (pieces, indexed, staged):
        lake.release(one)
    return SyncResult("SYNC", {**counts, "chunks": indexed.counts["rows"]})


def _model_path(lake: Lakehouse, run_id: str) -> str:
    return f"{lake.root}/models/embedding/{run_id}"


def ask(lake: Lakehouse, questions: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
    """Best chunks for questions (query_id, question), with score, text and uri."""
    index = lake.read_layer("gold", "document_index")
    newest = index.select("embedding_run").first()
    if newest is None:
        raise LookupError("the document index is empty")
    model = PipelineModel.load(_model_path(lake, newest.embedding_run))
    embedded = documents.embed(model, questions.withColumnRenamed("question", "chunk_text"))
    return retrieval.retrieve(index, embedded, key="chunk_id", k=k)


def cite(answers: DataFrame, answer: str = "answer", citations: str = "citations") -> DataFrame:
    """Generated answers with their numbered sources, or the reason they may not be shown."""
    listed = answers.withColumn("uris", retrieval.citation_uris(citations))
    return listed.withColumns({
        "citation_error": retrieval.citation_error(answer, "uris"), "cited_answer": retrieval.cited_answer(answer, "uris")})
