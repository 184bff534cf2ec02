"""Document contract, manifest, versions, chunks and the credential check."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.functions.identity import content_hash
from perilake.functions.text import WORD_BREAK, has_words, names_where, words
from perilake.operators.joins import changed_versions

# --- fixed values -----------------------------------------------------------------------
MIN_WORDS = 5
CHUNK_WORDS = 300
CHUNK_OVERLAP = 30
EMBEDDING_SIZE = 1024
CREDENTIAL_PATTERNS = {
    "access_key": r"AKIA[0-9A-Z]{16}",
    "temporary_key": r"ASIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (?:RSA|OPENSSH|EC|DSA) PRIVATE KEY-----",
    "access_key_assignment": r"(?i)\baws_access_key_id\s*[:=]\s*['\"]?(?!\$|<|\{|your_|example|redacted)[A-Za-z0-9/+=]{16,}",
    "secret_key_assignment": r"(?i)\baws_secret_access_key\s*[:=]\s*['\"]?(?!\$|<|\{|your_|example|redacted)[A-Za-z0-9/+=]{30,}",
}
# ----------------------------------------------------------------------------------------


def rejection_reason(content: str) -> Column:
    """Why binary content is not an acceptable document, or NULL."""
    text = F.col(content).cast("string")
    return (
        F.when(~F.coalesce(has_words(text, 1), F.lit(False)), "document is empty")
        .when(~F.is_valid_utf8(text), "document is not valid UTF-8")
        .when(F.instr(text, "\0") > 0, "document contains NUL bytes")
        .when(~has_words(text, MIN_WORDS), "document has insufficient meaningful text")
    )


def document_manifest(documents: DataFrame, *, source: str = "source", content: str = "content") -> DataFrame:
    """Trace record of every document: location identity, content version, size, status.

    Rejected documents keep only their source, status and reason.
    """
    judged = documents.withColumn("failure_reason", rejection_reason(content))
    ok = F.col("failure_reason").isNull()
    hashed = judged.withColumn("_digest", F.when(ok, content_hash(content)))
    return hashed.select(
        F.col(source).alias("source"),
        F.when(ok, F.substring(content_hash(source), 1, 24)).alias("document_id"),
        F.col("_digest").alias("content_hash"),
        F.concat(F.lit("sha256:"), F.col("_digest")).alias("document_version"),
        F.when(ok, F.octet_length(content)).alias("size_bytes"),
        F.when(ok, "VALID").otherwise("REJECTED").alias("status"),
        "failure_reason",
    )


def document_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("documents_discovered"),
        F.count_if(F.col("status") == "VALID").alias("documents_valid"),
        F.count_if(F.col("status") == "REJECTED").alias("documents_rejected"),
    )


def manifest_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """added / changed / unchanged / deleted per valid document."""
    valid = lambda m: m.filter(F.col("status") == "VALID").select("document_id", "content_hash")
    return changed_versions(valid(previous), valid(current), "document_id", "content_hash")


def sync_decision(changes: DataFrame, current: DataFrame) -> DataFrame:
    """BLOCKED when a document was rejected, SKIP when nothing moved, else SYNC."""
    moved = changes.agg(F.count_if(F.col("change") != "unchanged").alias("moved"))
    rejected = document_counts(current)
    one = moved.withColumn("_one", F.lit(1)).join(rejected.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return one.withColumn(
        "decision",
        F.when(F.col("documents_rejected") > 0, "BLOCKED").when(F.col("moved") == 0, "SKIP").otherwise("SYNC"),
    )


def ingestion_reconciliation(stats: DataFrame) -> DataFrame:
    """Judge index runs: everything discovered was scanned, nothing failed, run complete."""
    scanned, failed = F.coalesce("scanned", F.lit(0)), F.coalesce("failed", F.lit(0))
    indexed = F.coalesce("newly_indexed", F.lit(0)) + F.coalesce("modified_indexed", F.lit(0))
    ok = (F.col("ingestion_status") == "COMPLETE") & (scanned == F.col("discovered")) & (failed == 0)
    return stats.withColumns({
        "indexed_or_modified": indexed,
        "unchanged_or_skipped": F.greatest(F.lit(0), scanned - indexed - failed),
        "status": F.when(ok, "PASSED").otherwise("FAILED"),
    })


def chunk_documents(
    documents: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Overlapping word windows over the whole text, as (chunk_no, chunk_words, chunk_text).

    A window starts every ``size - overlap`` words while there is text the previous one did
    not cover. A document with n words yields about n / (size - overlap) rows, made where the
    document is; no shuffle.
    """
    step = size - overlap
    n = F.size("_words")
    last = F.when(n > size, F.ceil((n - size) / step).cast("int")).when(n > 0, F.lit(0))
    # Outer, then filtered: a plain explode would split every text a second time in a filter below it.
    numbered = documents.withColumn("_words", words(text)).withColumn(
        "chunk_no", F.explode_outer(F.sequence(F.lit(0), last))
    ).filter(F.col("chunk_no").isNotNull())
    piece = F.slice("_words", F.col("chunk_no") * step + 1, size)
    return numbered.select(
        *[c for c in documents.columns if c != text], "chunk_no", F.size(piece).alias("chunk_words"),
        F.array_join(piece, " ").alias("chunk_text"),
    )


def fit_embedding(chunks: DataFrame, text: str = "chunk_text", size: int = EMBEDDING_SIZE) -> PipelineModel:
    """Lexical embedding of a corpus: hashed term frequency x inverse document frequency, unit length.

    Fitting gathers one document count per hash slot, so its size does not grow with the corpus.
    Save the model next to the index: questions must be embedded with the same weights.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_terms", pattern=WORD_BREAK, toLowercase=True),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(chunks)


def embed(model: PipelineModel, texts: DataFrame, name: str = "embedding") -> DataFrame:
    """Add the vector of each text as ``array<float>``; the text column is the fitted one."""
    return model.transform(texts).withColumn(name, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_tfidf", "_unit")


def credential_scan(texts: DataFrame, text: str = "text") -> DataFrame:
    """Names of the high-confidence credential patterns found anywhere in each text."""
    return texts.withColumn("credentials", names_where((F.col(text).rlike(p), n) for n, p in CREDENTIAL_PATTERNS.items()))
