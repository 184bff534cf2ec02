"""Documents, chunks, retrieval and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.operators import documents, lexical, retrieval
from perilake.session import durable
from perilake.workload.base import Tables, query

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
WORDS_SQL = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')"


def _files(t: Tables) -> DataFrame:
    uri = F.concat(F.lit("s3://corpus/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return t.documents.select(uri.alias("source"), F.encode("text", "UTF-8").alias("content"))


def _page_files(t: Tables) -> DataFrame:
    return t.pages.select(F.col("url").alias("source"), F.encode("html", "UTF-8").alias("content"))


MANIFEST = f"""judged AS (SELECT doc_id, 's3://corpus/' || source || '/' || doc_id || '.txt' AS source, text, sha256(text) AS h, strlen(text) AS bytes,
 len({WORDS_SQL}) AS n FROM documents),
manifest AS (SELECT source, doc_id, CASE WHEN n >= 5 THEN substr(sha256(source), 1, 24) END AS document_id, CASE WHEN n >= 5 THEN h END AS content_hash,
 CASE WHEN n >= 5 THEN bytes END AS size_bytes, CASE WHEN n >= 5 THEN 'VALID' ELSE 'REJECTED' END AS status,
 CASE WHEN n = 0 THEN 'document is empty' WHEN n < 5 THEN 'document has insufficient meaningful text' END AS failure_reason FROM judged)"""


@query(sql=f"""WITH {MANIFEST} SELECT source, coalesce(document_id, '') AS document_id, coalesce(content_hash, '') AS content_hash, coalesce('sha256:' || content_hash, '') AS document_version,
 coalesce(size_bytes, -1) AS size_bytes, status, coalesce(failure_reason, '') AS failure_reason FROM manifest""")
def document_manifest(t: Tables) -> DataFrame:
    texts = ["document_id", "content_hash", "document_version", "failure_reason"]
    return documents.document_manifest(_files(t)).fillna("", texts).withColumn("size_bytes", F.coalesce(F.col("size_bytes").cast("long"), F.lit(-1)))


@query(sql=f"""WITH {MANIFEST} SELECT count(*) AS documents_discovered, count(*) FILTER (status = 'VALID') AS documents_valid, count(*) FILTER (status = 'REJECTED') AS documents_rejected FROM manifest""")
def document_counts(t: Tables) -> DataFrame:
    return documents.document_counts(documents.document_manifest(_files(t)))


CHANGES_SQL = f"""{MANIFEST}, cur AS (SELECT document_id, content_hash FROM manifest WHERE status = 'VALID'),
prev AS (SELECT document_id, CASE WHEN toxic = 1 THEN sha256(upper(text)) ELSE content_hash END AS content_hash FROM manifest JOIN documents USING (doc_id) JOIN labels USING (doc_id) WHERE status = 'VALID'
 UNION ALL SELECT substr(sha256(url), 1, 24), sha256(html) FROM pages),
diff AS (SELECT coalesce(c.document_id, p.document_id) AS document_id, CASE WHEN p.document_id IS NULL THEN 'added' WHEN c.document_id IS NULL THEN 'deleted'
 WHEN c.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM cur c FULL JOIN prev p ON c.document_id = p.document_id)"""


def _previous(t: Tables) -> DataFrame:
    """The last manifest: the labelled documents, the toxic ones since rewritten, and all pages."""
    uri = F.concat(F.lit("s3://corpus/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    text = F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))
    old = t.documents.join(t.labels, "doc_id").select(uri.alias("source"), F.encode(text, "UTF-8").alias("content"))
    return documents.document_manifest(old.unionByName(_page_files(t)))


@query(sql=f"WITH {CHANGES_SQL} SELECT document_id, change FROM diff")
def manifest_changes(t: Tables) -> DataFrame:
    return documents.manifest_changes(_previous(t), documents.document_manifest(_files(t)))


@query(sql=f"""WITH {CHANGES_SQL} SELECT (SELECT count(*) FROM diff WHERE change <> 'unchanged') AS moved, count(*) AS documents_discovered, count(*) FILTER (status = 'VALID') AS documents_valid,
 count(*) FILTER (status = 'REJECTED') AS documents_rejected, CASE WHEN count(*) FILTER (status = 'REJECTED') > 0 THEN 'BLOCKED' WHEN (SELECT count(*) FROM diff WHERE change <> 'unchanged') = 0 THEN 'SKIP' ELSE 'SYNC' END AS decision FROM manifest""")
def sync_decision(t: Tables) -> DataFrame:
    current = durable(documents.document_manifest(_files(t)))
    return documents.sync_decision(documents.manifest_changes(_previous(t), current), current)


@query(sql="""WITH runs AS (SELECT source, count(*) AS discovered, count(*) FILTER (lang <> 'de') AS scanned, count(*) FILTER (n_chars > 1000) AS newly_indexed,
 count(*) FILTER (n_chars < 100) AS modified_indexed, count(*) FILTER (n_chars > 25000) AS failed FROM documents GROUP BY 1)
SELECT source, scanned, newly_indexed + modified_indexed AS indexed_or_modified, greatest(0, scanned - (newly_indexed + modified_indexed) - failed) AS unchanged_or_skipped,
 CASE WHEN scanned = discovered AND failed = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM runs""")
def ingestion_reconciliation(t: Tables) -> DataFrame:
    runs = t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("lang") != "de").alias("scanned"), F.count_if(F.col("n_chars") > 1000).alias("newly_indexed"),
        F.count_if(F.col("n_chars") < 100).alias("modified_indexed"), F.count_if(F.col("n_chars") > 25000).alias("failed"),
    ).withColumn("ingestion_status", F.lit("COMPLETE"))
    return documents.ingestion_reconciliation(runs).select("source", "scanned", "indexed_or_modified", "unchanged_or_skipped", "status")


@query(sql=f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents), n AS (SELECT *, len(words) AS n FROM w WHERE len(words) > 0),
c AS (SELECT doc_id, words, unnest(range(0, CASE WHEN n <= 300 THEN 1 ELSE CAST(ceil((n - 300) / 270) AS BIGINT) + 1 END)) AS chunk_no FROM n)
SELECT doc_id, chunk_no, len(list_slice(words, chunk_no * 270 + 1, chunk_no * 270 + 300)) AS chunk_words,
 sha256(array_to_string(list_slice(words, chunk_no * 270 + 1, chunk_no * 270 + 300), ' ')) AS chunk_hash FROM c""")
def chunks(t: Tables) -> DataFrame:
    pieces = documents.chunk_documents(t.documents.select("doc_id", "text"))
    return pieces.select("doc_id", "chunk_no", "chunk_words", F.sha2("chunk_text", 256).alias("chunk_hash"))


@query(sql=r"""WITH raw AS (SELECT 'documents' AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'pages', page_id, html FROM pages),
found AS (SELECT corpus, id, list_filter([
 CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'access_key' END, CASE WHEN regexp_matches(text, 'ASIA[0-9A-Z]{16}') THEN 'temporary_key' END,
 CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA|OPENSSH|EC|DSA) PRIVATE KEY-----') THEN 'private_key' END,
 CASE WHEN len(list_filter(regexp_extract_all(text, '(?i)\baws_access_key_id\s*[:=]\s*[''"]?([A-Za-z0-9/+=]{16,})', 1), lambda x: NOT (starts_with(lower(x), 'example') OR starts_with(lower(x), 'redacted')))) > 0 THEN 'access_key_assignment' END,
 CASE WHEN len(list_filter(regexp_extract_all(text, '(?i)\baws_secret_access_key\s*[:=]\s*[''"]?([A-Za-z0-9/+=]{30,})', 1), lambda x: NOT (starts_with(lower(x), 'example') OR starts_with(lower(x), 'redacted')))) > 0 THEN 'secret_key_assignment' END
 ], lambda x: x IS NOT NULL) AS hits FROM raw)
SELECT corpus, array_to_string(hits, ',') AS credentials, count(*) AS texts FROM found GROUP BY 1, 2""")
def credential_scan(t: Tables) -> DataFrame:
    texts = t.documents.select(F.lit("documents").alias("corpus"), "text").unionByName(
        t.conversations.select(F.lit("conversations").alias("corpus"), "text")).unionByName(t.pages.select(F.lit("pages").alias("corpus"), F.col("html").alias("text")))
    found = documents.credential_scan(texts)
    return found.groupBy("corpus", F.array_join("credentials", ",").alias("credentials")).agg(F.count(F.lit(1)).alias("texts"))


CENTROIDS = """cent AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM (
 SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def _centroids(t: Tables) -> DataFrame:
    """Mean vector per label: one question per label, drawn from the whole table."""
    values = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"))
    return packed.select(F.col("label").cast("string").alias("query_id"), F.transform("p", lambda x: x["m"]).alias("embedding"))


@query(sql=f"""WITH {CENTROIDS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT CAST(c.label AS VARCHAR) AS query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score,
 row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) DESC, vec_id) AS rank FROM embeddings, cent c) WHERE rank <= 4""")
def topk_cosine(t: Tables) -> DataFrame:
    return retrieval.nearest_chunks(t.embeddings, _centroids(t), key="vec_id").withColumn("score", F.round("score", 6))


def _references(t: Tables) -> DataFrame:
    """One answer per source citing, in reading order, the documents it draws on, some twice."""
    uri = F.concat(F.lit("s3://corpus/"), "lang", F.lit("/"), F.col("n_chars").cast("string"))
    per = t.documents.select("doc_id", F.lower("source").alias("answer"), F.array(uri, F.when(F.col("lang") == "fr", "").otherwise(uri), F.concat(uri, F.lit("#2"))).alias("uris"))
    reference = lambda u: F.struct(F.struct(F.struct(u.alias("uri")).alias("s3Location")).alias("location"))
    return per.select("doc_id", "answer", F.array(
        F.struct(F.transform(F.slice("uris", 1, 2), reference).alias("retrievedReferences")), F.struct(F.transform("uris", reference).alias("retrievedReferences"))).alias("citations"))


@query(sql="""SELECT doc_id, 's3://corpus/' || lang || '/' || n_chars || ',' || 's3://corpus/' || lang || '/' || n_chars || '#2' AS uris, true AS complete,
 lower(source) || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] ' || u || ' — ' || u || chr(10) || '[2] ' || u || '#2 — ' || u || '#2' AS cited
FROM (SELECT *, 's3://corpus/' || lang || '/' || n_chars AS u FROM documents)""")
def citations(t: Tables) -> DataFrame:
    cited = _references(t).withColumn("uris", retrieval.citation_uris("citations"))
    answered = cited.withColumn("cited", retrieval.cited_answer("answer", "uris"))
    return answered.select("doc_id", F.array_join("uris", ",").alias("uris"), retrieval.citations_present("cited", "uris").alias("complete"), "cited")


@query(sql="""SELECT CASE WHEN n_chars < 200 OR lang = 'en' THEN 'a non-empty answer and at least one citation are required' WHEN lang = 'fr' THEN 'citation uri must be an s3:// URI' ELSE 'grounded' END AS verdict, count(*) AS answers
FROM documents GROUP BY 1""")
def citation_errors(t: Tables) -> DataFrame:
    uris = F.when(F.col("lang") == "en", F.array().cast("array<string>")).when(F.col("lang") == "fr", F.array(F.lit("s3://a"), F.lit("http://b"))).otherwise(F.array(F.lit("s3://a")))
    rows = t.documents.select(F.when(F.col("n_chars") < 200, "  ").otherwise(F.col("text")).alias("answer"), uris.alias("uris"))
    verdict = F.coalesce(retrieval.citation_error("answer", "uris"), F.lit("grounded"))
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("answers"))


def _slots_sql(of: str, key: str) -> str:
    """Term counts of texts: lower-cased words hashed to 1,024 slots."""
    return f"""SELECT {key}, CAST(('0x' || substr(sha256(word), 1, 8)) AS BIGINT) % 1024 AS slot, count(*) AS tf FROM (
      SELECT {key}, unnest(words) AS word FROM {of}) GROUP BY 1, 2"""


def _unit_sql(counts: str, key: str) -> str:
    return f"""SELECT {key}, slot, v / sqrt(nullif(sum(CAST(round(v * v * 1e6) AS BIGINT)) OVER (PARTITION BY {key}), 0) / 1e6) AS w
      FROM (SELECT {key}, c.slot, tf * ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) AS v FROM {counts} c LEFT JOIN frequencies f ON c.slot = f.slot, total)"""


_LOWER_WORDS = WORDS_SQL.replace("(text,", "(lower(text),")


@query(sql=f"""WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS words FROM documents), sized AS (SELECT *, len(words) AS n FROM d WHERE len(words) > 0),
numbered AS (SELECT doc_id, words, unnest(range(0, CASE WHEN n <= 300 THEN 1 ELSE CAST(ceil((n - 300) / 270) AS BIGINT) + 1 END)) AS chunk_no FROM sized),
pieces AS (SELECT doc_id || '#' || chunk_no AS chunk_id, 's3://corpus/' || doc_id AS uri, list_slice(words, chunk_no * 270 + 1, chunk_no * 270 + 300) AS words FROM numbered),
items AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {_LOWER_WORDS} AS words FROM benchmark),
counts AS ({_slots_sql("pieces", "chunk_id")}), asked AS ({_slots_sql("items", "query_id")}),
frequencies AS (SELECT slot, count(*) AS df FROM counts GROUP BY 1), total AS (SELECT count(DISTINCT chunk_id) AS n FROM counts),
p AS ({_unit_sql("counts", "chunk_id")}), q AS ({_unit_sql("asked", "query_id")}),
scored AS (SELECT query_id, chunk_id, round(sum(CAST(round(q.w * p.w * 1e12) AS BIGINT)) / 1e12, 9) AS score FROM q JOIN p USING (slot) WHERE q.w > 0 AND p.w > 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT query_id, rank, round(score, 6) AS score, chunk_id, uri FROM ranked JOIN pieces USING (chunk_id) WHERE rank <= 4""")
def retrieve_chunks(t: Tables) -> DataFrame:
    """Every benchmark item asked against the lexical index of all document chunks: top four."""
    pieces = documents.chunk_documents(t.documents.select(F.col("doc_id").cast("string").alias("doc"), "text"))
    chunks = pieces.withColumns({"chunk_id": F.concat_ws("#", "doc", "chunk_no"), "uri": F.concat(F.lit("s3://corpus/"), "doc")})
    vectors = lexical.term_vectors(chunks, "chunk_id")
    frequencies = durable(lexical.document_frequencies(vectors.select(F.explode("slots").alias("slot"))))
    texts = vectors.count()
    asked = lexical.term_counts(t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), "text"), "query_id", "text").withColumnRenamed("key", "query_id")
    found = lexical.nearest_texts(vectors, frequencies, texts, durable(lexical.weighted(asked, frequencies, texts, "query_id")), retrieval.TOP_K)
    return found.join(chunks.select(F.col("chunk_id").alias("key"), "uri"), "key").select(
        "query_id", "rank", F.round("score", 6).alias("score"), F.col("key").alias("chunk_id"), "uri")
