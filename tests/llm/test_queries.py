"""Registered queries against their SQL, and the pipeline stage by stage against plain checks of its promises."""

import os
import duckdb
import pytest

import corpus_pipeline
from conftest import SMALL
from perilake.llm.queries import QUERIES, SQL
from test_ngram_join import brute, shingles
from tools.check_queries import TABLES, canonical

COLUMNS = {
    "op1_vector_search": {"query_id", "rank", "vec_id", "score"},
    "op3_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op5_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op8_mixing_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op11_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op12_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op13_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert COLUMNS.get(name, {"doc_id"}) <= set(frame.columns)
    got = [tuple(r) for r in frame.collect()]
    if name not in SQL:
        assert got
        return
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = made.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert canonical(frame.columns, got) == canonical(names, cursor.fetchall())


def keys(text):
    return {k for line in (text or "").split("\n") if (k := line.encode().strip().lower())}


def test_pipeline_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.durable(stage(spark, before, SMALL))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(old)
        if name != "line dedup":
            assert all(new[i] == old[i] for i in new)
        if name == "line dedup":
            holders = {}
            for r in old.values():
                for k in keys(r.text):
                    holders.setdefault(k, []).append(r.doc_id)
            often = {k for k, h in holders.items() if len(h) >= 10}
            assert set(new) == set(old)
            for i, r in new.items():
                left = keys(old[i].text) - often
                assert keys(r.text) == (left if left or not keys(old[i].text) else keys(old[i].text))
                assert r.n_chars == len(r.text)
        if name == "n-gram Jaccard join":
            want = {i for i, _, c in brute([(r.doc_id, r.text) for r in old.values()], 5, 80) if i == c}
            assert set(new) == want
        if name == "benchmark decontamination":
            holds = {i for i, r in old.items() if any(item in " ".join(r.text.lower().split()) for item in items)}
            assert not holds & set(new) and len(set(old) - set(new)) <= len(holds) + 2
        before = after
    mixed = stages["mixing sources to target weights"](spark, before, SMALL).collect()
    assert {r.doc_id for r in mixed} == set(new) and all(r.taken <= 2 * r.size for r in mixed)


def test_pipeline_on_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "one good line of plain words here", "en", "a", 33), (2, "one good line of plain words here", "en", "a", 33)], schema)
    for start, count in ((odd, 1), (odd.limit(0), 0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.durable(stage(spark, docs, SMALL))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == count
    assert shingles("a b", 5)


def test_pipeline_deletes_what_its_stages_have_read(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs)
        return docs.filter("doc_id % 7 <> 1")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), stage) for i in range(4)])
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    left = [os.path.exists(d.inputFiles()[0].removeprefix("file://")) for d in seen]
    assert left == [True, False, False, True]
