"""Lexical retrieval against plain cosines, and how much of the lists it reads."""

import hashlib
import math
import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from perilake.operators import lexical, retrieval
from perilake.session import durable


def slots(text, size=1024):
    return Counter(int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % size for w in text.lower().split())


def brute(texts, questions, k):
    counts = {key: slots(t) for key, t in texts if key is not None and t and t.split()}
    df = Counter(s for c in counts.values() for s in c)
    idf = lambda s: math.log((len(counts) + 1) / (df[s] + 1))
    unit = lambda c: (lambda v, n: {s: x / n for s, x in v.items()} if n else {})({s: tf * idf(s) for s, tf in c.items()}, math.sqrt(sum((tf * idf(s)) ** 2 for s, tf in c.items())))
    vectors = {key: unit(c) for key, c in counts.items()}
    out = {}
    for name, text in questions:
        q = unit(slots(text))
        scored = sorted((-round(sum(q[s] * v[s] for s in q if s in v), 7), key) for key, v in vectors.items() if any(q.get(s, 0) > 0 and v[s] > 0 for s in v))
        if scored:
            out[name] = [(key, -s) for s, key in scored[:k]]
    return out


def made(rng, n):
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    return [(f"t{i:04d}", " ".join([rng.choice(common) for _ in range(20)] + [rng.choice(rare) for _ in range(4)])) for i in range(n)]


def prepared(spark, texts, questions):
    counts = durable(lexical.term_counts(spark.createDataFrame(texts, "id string, body string"), "id", "body"))
    frequencies = durable(lexical.document_frequencies(counts))
    n = counts.select("key").distinct().count()
    asked = lexical.term_counts(spark.createDataFrame(questions, "q string, body string"), "q", "body").withColumnRenamed("key", "query_id")
    return durable(lexical.weighted(counts, frequencies, n)), durable(lexical.weighted(asked, frequencies, n, "query_id"))


def test_top_k_is_exact_and_reads_less_than_all_lists(spark):
    rng = random.Random(4)
    texts = made(rng, 600)
    texts += [(f"z{i}", texts[5][1]) for i in range(6)] + [(None, "w1 r1"), ("empty", " "), ("none", None)]
    questions = [(f"q{i}", texts[i * 7][1] if i % 2 else " ".join(rng.sample(texts[i][1].split(), 6))) for i in range(20)] + [("lost", "nowhere at all"), ("blank", "")]
    postings, asked = prepared(spark, texts, questions)
    got = {}
    for r in lexical.nearest_lexical(postings, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, round(r.score, 7)))
    want = brute(texts, questions, 4)
    assert set(got) == set(want)
    for name, found in want.items():
        assert [s for _, s in got[name]] == pytest.approx([s for _, s in found], abs=2e-7)
        assert [k for k, _ in got[name]] == [k for k, _ in found], name
    ordered = lexical.reading_order(asked.select("query_id", "slot", F.col("w").alias("qw")), postings.groupBy("slot").agg(F.max("w").alias("most")))
    read, _, _ = lexical.lists_to_read(ordered, postings, 4)
    assert read.join(postings, "slot").count() < 0.8 * ordered.join(postings, "slot").count()


def test_frequencies_of_parts_add_up(spark):
    texts = made(random.Random(9), 60)
    counts = lambda rows: lexical.term_counts(spark.createDataFrame(rows, "id string, body string"), "id", "body")
    parts = lexical.document_frequencies(counts(texts[:25])).unionByName(lexical.document_frequencies(counts(texts[25:])))
    added = {r.slot: r.df for r in parts.groupBy("slot").agg(F.sum("df").alias("df")).collect()}
    assert added == {r.slot: r.df for r in lexical.document_frequencies(counts(texts)).collect()}


def test_empty_index_and_words_that_are_everywhere(spark):
    postings, asked = prepared(spark, [("a", "same words"), ("b", "words same")], [("q", "same words")])
    assert lexical.nearest_lexical(postings, asked, 3).collect() == []  # their weight is zero
    postings, asked = prepared(spark, [], [("q", "same words")])
    assert lexical.nearest_lexical(postings, asked, 3).collect() == []


def test_dense_search_keeps_key_types_and_skips_missing_keys(spark):
    when = datetime(2026, 1, 1)
    rows = [(1, Decimal("1.5"), when, [1.0, 0.0]), (2, Decimal("0.5"), when, [1.0, 0.0]), (3, None, None, [1.0, 0.0]), (None, Decimal("9.0"), when, None)]
    frame = spark.createDataFrame(rows, "n int, d decimal(5,1), t timestamp_ntz, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.1]), (None, [1.0, 0.1]), ("none", None)], "query_id string, embedding array<double>")
    for key, want in (("d", [Decimal("0.5"), Decimal("1.5")]), ("n", [1, 2, 3])):
        got = retrieval.nearest_chunks(frame, asked, key=key, k=5).orderBy("rank").collect()
        assert [r[key] for r in got] == want and {r.query_id for r in got} == {"q"}
    kind = retrieval.nearest_chunks(frame, asked, key="d", k=5).schema["d"].dataType.simpleString()
    assert kind == "decimal(5,1)"
    assert retrieval.nearest_chunks(frame, asked.limit(0), key="n").count() == 0


def test_no_pair_of_question_and_text_is_shuffled(spark, monkeypatch):
    """Texts in one row each, over several shards: equal to plain cosines, and only the k best of a shard leave it."""
    monkeypatch.setattr(lexical, "SHARD_TEXTS", 100)
    rng = random.Random(6)
    texts = made(rng, 500) + [(None, "w1 r1"), ("empty", " "), ("none", None)]
    texts += [(f"z{i}", texts[5][1]) for i in range(6)]
    parts = [(key, half) for key, text in texts[:40] for half in (" ".join(text.split()[:9]), " ".join(text.split()[9:]))] + texts[40:]  # a key in two rows is one text
    questions = [(f"q{i}", texts[i * 7][1]) for i in range(15)] + [("lost", "nowhere at all"), ("blank", "")]
    frame = spark.createDataFrame(parts, "id string, body string")
    vectors = lexical.term_vectors(frame, "id", "body")
    plain = {(r.key, r.slot, r.tf) for r in lexical.term_counts(frame, "id", "body").collect()}
    assert {(r.key, s, n) for r in vectors.collect() for s, n in zip(r.slots, r.tfs, strict=True)} == plain
    frequencies = durable(lexical.document_frequencies(vectors.select(F.explode("slots").alias("slot"))))
    n = vectors.count()
    asked = durable(lexical.weighted(lexical.term_counts(spark.createDataFrame(questions, "q string, body string"), "q", "body").withColumnRenamed("key", "query_id"), frequencies, n, "query_id"))
    found = lexical.nearest_texts(vectors, frequencies, n, asked, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, round(r.score, 7)))
    want = brute(texts, questions, 4)
    assert {name: [k for k, _ in best] for name, best in got.items()} == {name: [k for k, _ in best] for name, best in want.items()}
    assert [s for best in got.values() for _, s in best] == pytest.approx([s for name in got for _, s in want[name]], abs=2e-7)
    for plan in (found, lexical.nearest_lexical(durable(lexical.weighted(lexical.term_counts(frame, "id", "body"), frequencies, n)), asked, 4)):
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
