"""Features, training and publication; documents, retrieval and citations."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from perilake.operators import boosting, documents, features, retrieval, scoring
from perilake.operators.ordering import positional_join
from perilake.plans import documents as document_runs
from perilake.plans import risk as risk_runs
from perilake.sources.files import read_documents, read_manifest, read_text_lines_indexed, snapshot_identity


def feature_row(i, **changes):
    base = dict(
        claim_id=f"clm-{i:03d}", high_risk_claim=str(i % 2), submitted_at=(datetime(2026, 1, 1) + timedelta(days=i)).isoformat() + "Z",
        incident_date=(datetime(2025, 12, 30) + timedelta(days=i)).date().isoformat(), as_of_date="", feature_version="v1",
        claim_amount=str(100 + i * (5 if i % 2 else 1)), years_experience="5", catastrophe_risk_score="0.2", region_theft_risk_score="0.3",
        weather_risk_score=str(0.1 + (i % 5) / 10), accident_risk_score="0.4", deductible_aud="500", coverage_limit_aud="10000",
        optional_flag="1", market_value_aud="20000", safety_rating="5", vehicle_age="3", product_type="home", product_risk_tier="LOW",
        broker_tier="GOLD", claim_category="FIRE", overall_risk_band="MEDIUM", coverage_tier="weird", repair_cost_band="LOW",
        theft_risk_band="LOW", vehicle_risk_category="STANDARD")
    return {**base, **changes}


def feature_frame(spark, rows):
    columns = list(feature_row(0))
    frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    return frame.withColumns({"submitted_at": F.col("submitted_at").cast("timestamp"), "high_risk_claim": F.col("high_risk_claim").try_cast("int")})


def test_vector_contract(spark):
    vector = features.vectorize(feature_frame(spark, [feature_row(1)])).first()
    assert len(features.feature_names()) == 54 and len(vector) == 56
    assert vector["product_type__HOME"] == 1.0 and vector["coverage_tier__OTHER"] == 1.0 and vector["reporting_delay_days"] == 2.0
    for column, levels in features.LEVELS.items():
        assert sum(vector[f"{column}__{v}"] for v in levels) == 1.0
    assert features.feature_schema(feature_frame(spark, [feature_row(1)])).groupBy("feature_type").count().collect().__len__() == 3


@pytest.mark.parametrize("changes,issue", [
    ({"claim_amount": ""}, "claim_amount is null"), ({"claim_amount": "-1"}, "claim_amount is null"),
    ({"high_risk_claim": "2"}, "must be 0 or 1"), ({"as_of_date": "2027-01-01"}, "as_of_date is after"),
    ({"claim_id": "clm-001"}, "duplicate claim_id"), ({"safety_rating": "6"}, "safety_rating"), ({"product_type": " "}, "product_type is null"),
])
def test_each_mutation_is_refused(spark, changes, issue):
    with pytest.raises(features.DatasetInvalid, match=issue):
        features.validate_feature_dataset(feature_frame(spark, [feature_row(0, **changes)] + [feature_row(i) for i in range(1, 20)]))


def test_single_class_and_leakage_are_refused(spark):
    with pytest.raises(features.DatasetInvalid, match="both classes"):
        features.validate_feature_dataset(feature_frame(spark, [feature_row(i, high_risk_claim="1") for i in range(5)]))
    with pytest.raises(features.DatasetInvalid, match="leakage"):
        features.assert_no_leakage(["claim_amount", "approved_amount"])


def test_version_ignores_row_order_and_sees_content(spark):
    rows = [feature_row(i) for i in range(12)]
    version = lambda f: features.validate_feature_dataset(f)["dataset_version"]
    one = version(feature_frame(spark, rows))
    assert one == version(feature_frame(spark, rows[::-1]).repartition(5)) and one.startswith("claim-risk-v2-")
    assert one != version(feature_frame(spark, [feature_row(0, claim_amount="99.5"), *rows[1:]]))


def test_legacy_features(spark):
    frame = spark.createDataFrame([("c", "100", "20", "2026-09-01", datetime(2026, 9, 3), "SUBMITTED")],
                                  "claim_id string, claim_amount string, approved_amount string, incident_date string, submitted_at timestamp, claim_status string")
    assert features.legacy_claim_features(frame).first()[1:] == (100.0, 20.0, 2.0, 0.0)


def test_deleting_the_newest_record_exposes_the_one_before(spark):
    rows = [("a", "t", 1, 1, False, "old"), ("a", "t", 2, 1, True, "new"), ("b", "t", 1, 1, False, "x"), ("b", "t", 1, 2, False, "y")]
    frame = spark.createDataFrame(rows, "claim_id string, event_time string, api_invocation_time int, write_time int, is_deleted boolean, v string")
    assert sorted(r.v for r in features.latest_feature_record(frame).collect()) == ["old", "y"]


def test_risk_levels_and_invalid_probabilities(spark):
    rows = spark.createDataFrame([("a", "0.1"), ("b", "0.5"), ("c", "0.699996"), ("d", "1.5"), ("e", "nope")], "claim_id string, raw_probability string")
    frame = rows.withColumn("as_of_date", F.lit("2026-09-01"))
    risk = scoring.claim_risk(frame, model_version="m", run_id="r")
    assert [r.risk_level for r in risk.orderBy("claim_id").collect()[:3]] == ["LOW", "MEDIUM", "HIGH"]
    counts = scoring.prediction_validation(risk, "claim_id", "high_risk_probability").first()
    assert counts[:] == (5, 5, 2)
    with pytest.raises(scoring.PublishRefused):
        scoring.check_publishable(counts)
    for bad in (0.4, None, float("nan")):
        with pytest.raises(scoring.PublishRefused):
            scoring.quality_gate({"auc": bad})


def test_prediction_lines_meet_their_manifest_rows(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.out").write_text("0.1,x\n0.2\n\n0.3\n")
    (tmp_path / "out" / "b.out").write_text("0.4\n")
    (tmp_path / "ids.csv").write_text("claim_id,as_of_date,extra\nc1,2026-01-01,z\nc2,2026-01-01,z\nc3,2026-01-01,z\nc4,2026-01-01,z\n")
    lines = read_text_lines_indexed(spark, str(tmp_path / "out"))
    manifest = read_manifest(spark, str(tmp_path / "ids.csv"), ["claim_id", "as_of_date"])
    got = {r.claim_id: r.raw_probability for r in positional_join(manifest, lines).collect()}
    assert got == {"c1": "0.1", "c2": "0.2", "c3": "0.3", "c4": "0.4"}


def test_claim_risk_run(spark, lake, tmp_path):
    frame = feature_frame(spark, [feature_row(i) for i in range(60)])
    done = risk_runs.run_claim_risk(lake, "risk-1", model_version="m1", frame=frame, rounds=3, minimum_auc=0.0)
    assert done["published"] == {"row_count": 60, "unique_claims": 60, "invalid_probabilities": 0}
    assert done["metrics"]["row_count"] == 12 and 0 <= done["metrics"]["auc"] <= 1
    gold = lake.read_layer("gold", "claim_risk")
    assert gold.count() == 60 and {r.model_version for r in gold.select("model_version").distinct().collect()} == {"m1"}
    manifest = spark.read.parquet(f"{done['folder']}/manifest")
    assert {r.source_split: r["count"] for r in manifest.groupBy("source_split").count().collect()} == {"train": 36, "validation": 12, "test": 12}
    risk_runs.export_matrices(spark.read.parquet(f"{done['folder']}/vectors"), str(tmp_path / "matrices"))
    line = spark.read.text(str(tmp_path / "matrices/train")).first().value.split(",")
    assert len(line) == 55 and line[0] in "01"
    with pytest.raises(scoring.PublishRefused):
        risk_runs.run_claim_risk(lake, "risk-2", model_version="m2", prepared=done["folder"], rounds=2, minimum_auc=1.01)
    assert gold.select("model_version").first().model_version == "m1"


# --- documents ------------------------------------------------------------------------------

GOOD = b"The waiting period for eligible accidental damage claims is ten days."


def corpus(spark, items):
    return spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in items], "source string, content binary")


def test_document_contract(spark):
    frame = corpus(spark, [("good", GOOD), ("blank", b" \n "), ("none", b""), ("latin", b"caf\xe9 is not valid utf8 at all"),
                           ("nul", b"one two three four five\x00 six"), ("short", b"one two three four")])
    got = {r.source: (r.status, r.failure_reason) for r in documents.document_manifest(frame).collect()}
    assert got == {
        "good": ("VALID", None), "blank": ("REJECTED", "document is empty"), "none": ("REJECTED", "document is empty"),
        "latin": ("REJECTED", "document is not valid UTF-8"), "nul": ("REJECTED", "document contains NUL bytes"),
        "short": ("REJECTED", "document has insufficient meaningful text")}
    valid = documents.document_manifest(frame).filter("status = 'VALID'").first()
    assert len(valid.document_id) == 24 and valid.document_version == "sha256:" + valid.content_hash and valid.size_bytes == len(GOOD)


def test_manifest_changes_and_decisions(spark):
    old = documents.document_manifest(corpus(spark, [("a", GOOD), ("b", GOOD), ("c", GOOD)]))
    new = documents.document_manifest(corpus(spark, [("a", GOOD), ("b", GOOD + b" Changed."), ("d", GOOD)]))
    kinds = sorted(r.change for r in documents.manifest_changes(old, new).collect())
    assert kinds == ["added", "changed", "deleted", "unchanged"]
    assert documents.sync_decision(documents.manifest_changes(old, new), new).first().decision == "SYNC"
    assert documents.sync_decision(documents.manifest_changes(old, old), old).first().decision == "SKIP"


def test_chunks_cover_every_word_once_past_the_overlap(spark):
    for n in (1, 299, 300, 301, 570, 571, 1000):
        text = " ".join(f"w{i}" for i in range(n))
        pieces = [r.chunk_text.split() for r in documents.chunk_documents(spark.createDataFrame([(text,)], "text string")).orderBy("chunk_no").collect()]
        rebuilt = pieces[0] + [w for p in pieces[1:] for w in p[30:]]
        assert rebuilt == text.split() and all(len(p) <= 300 for p in pieces) and len(pieces) == max(1, math.ceil((n - 30) / 270))


def test_credential_patterns(spark):
    key = "A" * 16
    texts = [("AKIA" + key, ["access_key"]), ("aws_access_key_id = 'example" + key + "'", []), ("AWS_SECRET_ACCESS_KEY: " + "x" * 30, ["secret_key_assignment"]),
             ("-----BEGIN EC PRIVATE KEY-----", ["private_key"]), ("aws_access_key_id=" + "b" * 16, ["access_key_assignment"]), ("nothing", [])]
    frame = spark.createDataFrame([(t,) for t, _ in texts], "text string")
    assert [r.credentials for r in documents.credential_scan(frame).collect()] == [names for _, names in texts]


def test_nearest_matches_numpy_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    index = rng.normal(size=(200, 8)).astype(np.float32)
    index[100:160] = index[5]  # exact copies
    index[7] = 0
    queries = rng.normal(size=(8, 8))
    queries[0] = index[5]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<double>")
    got = {}
    for r in retrieval.nearest_chunks(frame, asked, key="id").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q in range(8):
        norms = np.linalg.norm(index.astype(float), axis=1)
        scores = np.where(norms > 0, index.astype(float) @ queries[q] / np.where(norms > 0, norms, 1), -np.inf)
        best = sorted(range(200), key=lambda i: (-round(scores[i], 12), i))[:4]
        assert [got[str(q)][r] for r in (1, 2, 3, 4)] == best


def test_citations(spark):
    reference = "struct<location: struct<s3Location: struct<uri: string>>>"
    nest = lambda *uris: [(((u,),),) for u in uris]
    rows = [("Answer. ", [(nest("s3://a", "s3://b"),), (nest("", "s3://a"),)]), ("  ", [(nest("s3://a"),)]), ("Yes", []), ("Yes", [(nest("http://x"),)])]
    frame = spark.createDataFrame(rows, f"answer string, citations array<struct<retrievedReferences: array<{reference}>>>")
    got = document_runs.cite(frame).collect()
    assert got[0].uris == ["s3://a", "s3://b"] and got[0].citation_error is None
    assert got[0].cited_answer == "Answer.\n\nSources:\n[1] s3://a — s3://a\n[2] s3://b — s3://b"
    need = "a non-empty answer and at least one citation are required"
    assert [r.citation_error for r in got[1:]] == [need, need, "citation uri must be an s3:// URI"]
    assert all(r.cited_answer is None for r in got[1:])
    checked = document_runs.cite(frame).select(retrieval.citations_present("cited_answer", "uris").alias("ok")).first()
    assert checked.ok


def test_index_run_reconciliation(spark):
    runs = spark.createDataFrame([("COMPLETE", 2, 2, 0, 0, 0), ("COMPLETE", 2, 1, 1, 0, 0), ("FAILED", 2, 2, 1, 0, 0), ("COMPLETE", 2, 2, 1, 0, 1)],
                                 "ingestion_status string, discovered int, scanned int, newly_indexed int, modified_indexed int, failed int")
    got = documents.ingestion_reconciliation(runs).collect()
    assert [r.status for r in got] == ["PASSED", "FAILED", "FAILED", "FAILED"] and got[0].unchanged_or_skipped == 2


def test_document_sync_and_question(spark, lake, tmp_path):
    folder = tmp_path / "docs" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(GOOD)
    (tmp_path / "docs" / "b.txt").write_bytes(b"Repair costs are reimbursed after the excess amount is deducted.")
    first = document_runs.run_document_sync(lake, read_documents(spark, str(tmp_path / "docs")), "s1")
    assert (first.decision, first.counts["documents_valid"], first.counts["chunks"]) == ("SYNC", 2, 2)
    assert document_runs.run_document_sync(lake, read_documents(spark, str(tmp_path / "docs")), "s2").decision == "SKIP"
    asked = spark.createDataFrame([("q", "What is the waiting period?"), ("r", "Which costs are reimbursed?")], "query_id string, question string")
    best = {r.query_id: r.uri for r in document_runs.ask(lake, asked, k=2).collect() if r["rank"] == 1}
    assert best["q"].endswith("a.txt") and best["r"].endswith("b.txt")
    (folder / "bad.txt").write_bytes(b"  ")
    with pytest.raises(document_runs.SyncBlocked):
        document_runs.run_document_sync(lake, read_documents(spark, str(tmp_path / "docs")), "s3")
    assert lake.read_layer("gold", "document_index").count() == 2


def test_identity_is_the_content_not_the_name(spark, tmp_path):
    for name in ("x.csv", "y.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    (tmp_path / "z.csv").write_text("a,b\n1,3\n")
    one, two, other = (snapshot_identity(spark, str(tmp_path / n)) for n in ("x.csv", "y.csv", "z.csv"))
    assert one == two != other and len(one) == 64


def test_identity_sees_order_padding_and_ends_at_any_split_size(spark, tmp_path):
    forms = {"plain": b"k,v\n1,x\n2,y\n", "moved": b"k,v\n2,y\n1,x\n", "padded": b"k,v\n2,y  \n1,x\n", "crlf": b"k,v\r\n1,x\r\n2,y\r\n",
             "unended": b"k,v\n1,x\n2,y", "twice": b"k,v\n1,x\n1,x\n2,y\n", "blank": b"k,v\n1,x\n2,y\n\n"}
    for name, content in forms.items():
        (tmp_path / name).write_bytes(content)
    found = {name: snapshot_identity(spark, str(tmp_path / name)) for name in forms}
    assert len(set(found.values())) == len(forms)
    large = tmp_path / "large"
    large.write_text("".join(f"{i},{i * 7}\n" for i in range(20_000)))
    whole = snapshot_identity(spark, str(large))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert snapshot_identity(spark, str(large)) == whole
        assert {name: snapshot_identity(spark, str(tmp_path / name)) for name in ("plain", "moved")} == {name: found[name] for name in ("plain", "moved")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    for folder, names in (("a", ("p1", "p2")), ("b", ("q9", "q1"))):
        (tmp_path / folder).mkdir()
        for name, content in zip(names, (forms["plain"], forms["plain"])):
            (tmp_path / folder / name).write_bytes(content)
    assert snapshot_identity(spark, str(tmp_path / "a")) == snapshot_identity(spark, str(tmp_path / "b")) != found["plain"]
    assert datetime.now(timezone.utc)


def test_boosting_waits_for_the_best_round(spark):
    assert scoring.best_round([5, 4, 4.1, 4.2, 3, 3.5], patience=3) == 5
    assert scoring.best_round([5, 4, 4.1, 4.2, 4.3, 3], patience=3) == 2
    assert scoring.best_round([3.0]) == 1
    rows = [(float(i % 17), float(i * 7 % 13), int((i % 17) * (i * 7 % 13) > 50), "validation" if i % 5 == 0 else "train") for i in range(600)]
    frame = spark.createDataFrame(rows, "x double, y double, label int, split string").coalesce(1)
    model = scoring.train_classifier(frame, ["x", "y"], "label", rounds=20)
    losses = model.evaluateEachIteration(scoring.assemble(frame.filter("split = 'validation'"), ["x", "y"]).withColumn("label", F.col("label").cast("double")))
    assert model.getNumTrees == len(losses) == 20 and losses == sorted(losses, reverse=True)  # this loss falls each round
    short = scoring.first_trees(model, 3)
    assert short.getNumTrees == 3 and short.treeWeights == model.treeWeights[:3] and short.trees[2].toDebugString == model.trees[2].toDebugString
    got = scoring.score_batch(short, frame, ["x", "y"]).agg(F.min("probability"), F.max("probability")).first()
    assert 0 < got[0] < got[1] < 1


def boosting_rows(spark, count=3000):
    rows = [(float(i % 97), float(i * 7 % 13), float(i % 3 == 0), 1.0, int((i % 97) * (i * 7 % 13) > 250), ("train", "train", "train", "validation", "test")[i % 5])
            for i in range(count)]
    return spark.createDataFrame(rows, "a double, b double, flag double, same double, label int, split string").repartition(3).cache()


def test_boosting_reads_the_rows_once_a_level(spark):
    """Three passes a round: the rows of a round are never sorted, joined or sent anywhere, and no round is fitted after the wait."""
    frame, names = boosting_rows(spark), ["a", "b", "flag", "same"]
    frame.count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        scoring.train_classifier(frame, names, "label", rounds=10)
        jobs = len(tracker.getJobIdsForGroup("boosting"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10 * scoring.MAX_DEPTH + 6


def test_boosted_margins_losses_and_model_agree(spark):
    """What the blocks add up over a rebase is what Spark's model gives, and the trees are as good as Spark's own."""
    frame, names = boosting_rows(spark), ["a", "b", "flag", "same"]
    seen = []

    def best(losses):
        seen[:] = losses
        return len(losses)

    settings = dict(rounds=23, depth=3, step=0.08, least=2, row_share=0.8, feature_share=0.8, seed=42, patience=12)
    model = boosting.fit(frame, names, "label", "split", best=best, **settings)
    held = scoring.assemble(frame.filter("split = 'validation'"), names).withColumn("label", F.col("label").cast("double"))
    assert model.getNumTrees == len(seen) == 23 and boosting.REBASE < 23
    assert seen == pytest.approx(model.evaluateEachIteration(held), rel=1e-9)
    train = scoring.assemble(frame.filter("split = 'train'"), names).withColumn("label", F.col("label").cast("double"))
    own = GBTClassifier(maxIter=23, maxDepth=3, stepSize=0.08, minInstancesPerNode=2, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42).fit(train)
    assert seen[-1] <= own.evaluateEachIteration(held)[-1] * 1.05
    again = boosting.fit(frame.repartition(1), names, "label", "split", best=best, **settings)
    assert again.getNumTrees == 23
    early = boosting.fit(frame, names, "label", "split", best=lambda losses: min(len(losses), 2), **settings | {"patience": 3})
    assert early.getNumTrees == 2 and early.trees[1].toDebugString == model.trees[1].toDebugString.replace(model.trees[1].uid, early.trees[1].uid)


def test_boosting_with_all_rows_finds_the_best_split(spark):
    """Without draws the first split is the one that brute force finds, and a missing number is an error."""
    frame, names = boosting_rows(spark), ["a", "b", "flag", "same"]
    settings = dict(rounds=1, depth=1, step=0.08, least=2, row_share=1.1, feature_share=1.0, seed=1, best=len, patience=12)
    model = boosting.fit(frame, ["b", "flag", "same"], "label", "split", **settings)
    rows = [(r.b, r.flag, 2 * r.label - 1) for r in frame.filter("split = 'train'").collect()]
    gains = {}
    for at, name in enumerate(("b", "flag")):
        for cut in sorted({r[at] for r in rows})[:-1]:
            left, right = ([r[2] for r in rows if (r[at] <= cut) == side] for side in (True, False))
            gains[name, cut] = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
    name, cut = max(gains, key=gains.get)
    root = model.trees[0]._java_obj.rootNode() if hasattr(model.trees[0], "_java_obj") else model._java_obj.trees()[0].rootNode()
    assert ("b", "flag")[root.split().featureIndex()] == name and cut <= root.split().threshold() < cut + 1
    with pytest.raises(Exception, match="null or not a number"):
        boosting.fit(frame.withColumn("b", F.when(F.col("a") > 3, F.col("b"))), names, "label", "split", **settings)
