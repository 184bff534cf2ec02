"""Claim-risk run: validate, split, vectorise, store, train, judge, score and publish."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.operators import features, scoring
from perilake.operators.joins import key_set_difference, match_manifest, semi_by_manifest
from perilake.operators.marts import categorical_coverage, class_distribution, constant_columns
from perilake.operators.ordering import chronological_split, require_both_classes
from perilake.sources.files import read_prepared_snapshot, write_json_report, write_matrix_csv
from perilake.sources.tables import Lakehouse

PREPARED = ("vectors", "manifest")
KEYS = (features.ID, features.EVENT_TIME)


def prepare(lake: Lakehouse, frame: DataFrame, folder: str) -> dict[str, object]:
    """Write vectors and manifest of a validated, split feature dataset, and its metadata.

    Both artefacts are keyed by claim, so later steps never rely on row positions.
    """
    report = features.validate_feature_dataset(frame)
    labelled = chronological_split(frame, "submitted_at", features.ID)
    require_both_classes(labelled.withColumn(features.LABEL, F.col(features.LABEL).cast("int")), features.LABEL)
    manifest = features.sidecar_manifest(labelled, str(report["dataset_version"]))
    vectors = features.vectorize(labelled, keep=(features.ID, features.LABEL, "split", "submitted_at"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")

    categorical_coverage(frame, list(features.LEVELS)).write.mode("overwrite").parquet(f"{folder}/categorical_coverage")

    stored = lake.spark.read.parquet(f"{folder}/vectors")
    by_split = class_distribution(stored, features.LABEL, ["split"]).collect()  # 3 splits x 2 classes
    metadata = {
        "seed": scoring.SEED, "validation": report, "dataset_version": report["dataset_version"], "target": features.LABEL,
        "prediction_time": "claim submitted_at", "features": features.feature_names(),
        "excluded_leakage_fields": list(features.LEAKAGE), "excluded_redundant_features": ["natural_hazard_risk_score"],
        "row_count": report["row_count"], "class_distribution": report["class_distribution"],
        "split_class_distribution": {f"{r.split}/{r[features.LABEL]}": r.row_count for r in by_split},
        "categorical_coverage": f"{folder}/categorical_coverage",
        "constant_features": [r.feature for r in constant_columns(stored, features.feature_names()).collect()],
    }
    write_json_report(lake.spark, metadata, f"{folder}/metadata")
    return metadata


def export_matrices(vectors: DataFrame, folder: str) -> None:
    """Label-first headerless matrices per split, and the label-free inference matrix."""
    names = features.feature_names()
    order = ["submitted_at", features.ID]
    for split in ("train", "validation", "test"):
        write_matrix_csv(vectors.filter(F.col("split") == split), f"{folder}/{split}", names, order, features.LABEL)
    write_matrix_csv(vectors, f"{folder}/inference", names, order)


def store_features(lake: Lakehouse, vectors: DataFrame, manifest: DataFrame, table: str, written_at: Column | None = None) -> int:
    """Append this run's records to the offline feature table; problems stop the run."""
    records = features.to_feature_records(vectors.drop("split", "submitted_at"), manifest, written_at=written_at)
    problems = records.filter(F.col("problem").isNotNull()).groupBy("problem").count().collect()
    if problems:
        raise features.DatasetInvalid([f"{p.problem} ({p['count']} rows)" for p in problems])
    path = f"{lake.root}/features/{table}"
    good = records.drop("problem")
    good.write.mode("append").parquet(path)
    return vectors.count()


def read_back(lake: Lakehouse, manifest: DataFrame, table: str) -> DataFrame:
    """Newest stored record of every manifest key, with its split; incomplete sets are an error."""
    stored = lake.spark.read.parquet(f"{lake.root}/features/{table}")
    wanted = manifest.withColumn(features.EVENT_TIME, features.iso_event_time(
        F.coalesce(F.nullif(F.col(features.EVENT_TIME), F.lit("")), F.col("as_of_date"))))
    visible = features.latest_feature_record(semi_by_manifest(stored, wanted, KEYS))
    gaps = key_set_difference(wanted, visible, KEYS).first()
    if not gaps.complete:
        raise features.DatasetInvalid([f"readback: {gaps.missing_keys} keys missing, {gaps.unexpected_keys} unexpected"])
    side = wanted.select(*KEYS, F.col(features.LABEL).cast("int").alias(features.LABEL), F.col("source_split").alias("split"),
                         "as_of_date", "feature_version", "dataset_version")
    matched = match_manifest(visible, side, KEYS, features.LABEL)
    wrong = matched.filter(F.col("match") != "ok").count()
    if wrong:
        raise features.DatasetInvalid([f"offline label mismatch for {wrong} rows"])
    return matched.drop("match")


def run_claim_risk(
    lake: Lakehouse, run_id: str, *, model_version: str, frame: DataFrame | None = None, prepared: str | None = None,
    rounds: int = scoring.MAX_ROUNDS, minimum_auc: float = scoring.MINIMUM_AUC, at: Column | None = None,
) -> dict[str, object]:
    """Feature table -> trained model -> published ``claim_risk``; nothing is published below the gate.

    ``prepared`` reuses an earlier run's artefacts instead of preparing again.
    """
    folder = prepared or f"{lake.root}/risk/{run_id}"
    parts = read_prepared_snapshot(lake.spark, folder, PREPARED) if prepared else None
    if parts is None:
        source = frame if frame is not None else lake.read_layer("gold", "claim_risk_features")
        prepare(lake, source, folder)
        parts = read_prepared_snapshot(lake.spark, folder, PREPARED)
    submitted = store_features(lake, parts["vectors"], parts["manifest"], "claim_risk", at)
    dataset = read_back(lake, parts["manifest"], "claim_risk")
    dataset.write.mode("overwrite").parquet(f"{folder}/dataset")
    dataset = lake.spark.read.parquet(f"{folder}/dataset")

    names = features.feature_names()
    model: GBTClassificationModel = scoring.train_classifier(dataset, names, features.LABEL, rounds=rounds)
    model.write().overwrite().save(f"{folder}/model")
    scored = scoring.score_batch(model, dataset, names).withColumnRenamed("split", "source_split")
    scored.select(features.ID, features.LABEL, "source_split", "as_of_date", "feature_version", "dataset_version", "probability").write.mode(
        "overwrite").parquet(f"{folder}/scored")
    scored = lake.spark.read.parquet(f"{folder}/scored")

    metrics = scoring.evaluate_test_split(scored, key=features.ID, label=features.LABEL)
    write_json_report(lake.spark, {"binary_classification_metrics": {k: {"value": metrics[k]} for k in (
        "auc", "log_loss", "accuracy", "precision", "recall", "f1")}, "row_count": metrics["row_count"]}, f"{folder}/evaluation")
    scoring.quality_gate(metrics, minimum_auc)
    published = publish_predictions(lake, scored, "probability", run_id, model_version, at)
    return {"metrics": metrics, "submitted_records": submitted, "published": published, "folder": folder}


def publish_predictions(
    lake: Lakehouse, predictions: DataFrame, probability: str, run_id: str, model_version: str, at: Column | None = None,
) -> dict[str, int]:
    """Replace ``claim_risk`` after the staged rows passed identity and probability checks."""
    bad = predictions.filter(~scoring.manifest_valid()).count()
    if bad:
        raise scoring.PublishRefused(f"prediction manifest contains {bad} rows without identity, as_of_date, or dataset_version")
    rows = predictions.select(features.ID, "as_of_date", "feature_version", "dataset_version", F.col(probability).alias("raw_probability"))
    staged = lake.stage(scoring.claim_risk(rows, model_version=model_version, run_id=run_id, at=at), "gold", "claim_risk", run_id)
    counts = scoring.prediction_validation(lake.staged_frame(staged), features.ID, "high_risk_probability").first()
    scoring.check_publishable(counts)
    lake.release(staged)
    return counts.asDict()
