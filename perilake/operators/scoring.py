"""Training, scoring, the publication gate and the published risk table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.functions.money import PROBABILITY, is_probability, risk_level
from perilake.functions.text import present
from perilake.operators import boosting
from perilake.operators.metrics import evaluate_binary

# --- fixed values: training settings and gate ------------------------------------------
MAX_ROUNDS = 100
PATIENCE = 12
MAX_DEPTH = 3
STEP_SIZE = 0.08
MIN_CHILD = 2
ROW_SAMPLE = 0.8
COLUMN_SAMPLE = "0.8"
SEED = 42
MINIMUM_AUC = 0.50
# ---------------------------------------------------------------------------------------


class PublishRefused(RuntimeError):
    """The model or its predictions may not be published."""


def assemble(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error").transform(vectors)


def train_classifier(
    vectors: DataFrame, names: Sequence[str], label: str, split: str = "split", rounds: int = MAX_ROUNDS,
    seed: int = SEED,
) -> GBTClassificationModel:
    """Boosted trees on the train split, cut at the best round of the validation split.

    Rounds count until ``PATIENCE`` of them in a row bring no smaller validation loss; those after are not fitted.
    """
    return boosting.fit(
        vectors, list(names), label, split, rounds=rounds, depth=MAX_DEPTH, step=STEP_SIZE, least=MIN_CHILD, row_share=ROW_SAMPLE,
        feature_share=float(COLUMN_SAMPLE), seed=seed, best=best_round, patience=PATIENCE,
    )


def best_round(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Rounds up to the smallest loss, looking no further than ``patience`` rounds without a smaller one."""
    best = 0
    for at, loss in enumerate(losses):
        if loss < losses[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees."""
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], list(java.treeWeights())[:rounds], strict=True)):
        kept[i], weights[i] = tree, weight
    return GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, java.numFeatures(), java.numClasses()))


def score_batch(model: GBTClassificationModel, vectors: DataFrame, names: Sequence[str], name: str = "probability") -> DataFrame:
    scored = model.transform(assemble(vectors, names)).drop("features", "rawPrediction", "prediction")
    positive = vector_to_array("probability")[1]
    return scored.withColumn("_p", positive).drop("probability").withColumnRenamed("_p", name)


def evaluate_test_split(
    scored: DataFrame, *, key: str, label: str, probability: str = "probability", split: str = "source_split",
) -> dict[str, object]:
    """Metrics on the test rows, after checking that the whole scored set is publishable."""
    checks = prediction_validation(scored, key, probability).first()
    if checks.invalid_probabilities:
        raise PublishRefused(f"{checks.invalid_probabilities} invalid probabilities")
    if checks.unique_claims != checks.row_count:
        raise PublishRefused(f"{checks.row_count - checks.unique_claims} duplicate keys in the prediction manifest")
    metrics = evaluate_binary(scored.filter(F.col(split) == "test"), label, probability)
    return {**metrics, "prediction_count": checks.row_count, "unique_claim_count": checks.unique_claims,
            "duplicate_claim_count": 0, "reconciliation_status": "PASSED"}


def quality_gate(metrics: dict[str, object], minimum_auc: float = MINIMUM_AUC) -> None:
    """Refuse publication below the minimum AUC, or without a usable AUC."""
    value = metrics.get("auc")
    if value is None or value != value or value < minimum_auc:
        raise PublishRefused(f"auc {value} is below {minimum_auc}")


def manifest_valid() -> Column:
    """Identity, as-of date and dataset version are all there."""
    return present("claim_id") & F.col("as_of_date").isNotNull() & present("dataset_version")


def prediction_validation(frame: DataFrame, key: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Row, distinct key and invalid probability counts in one pass, over all rows or per group."""
    return frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("unique_claims"),
        F.count_if(~is_probability(probability)).alias("invalid_probabilities"),
    )


def check_publishable(counts) -> None:
    if not counts.row_count or counts.row_count != counts.unique_claims or counts.invalid_probabilities:
        raise PublishRefused(
            f"rows={counts.row_count}, unique={counts.unique_claims}, invalid_probabilities={counts.invalid_probabilities}"
        )


def claim_risk(
    predictions: DataFrame, *, model_version: str, run_id: str, raw: str = "raw_probability", at: Column | None = None,
) -> DataFrame:
    """The published risk rows. The probability is rounded first and the band is cut on the
    rounded value; an unreadable or out-of-range probability stays visible as invalid."""
    rounded = F.col(raw).cast("string").try_cast(PROBABILITY)
    return (
        predictions.withColumn("high_risk_probability", rounded)
        .drop(raw)
        .withColumns({
            "as_of_date": F.col("as_of_date").cast("string").try_cast("date"),
            "risk_level": risk_level("high_risk_probability"),
            "model_version": F.lit(model_version),
            "model_run_id": F.lit(run_id),
            "prediction_timestamp": F.current_timestamp() if at is None else at,
            "_run_id": F.lit(run_id),
        })
    )
