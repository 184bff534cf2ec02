"""Binary classification metrics computed by aggregation, never by comparing pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.functions.money import clamped
from perilake.operators.ordering import running_before

# Decision threshold, and the clip that keeps the logarithm finite.
THRESHOLD = 0.5
CLIP = 1e-15


class MetricError(ValueError):
    """Metrics are undefined: no rows, or only one class."""


def auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half, per group.

    Rows are first reduced to (positives, negatives) per distinct score, which also absorbs a
    score shared by a third of the rows. A positive then beats every negative with a smaller
    score: a running total in score order. The result has NULL auc when a class is absent.
    """
    per_score = scored.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    ranked = running_before(per_score, ["_score"], {"_below": "_neg"}, within=by, partitions=partitions)
    wins = F.sum(F.col("_pos") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(38,0)"))
    summed = ranked.groupBy(*by).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), wins.alias("_twice")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return summed.withColumn("auc", F.col("_twice").cast("double") / 2 / F.nullif(pairs, F.lit(0.0))).drop("_twice")


def threshold_metrics(scored: DataFrame, label: str, score: str, threshold: float = THRESHOLD, by: Sequence[str] = ()) -> DataFrame:
    """Log loss, accuracy, precision, recall and F1 in one aggregation; 0.0 when undefined."""
    y, p = F.col(label), clamped(F.col(score).cast("double"), CLIP, 1 - CLIP)
    said = F.col(score) >= threshold
    base = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(y == 1).alias("positives"),
        F.count_if((y == 1) & said).alias("tp"),
        F.count_if((y == 0) & said).alias("fp"),
        F.count_if((y == 1) & ~said).alias("fn"),
        F.count_if((y == 0) & ~said).alias("tn"),
        (-F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"),
    )
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return base.withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / F.nullif(F.col("row_count"), F.lit(0)),
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def evaluate_binary(scored: DataFrame, label: str, score: str, threshold: float = THRESHOLD) -> dict[str, float]:
    """All metrics of one dataset as a small dict; raises when they are undefined."""
    counted = threshold_metrics(scored, label, score, threshold).first()
    if not counted.row_count:
        raise MetricError("labels and probabilities must not be empty")
    if counted.positives in (0, counted.row_count):
        raise MetricError("evaluation needs both classes")
    names = ("row_count", "log_loss", "accuracy", "precision", "recall", "f1")
    return {**{n: counted[n] for n in names}, "auc": auc(scored, label, score).first().auc}


def univariate_auc(features: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """AUC of every numeric feature taken alone, all features in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = features.select(F.col(label).alias("_label"), F.inline(pairs)).filter(F.col("value").isNotNull())
    return auc(long, "_label", "value", by=["feature"])


def learnability(
    features: DataFrame, label: str, columns: Sequence[str],
    positive_rate: tuple[float, float] = (0.20, 0.35), best_auc: tuple[float, float] = (0.65, 0.90),
) -> DataFrame:
    """Whether the labels are learnable: balanced enough, some signal, no giveaway feature."""
    rate = features.agg(F.avg(F.col(label).cast("double")).alias("positive_rate"))
    best = univariate_auc(features, label, columns).agg(F.max("auc").alias("best_single_auc"))
    one = F.lit(1).alias("_one")  # one row each
    return rate.select("*", one).join(best.select("*", one), "_one").drop("_one").withColumns({
        "balance_ok": F.col("positive_rate").between(*positive_rate),
        "signal_ok": (F.col("best_single_auc") >= best_auc[0]) & (F.col("best_single_auc") < best_auc[1]),
    })


def metric_rows(reports: DataFrame, document: str) -> DataFrame:
    """Nested evaluation JSON -> (metric, value) rows; ``numeric`` is false for other content.

    Each entry of ``binary_classification_metrics`` is a number or an object with ``value``.
    """
    entries = F.from_json(F.get_json_object(document, "$.binary_classification_metrics"), "map<string,string>")
    other = [c for c in reports.columns if c != document]
    exploded = reports.select(*other, F.col(document), F.explode(entries).alias("metric", "_text"))
    named = exploded.select(
        *other, "metric",
        F.coalesce(F.get_json_object("_text", "$.value"), F.col("_text")).alias("_text"),
    )
    counts = reports.select(
        *other, F.lit("evaluation_row_count").alias("metric"), F.get_json_object(document, "$.row_count").alias("_text")
    ).filter(F.col("_text").isNotNull())
    value = F.col("_text").try_cast("double")
    return named.unionByName(counts).select(*other, "metric", value.alias("value"), value.isNotNull().alias("numeric"))
