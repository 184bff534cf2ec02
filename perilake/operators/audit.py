"""Run audits, reconciliation, alarms and governed views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.functions.money import score
from perilake.functions.text import names_where

# --- fixed values -----------------------------------------------------------------------
TERMINAL_STATUSES = ("SUCCEEDED", "FAILED", "DUPLICATE", "QUARANTINED")
AUDIT_FIELDS = ("run_id", "pipeline_name", "source", "stage", "status", "input_count",
                "output_count", "rejected_count", "duplicate_count")
COUNT_FIELDS = ("input_count", "output_count", "rejected_count", "duplicate_count")
UNSUCCESSFUL = ("FAILED", "TIMED_OUT", "ABORTED")
ALARM_WINDOW = "5 minutes"
ALARM_THRESHOLD = 1
AUDIT_DDL = """run_id string, pipeline_name string, source string, stage string, status string,
    source_file_id string, input_count long, output_count long, rejected_count long,
    duplicate_count long, quality_score double, reconciliation_passed boolean,
    error_message string, data_quality string, recorded_at timestamp"""
# ----------------------------------------------------------------------------------------


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def reconcile_batch() -> Column:
    """Every input row is output, rejected or duplicate."""
    return _count("input_count") == _count("output_count") + _count("rejected_count") + _count("duplicate_count")


def reconcile_changes() -> Column:
    """A change log folds many changes into one row, so inputs only bound the losses."""
    return _count("input_count") >= _count("rejected_count") + _count("duplicate_count")


def quality_score() -> Column:
    return score(_count("output_count") + _count("duplicate_count"), _count("input_count"))


def finish_audit(runs: DataFrame, kind: str = "batch") -> DataFrame:
    """Add score and reconciliation to run counts; a FAILED run never reconciles."""
    equation = reconcile_batch() if kind == "batch" else reconcile_changes()
    return runs.withColumns({
        "quality_score": quality_score(), "reconciliation_passed": (F.col("status") != "FAILED") & equation,
    })


def audit_errors(audit: DataFrame) -> Column:
    """Messages for one audit row; an empty array is a valid audit."""
    missing = names_where((F.col(f).isNull() if f in audit.columns else F.lit(True), f) for f in sorted(AUDIT_FIELDS))
    have = [f for f in COUNT_FIELDS if f in audit.columns]
    negative = F.lit(False)
    for f in have:
        negative = negative | (F.col(f) < 0)
    reconciles = reconcile_batch() if len(have) == len(COUNT_FIELDS) else F.lit(False)
    flag = F.col("reconciliation_passed") if "reconciliation_passed" in audit.columns else F.lit(None).cast("boolean")
    found = names_where([
        (negative, "audit counts must be non-negative integers"),
        (~negative & ~reconciles, "batch reconciliation failed"),
        (~F.coalesce(flag, F.lit(False)), "reconciliation_passed is not true"),
    ])
    return F.when(
        F.size(missing) > 0, F.array(F.concat(F.lit("missing audit fields: "), F.array_join(missing, ",")))
    ).otherwise(found)


def post_publish_checks(gold: DataFrame, key: str, amount: str, deleted_keys: DataFrame | None = None) -> DataFrame:
    """Rows, distinct keys, negative amounts and (optionally) deleted keys still visible."""
    checks = gold.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("unique_keys"),
        F.count_if(F.col(amount) < 0).alias("negative_amounts"),
    )
    if deleted_keys is None:
        return checks
    still = gold.join(deleted_keys.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("deleted_visible"))
    return checks.withColumn("_one", F.lit(1)).join(still.withColumn("_one", F.lit(1)), "_one").drop("_one")


def failure_alarm(
    executions: DataFrame, *, time: str, group: str, status: str, bad: Sequence[str] = UNSUCCESSFUL,
    window: str = ALARM_WINDOW, threshold: int = ALARM_THRESHOLD,
) -> DataFrame:
    """ALARM windows per pipeline; windows without executions are not breaching, so absent."""
    hits = F.count_if(F.col(status).isin(*bad))
    return (
        executions.groupBy(F.window(time, window).alias("w"), F.col(group).alias("pipeline"))
        .agg(hits.alias("failures"), F.count(F.lit(1)).alias("executions"))
        .select(
            "pipeline", F.col("w.start").alias("window_start"), "failures", "executions",
            F.when(F.col("failures") >= threshold, "ALARM").otherwise("OK").alias("state"),
        )
    )
