"""Column classification and persona views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
HIGH = ("first_name", "last_name", "date_of_birth", "email", "phone", "description",
        "source_record", "original_record")
MEDIUM_IDENTIFIERS = ("customer_id", "policy_number", "claim_number", "provider_reference",
                      "policy_id", "claim_id", "payment_id")
MEDIUM_VALUES = ("premium_amount", "annual_premium_amount", "claim_amount", "approved_amount",
                 "payment_amount", "high_risk_probability", "high_risk_claim", "outcome_severity",
                 "risk_level")
ANALYST_TABLES = ("broker_performance", "claim_daily_summary", "claim_daily_summary_cdc", "dim_branch",
                  "dim_broker", "dim_claim_type", "dim_coverage", "dim_product_master",
                  "dim_region_risk", "dim_vehicle")
ANALYST_FACTS = ("fact_claim", "fact_claim_cdc", "fact_claim_enriched", "policy_performance")
ANALYST_EXCLUDED = ("customer_id", "claim_number", "policy_number", "provider_reference", "description")
ANALYST_RISK_COLUMNS = ("claim_id", "high_risk_probability", "risk_level", "model_version",
                        "prediction_timestamp", "_run_id", "_ingested_at", "_effective_at")
ML_TABLES = ("claim_risk_features", "claim_risk")
REFERENCE_NUMBERS = ("policy_number", "claim_number", "provider_reference")
PERSONAS = ("DataEngineer", "Analyst", "MLEngineer", "RAGApplication")
# ----------------------------------------------------------------------------------------


class AccessDenied(PermissionError):
    """The persona has no grant on the table."""


def approved_columns(persona: str, table: str, reviewed: list[str]) -> list[str]:
    """Inclusion list of a persona for a table whose reviewed columns are given.

    Built once from the reviewed schema and then kept: columns that appear later are not in
    it, so schema drift cannot widen a grant.
    """
    if persona not in PERSONAS:
        raise AccessDenied(f"unknown persona {persona}")
    if persona == "DataEngineer":
        return list(reviewed)
    if persona == "Analyst":
        if table in ANALYST_TABLES:
            return list(reviewed)
        if table in ANALYST_FACTS:
            return [c for c in reviewed if c not in ANALYST_EXCLUDED and c not in HIGH]
        if table == "claim_risk":
            return [c for c in ANALYST_RISK_COLUMNS if c in reviewed]
    if persona == "MLEngineer" and table in ML_TABLES:
        return list(reviewed)
    raise AccessDenied(f"{persona} has no grant on {table}")


def governed_view(frame: DataFrame, persona: str, table: str, approved: list[str] | None = None) -> DataFrame:
    """Only the approved columns; without a stored list one is derived from the frame."""
    columns = approved if approved is not None else approved_columns(persona, table, frame.columns)
    allowed = set(approved_columns(persona, table, columns))
    return frame.select(*[c for c in columns if c in allowed and c in frame.columns])


def classify(column: str) -> tuple[str, bool]:
    """(sensitivity, is personal data) of a column name."""
    if column in HIGH:
        return "HIGH", True
    if column in MEDIUM_IDENTIFIERS:
        return "MEDIUM", True
    if column in MEDIUM_VALUES:
        return "MEDIUM", False
    return "LOW", False


def without_personal_data(frame: DataFrame) -> DataFrame:
    """Dimension form of an entity: no direct personal data and no sensitive reference numbers."""
    return frame.drop(*[c for c in frame.columns if c in HIGH or c in REFERENCE_NUMBERS])


def pii_columns(frame: DataFrame) -> DataFrame:
    """Every column with its classification and the number of values it exposes (non-null)."""
    filled = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
    rows = []
    for c in frame.columns:
        sensitivity, personal = classify(c)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(sensitivity).alias("sensitivity"),
                             F.lit(personal).alias("personal"), F.col(c).alias("exposed_values")))
    return filled.select(F.inline(F.array(*rows)))
