"""Entity contracts. Everything in capitals here is a fixed value of the data contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.functions.money import money
from perilake.functions.temporal import as_date, as_instant, as_zoned_instant
from perilake.functions.text import cleaned, code, present
from perilake.operators.contracts import Rule, TableContract
from perilake.operators.quality import AtLeast, IsComplete, IsUnique

# --- fixed values: vocabularies -------------------------------------------------------
CLAIM_STATUSES = ("SUBMITTED", "UNDER_REVIEW", "APPROVED", "REJECTED", "PAID", "CLOSED")
CHANGE_OPERATIONS = ("I", "U", "D")
CUSTOMER_STATUSES = ("ACTIVE", "INACTIVE", "DECEASED", "CLOSED")
PRODUCT_STATUSES = ("ACTIVE", "INACTIVE", "RETIRED")
POLICY_STATUSES = ("QUOTED", "ACTIVE", "LAPSED", "CANCELLED", "EXPIRED")
PAYMENT_TYPES = ("PREMIUM", "CLAIM_PAYOUT", "REFUND")
PAYMENT_STATUSES = ("PENDING", "SUCCEEDED", "FAILED", "REVERSED")

# --- fixed values: broker claim file --------------------------------------------------
CLAIM_FILE = TableContract(
    entity="claim",
    key="claim_id",
    ddl="""claim_id string, claim_number string, policy_id string, customer_id string,
        claim_status string, incident_date date, submitted_at timestamp,
        claim_amount decimal(18,2), approved_amount decimal(18,2), currency_code string,
        description string, updated_at timestamp""",
    optional_ddl="""broker_id string, claim_type_id string, claim_type_code string,
        incident_region_code string, coverage_code string, vehicle_code string,
        outcome_severity string, high_risk_claim int""",
    codes=("claim_status", "currency_code"),
    verbatim=("description",),
    sensitive=("description",),
    gold_table="fact_claim",
)
CLAIM_CONTRACT_LABEL = "claim_contract_v2"

# --- fixed values: reference files ----------------------------------------------------
REFERENCES = {
    spec.entity: spec
    for spec in (
        TableContract(
            "product_master", "product_id", gold_table="dim_product_master", sensitive=("_source_object",),
            ddl="""product_id string, product_code string, product_name string, product_type string,
                product_category string, product_status string, effective_from date, effective_to date,
                base_premium_aud decimal(18,4), coverage_type string, default_excess decimal(18,4),
                risk_tier string, underwriting_category string, distribution_channel string,
                max_sum_insured_aud decimal(18,4), max_sum_insured decimal(18,4), active_flag int,
                expiry_date date, source_updated_at timestamp""",
        ),
        TableContract(
            "broker_master", "broker_id", gold_table="dim_broker", sensitive=("_source_object",),
            ddl="""broker_id string, broker_code string, broker_name string, branch_id string,
                broker_status string, commission_rate decimal(18,4), years_experience int,
                broker_tier string, active_flag int, effective_date date, source_updated_at timestamp""",
        ),
        TableContract(
            "branch_master", "branch_id", gold_table="dim_branch", sensitive=("_source_object",),
            ddl="""branch_id string, branch_code string, branch_name string, region_code string,
                state_code string, city string, branch_status string, manager_code string,
                active_flag int, source_updated_at timestamp""",
        ),
        TableContract(
            "claim_type_reference", "claim_type_id", gold_table="dim_claim_type", sensitive=("_source_object",),
            ddl="""claim_type_id string, claim_type_code string, claim_type_name string, product_type string,
                claim_category string, severity_band string, severity_group string,
                default_reserve_band string, expected_resolution_days int,
                high_risk_threshold_aud decimal(18,4), active_flag int, source_updated_at timestamp""",
        ),
        TableContract(
            "region_risk_reference", "region_code", gold_table="dim_region_risk", sensitive=("_source_object",),
            ddl="""region_code string, state_code string, region_name string,
                catastrophe_risk_score decimal(18,4), theft_risk_score decimal(18,4),
                weather_risk_score decimal(18,4), risk_tier string, urban_rural_class string,
                accident_risk_score decimal(18,4), natural_hazard_risk_score decimal(18,4),
                overall_risk_band string, effective_date date, source_updated_at timestamp""",
        ),
        TableContract(
            "vehicle_reference", "vehicle_code", gold_table="dim_vehicle", sensitive=("_source_object",),
            ddl="""vehicle_code string, make string, model string, model_year int, vehicle_class string,
                vehicle_type string, market_value_aud decimal(18,4), manufacture_year int,
                value_band string, engine_size_band string, repair_cost_band string, safety_rating int,
                theft_risk_score decimal(18,4), theft_risk_band string, risk_category string,
                source_updated_at timestamp""",
        ),
        TableContract(
            "coverage_reference", "coverage_code", gold_table="dim_coverage", sensitive=("_source_object",),
            ddl="""coverage_code string, coverage_name string, product_type string,
                deductible_aud decimal(18,4), coverage_limit_aud decimal(18,4), coverage_tier string,
                coverage_category string, default_limit decimal(18,4), default_excess decimal(18,4),
                optional_flag int, active_flag int, source_updated_at timestamp""",
        ),
    )
}

# --- fixed values: change-log tables --------------------------------------------------
CHANGE_TABLES = {
    spec.entity: spec
    for spec in (
        TableContract(
            "customers", "customer_id",
            ddl="""customer_id string, first_name string, last_name string, date_of_birth string,
                email string, phone string, customer_status string, created_at timestamp,
                updated_at timestamp""",
        ),
        TableContract(
            "products", "product_id",
            ddl="""product_id string, product_code string, product_name string, product_type string,
                product_status string, effective_from date, effective_to date, created_at timestamp,
                updated_at timestamp""",
        ),
        TableContract(
            "policies", "policy_id",
            ddl="""policy_id string, policy_number string, customer_id string, product_id string,
                policy_status string, start_date date, end_date date, premium_amount decimal(18,2),
                currency_code string, created_at timestamp, updated_at timestamp""",
        ),
        TableContract(
            "claims", "claim_id", gold_table="fact_claim_cdc",
            sensitive=("description", "_operation", "_source_order"),
            ddl="""claim_id string, claim_number string, policy_id string, customer_id string,
                claim_status string, incident_date date, submitted_at timestamp,
                claim_amount decimal(18,2), approved_amount decimal(18,2), currency_code string,
                description string, updated_at timestamp""",
        ),
        TableContract(
            "payments", "payment_id",
            ddl="""payment_id string, claim_id string, policy_id string, payment_type string,
                payment_status string, payment_amount decimal(18,2), currency_code string,
                payment_timestamp timestamp, provider_reference string, created_at timestamp,
                updated_at timestamp""",
        ),
    )
}

# --- fixed values: dataset-level quality rules ----------------------------------------
DATASET_RULES = {
    "claim": (IsComplete("claim_id"), IsUnique("claim_id"), AtLeast("claim_amount", 0), IsComplete("policy_id")),
    "claims": (IsComplete("claim_id"), IsUnique("claim_id"), AtLeast("claim_amount", 0), IsComplete("policy_id")),
    "policies": (IsComplete("policy_id"), IsUnique("policy_id"), AtLeast("premium_amount", 0), IsComplete("customer_id")),
    "customers": (IsComplete("customer_id"), IsUnique("customer_id")),
    "payments": (IsComplete("payment_id"), IsUnique("payment_id"), AtLeast("payment_amount", 0)),
}

# --- fixed values: OLTP keys ----------------------------------------------------------
UNIQUE_BUSINESS_KEYS = {"products": "product_code", "policies": "policy_number", "claims": "claim_number"}
FOREIGN_KEYS = (
    # child, column, parent, key, nullable
    ("policies", "customer_id", "customers", "customer_id", False),
    ("policies", "product_id", "products", "product_id", False),
    ("claims", "policy_id", "policies", "policy_id", False),
    ("claims", "customer_id", "customers", "customer_id", False),
    ("payments", "claim_id", "claims", "claim_id", True),
    ("payments", "policy_id", "policies", "policy_id", False),
)


def typed_claim_rules() -> list[Rule]:
    """Contract of a typed claim row (columns already passed through ``conform``)."""
    amount, approved = F.col("claim_amount"), F.col("approved_amount")
    day, sent, changed = F.col("incident_date"), F.col("submitted_at"), F.col("updated_at")
    keys = [Rule(f"{k} is required", present(k)) for k in ("claim_id", "claim_number", "policy_id", "customer_id")]
    return keys + [
        Rule("claim_status is not an allowed value", F.col("claim_status").isin(*CLAIM_STATUSES)),
        Rule("currency_code must be a 3-character ISO code", F.length("currency_code") == 3),
        Rule("incident_date cannot be after submitted_at", day <= F.to_date(sent)),
        Rule("updated_at cannot be before submitted_at", changed >= sent),
        Rule("claim_amount must be non-negative", amount >= 0),
        Rule("approved_amount must be non-negative", approved.isNull() | (approved >= 0)),
        Rule("approved_amount cannot exceed claim_amount", approved.isNull() | (approved <= amount)),
    ]


def read_raw_claims(landed: DataFrame) -> DataFrame:
    """Landed text with each value read once, as the columns :func:`raw_claim_rules` judges."""
    return landed.withColumns({
        "_day": as_date("incident_date"), "_sent": as_zoned_instant("submitted_at"), "_changed": as_zoned_instant("updated_at"),
        "_amount": money("claim_amount"), "_approved": money("approved_amount"),
        "_status": code("claim_status"), "_currency": code("currency_code"),
    })


def raw_claim_rules() -> list[Rule]:
    """Named rules over the landed text, telling apart missing, malformed and inconsistent.

    A consistency rule is only judged when both of its sides could be read, so one bad value
    yields one message.
    """
    required = ("claim_id", "claim_number", "policy_id", "customer_id", "claim_status",
                "currency_code", "submitted_at", "updated_at", "incident_date", "claim_amount")
    day, sent, changed, amount, approved = (F.col(c) for c in ("_day", "_sent", "_changed", "_amount", "_approved"))
    either_unread = lambda a, b: a.isNull() | b.isNull()
    readable = {
        "incident_date is not an ISO date": ("incident_date", day),
        "submitted_at is not an ISO-8601 timestamp with timezone": ("submitted_at", sent),
        "updated_at is not an ISO-8601 timestamp with timezone": ("updated_at", changed),
        "claim_amount is not a decimal amount": ("claim_amount", amount),
        "approved_amount is not a decimal amount": ("approved_amount", approved),
    }
    return [
        *[Rule(f"{c} is required", present(c)) for c in required],
        *[Rule(message, ~present(c) | value.isNotNull()) for message, (c, value) in readable.items()],
        Rule("claim_status is not an allowed value", F.col("_status").isNull() | (F.col("_status") == "") | F.col("_status").isin(*CLAIM_STATUSES)),
        Rule("currency_code must be a 3-character ISO code", F.col("_currency").isNull() | F.length("_currency").isin(0, 3)),
        Rule("incident_date cannot be after submitted_at", either_unread(day, sent) | (day <= F.to_date(sent))),
        Rule("updated_at cannot be before submitted_at", either_unread(sent, changed) | (changed >= sent)),
        Rule("claim_amount must be non-negative", amount.isNull() | (amount >= 0)),
        Rule("approved_amount must be non-negative", approved.isNull() | (approved >= 0)),
        Rule("approved_amount cannot exceed claim_amount", either_unread(amount, approved) | (approved <= amount)),
    ]


def reference_rules(contract: TableContract) -> list[Rule]:
    return [Rule(f"{contract.key} must not be null or blank", present(contract.key))]


def change_rules(table: str) -> list[Rule]:
    """Envelope rules for every change; business rules only for live rows.

    A tombstone may carry nothing but its key, so it must never be rejected for its payload.
    """
    spec = CHANGE_TABLES[table]
    number = lambda c: cleaned(c).try_cast("decimal(18,2)")
    live = {
        "policies": [
            ("premium_amount must be non-negative", number("premium_amount") >= 0),
            ("start_date must be before end_date", as_date("start_date") < as_date("end_date")),
        ],
        "claims": [
            ("claim_amount must be non-negative", number("claim_amount") >= 0),
            ("approved_amount must be non-negative", F.col("approved_amount").isNull() | (number("approved_amount") >= 0)),
            ("incident_date cannot be after submitted_at", as_date("incident_date") <= F.to_date(as_instant("submitted_at"))),
        ],
        "payments": [("payment_amount must be non-negative", number("payment_amount") >= 0)],
    }.get(table, [])
    envelope = [
        Rule(f"{spec.key} is required", present(spec.key)),
        Rule("unsupported operation", F.col("_operation").isin(*CHANGE_OPERATIONS)),
        Rule("source order is required", F.col("_source_order").isNotNull()),
    ]
    return envelope + [Rule(name, (F.col("_operation") == "D") | holds) for name, holds in live]


def oltp_rules(table: str) -> list[Rule]:
    """NOT NULL and CHECK constraints of the source tables, over typed rows."""
    filled = {
        "customers": ("customer_id", "first_name", "last_name", "date_of_birth", "customer_status", "created_at", "updated_at"),
        "products": ("product_id", "product_code", "product_name", "product_type", "product_status", "effective_from", "created_at", "updated_at"),
        "policies": ("policy_id", "policy_number", "customer_id", "product_id", "policy_status", "start_date", "end_date", "premium_amount", "currency_code", "created_at", "updated_at"),
        "claims": ("claim_id", "claim_number", "policy_id", "customer_id", "claim_status", "incident_date", "submitted_at", "claim_amount", "currency_code", "updated_at"),
        "payments": ("payment_id", "policy_id", "payment_type", "payment_status", "payment_amount", "currency_code", "payment_timestamp", "created_at", "updated_at"),
    }[table]
    checks = {
        "policies": [
            ("premium_amount must be non-negative", F.col("premium_amount") >= 0),
            ("start_date must be before end_date", F.col("start_date") < F.col("end_date")),
        ],
        "claims": [
            ("claim_amount must be non-negative", F.col("claim_amount") >= 0),
            ("approved_amount must be non-negative", F.col("approved_amount").isNull() | (F.col("approved_amount") >= 0)),
            ("incident_date cannot be after submitted_at", F.col("incident_date") <= F.to_date("submitted_at")),
            ("updated_at cannot be before submitted_at", F.col("updated_at") >= F.col("submitted_at")),
        ],
        "payments": [("payment_amount must be non-negative", F.col("payment_amount") >= 0)],
    }.get(table, [])
    return [Rule(f"{c} is required", F.col(c).isNotNull()) for c in filled] + [Rule(n, h) for n, h in checks]


def vocabulary_rules(entity: str) -> list[Rule]:
    """Allowed codes per entity, and the broker commission range."""
    allowed = {
        "customers": {"customer_status": CUSTOMER_STATUSES},
        "products": {"product_status": PRODUCT_STATUSES},
        "policies": {"policy_status": POLICY_STATUSES},
        "claims": {"claim_status": CLAIM_STATUSES},
        "payments": {"payment_type": PAYMENT_TYPES, "payment_status": PAYMENT_STATUSES},
        "broker_master": {},
    }[entity]
    rules = [Rule(f"{c} is not an allowed value", F.col(c).isin(*values)) for c, values in allowed.items()]
    if entity == "broker_master":
        rules.append(Rule("commission_rate must be between 0 and 1", F.col("commission_rate").between(0, 1)))
    return rules
