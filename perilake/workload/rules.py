"""Queries over the rule sets of the contracts themselves, on tables shaped as the five source entities.

Every required column is missing in some rows (by the row's key), and every other rule is broken by
some value, so a fault in any rule shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.operators import contracts
from perilake.plans.contracts import CHANGE_TABLES, change_rules, oltp_rules, reference_rules, vocabulary_rules
from perilake.workload.base import Tables, cents, query

# Required columns per entity, as the source tables declare them NOT NULL.
REQUIRED = {
    "customers": ("customer_id", "first_name", "last_name", "date_of_birth", "customer_status", "created_at", "updated_at"),
    "products": ("product_id", "product_code", "product_name", "product_type", "product_status", "effective_from", "created_at", "updated_at"),
    "policies": ("policy_id", "policy_number", "customer_id", "product_id", "policy_status", "start_date", "end_date", "premium_amount", "currency_code", "created_at", "updated_at"),
    "claims": ("claim_id", "claim_number", "policy_id", "customer_id", "claim_status", "incident_date", "submitted_at", "claim_amount", "currency_code", "updated_at"),
    "payments": ("payment_id", "policy_id", "payment_type", "payment_status", "payment_amount", "currency_code", "payment_timestamp", "created_at", "updated_at"),
}
SPREAD = 40  # one key in so many lacks a given column


def _entities(t: Tables) -> dict[str, DataFrame]:
    """Rows with a whole-number ``n``, a first and a second day and an amount in cents."""
    return {
        "customers": t.customer.select(F.col("c_custkey").alias("n"), F.lit("2020-01-01").alias("day"), F.lit("2020-01-01").alias("later"), cents("c_acctbal").alias("c")),
        "products": t.part.select(F.col("p_partkey").alias("n"), F.lit("2020-01-01").alias("day"), F.lit("2020-01-01").alias("later"), F.lit(0).cast("long").alias("c")),
        "policies": t.orders.select(F.col("o_orderkey").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("1998-01-01").alias("later"), (cents("o_totalprice") - 500_000).alias("c")),
        "claims": t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.lit("1998-01-01").alias("later"), (cents("l_extendedprice") - 500_000).alias("c")),
        "payments": t.events.select(F.col("event_id").alias("n"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("2024-01-15").alias("later"), (cents("value") - 500).alias("c")),
    }


ENTITIES_SQL = """e_customers AS (SELECT c_custkey AS n, '2020-01-01' AS day, '2020-01-01' AS later, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer),
e_products AS (SELECT p_partkey AS n, '2020-01-01' AS day, '2020-01-01' AS later, 0 AS c FROM part),
e_policies AS (SELECT o_orderkey AS n, strftime(o_orderdate, '%Y-%m-%d') AS day, '1998-01-01' AS later, CAST(round(o_totalprice * 100) AS BIGINT) - 500000 AS c FROM orders),
e_claims AS (SELECT l_orderkey * 8 + l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%d') AS day, '1998-01-01' AS later, CAST(round(l_extendedprice * 100) AS BIGINT) - 500000 AS c FROM lineitem),
e_payments AS (SELECT event_id AS n, strftime(ts, '%Y-%m-%d') AS day, '2024-01-15' AS later, CAST(round(value * 100) AS BIGINT) - 500 AS c FROM events)"""


def _source_rows(entity: str, rows: DataFrame) -> DataFrame:
    """Typed source columns of an entity; column i is missing where n leaves remainder i."""
    value = {
        "premium_amount": F.col("c"), "claim_amount": F.col("c"), "payment_amount": F.col("c"), "start_date": F.to_date("day"), "end_date": F.to_date("later"),
        "incident_date": F.to_date("day"), "submitted_at": F.to_timestamp("later"), "updated_at": F.to_timestamp("day"),
    }
    columns = [F.when(F.pmod("n", F.lit(SPREAD)) != i, value.get(c, F.lit("x"))).alias(c) for i, c in enumerate(REQUIRED[entity])]
    return rows.select(*columns, *([(F.col("c") - 100_000).alias("approved_amount")] if entity == "claims" else []))


def _missing_sql(entity: str) -> list[str]:
    return [f"SELECT '{entity}' AS entity, '{c} is required' AS failed_rule, count(*) FILTER (n % {SPREAD} = {i}) AS row_count FROM e_{entity}" for i, c in enumerate(REQUIRED[entity])]


def _check_sql(entity: str, rule: str, holds: str, *needs: str) -> str:
    """A rule that is broken where it doesn't hold or one of its columns is missing."""
    absent = " OR ".join([f"n % {SPREAD} = {REQUIRED[entity].index(c)}" for c in needs] or ["FALSE"])
    return f"SELECT '{entity}', '{rule}', count(*) FILTER ({absent} OR NOT ({holds})) FROM e_{entity}"


SOURCE_SQL = " UNION ALL ".join([
    *[part for entity in REQUIRED for part in _missing_sql(entity)],
    _check_sql("policies", "premium_amount must be non-negative", "c >= 0", "premium_amount"),
    _check_sql("policies", "start_date must be before end_date", "day < later", "start_date", "end_date"),
    _check_sql("claims", "claim_amount must be non-negative", "c >= 0", "claim_amount"),
    _check_sql("claims", "approved_amount must be non-negative", "c >= 100000"),
    _check_sql("claims", "incident_date cannot be after submitted_at", "day <= later", "incident_date", "submitted_at"),
    _check_sql("claims", "updated_at cannot be before submitted_at", "day >= later", "updated_at", "submitted_at"),
    _check_sql("payments", "payment_amount must be non-negative", "c >= 0", "payment_amount"),
])


@query(sql=f"WITH {ENTITIES_SQL} SELECT * FROM ({SOURCE_SQL}) WHERE row_count > 0")
def source_constraints(t: Tables) -> DataFrame:
    """Rows that break each NOT NULL and CHECK constraint of the source tables."""
    out = None
    for entity, rows in _entities(t).items():
        broken = contracts.rule_violations(_source_rows(entity, rows), oltp_rules(entity)).withColumn("entity", F.lit(entity))
        out = broken if out is None else out.unionByName(broken)
    return out.groupBy("entity", "failed_rule").agg(F.count(F.lit(1)).alias("row_count"))


# Operation by remainder of n: every seventh is a deletion, every eleventh unknown; every 13th lacks its order, every 17th its key.
_OP = "CASE WHEN n % 7 = 0 THEN 'D' WHEN n % 11 = 0 THEN 'X' ELSE 'U' END"
_LIVE = {
    "customers": [], "products": [],
    "policies": [("premium_amount must be non-negative", "c >= 0"), ("start_date must be before end_date", "day < later")],
    "claims": [("claim_amount must be non-negative", "c >= 0"), ("approved_amount must be non-negative", "c >= 100000"), ("incident_date cannot be after submitted_at", "day <= later")],
    "payments": [("payment_amount must be non-negative", "c >= 0")],
}
CHANGE_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, '{rule}' AS failed_rule, count(*) FILTER ({broken}) AS row_count FROM e_{e}"
    for e, checks in _LIVE.items()
    for rule, broken in [
        (f"{e[:-3] + 'y' if e == 'policies' else e[:-1]}_id is required", "n % 17 = 0"), ("unsupported operation", f"{_OP} = 'X'"), ("source order is required", "n % 13 = 0"),
        *[(rule, f"{_OP} <> 'D' AND NOT ({holds})") for rule, holds in checks],
    ]
)


@query(sql=f"WITH {ENTITIES_SQL} SELECT * FROM ({CHANGE_SQL}) WHERE row_count > 0")
def change_contract(t: Tables) -> DataFrame:
    """Change-log rows that break each rule of their table's change contract, landed as text."""
    amount = (F.col("c") / 100).cast("decimal(18,2)").cast("string")
    out = None
    for entity, rows in _entities(t).items():
        landed = rows.select(
            F.when(F.col("n") % 17 == 0, F.lit(" ")).otherwise(F.col("n").cast("string")).alias(CHANGE_TABLES[entity].key),
            F.when(F.col("n") % 7 == 0, "D").when(F.col("n") % 11 == 0, "X").otherwise("U").alias("_operation"),
            F.when(F.col("n") % 13 != 0, F.to_timestamp("day")).alias("_source_order"),
            *[amount.alias(c) for c in ("premium_amount", "claim_amount", "payment_amount")],
            ((F.col("c") - 100_000) / 100).cast("decimal(18,2)").cast("string").alias("approved_amount"),
            F.col("day").alias("start_date"), F.col("later").alias("end_date"), F.col("day").alias("incident_date"), F.concat("later", F.lit("T00:00:00Z")).alias("submitted_at"),
        )
        broken = contracts.rule_violations(landed, change_rules(entity)).withColumn("entity", F.lit(entity))
        out = broken if out is None else out.unionByName(broken)
    return out.groupBy("entity", "failed_rule").agg(F.count(F.lit(1)).alias("row_count"))


@query(sql=f"""WITH {ENTITIES_SQL} SELECT * FROM (
SELECT 'customers' AS entity, 'customer_status is not an allowed value' AS failed_rule, count(*) FILTER (n % 3 = 0) AS row_count FROM e_customers
UNION ALL SELECT 'products', 'product_status is not an allowed value', count(*) FILTER (n % 3 = 0) FROM e_products
UNION ALL SELECT 'policies', 'policy_status is not an allowed value', count(*) FILTER (n % 3 = 0) FROM e_policies
UNION ALL SELECT 'claims', 'claim_status is not an allowed value', count(*) FILTER (n % 3 = 0) FROM e_claims
UNION ALL SELECT 'payments', 'payment_type is not an allowed value', count(*) FILTER (n % 3 = 0) FROM e_payments
UNION ALL SELECT 'payments', 'payment_status is not an allowed value', count(*) FILTER (n % 5 = 0) FROM e_payments
UNION ALL SELECT 'broker_master', 'commission_rate must be between 0 and 1', count(*) FILTER (NOT s_acctbal BETWEEN 0 AND 5000) FROM supplier
UNION ALL SELECT 'broker_master', 'broker_id must not be null or blank', count(*) FILTER (s_suppkey % 9 = 0) FROM supplier) WHERE row_count > 0""")
def vocabulary_contract(t: Tables) -> DataFrame:
    """Rows outside the code lists and ranges of their entity, and reference rows without a key."""
    from perilake.plans import contracts as fixed

    codes = {"customer_status": fixed.CUSTOMER_STATUSES, "product_status": fixed.PRODUCT_STATUSES, "policy_status": fixed.POLICY_STATUSES,
             "claim_status": fixed.CLAIM_STATUSES, "payment_type": fixed.PAYMENT_TYPES, "payment_status": fixed.PAYMENT_STATUSES}

    def code(name: str, every: int):
        listed = F.array(*[F.lit(v) for v in codes[name]])
        return F.when(F.col("n") % every == 0, "?").otherwise(F.element_at(listed, (F.col("n") % len(codes[name]) + 1).cast("int"))).alias(name)

    parts = []
    for entity, rows in _entities(t).items():
        coded = rows.select(*[code(c, 5 if c == "payment_status" else 3) for c in codes])
        parts.append(contracts.rule_violations(coded, vocabulary_rules(entity)).withColumn("entity", F.lit(entity)))
    brokers = t.supplier.select(F.when(F.col("s_suppkey") % 9 != 0, F.col("s_suppkey").cast("string")).alias("broker_id"), (F.col("s_acctbal") / 5000).alias("commission_rate"))
    rules = [*vocabulary_rules("broker_master"), *reference_rules(fixed.REFERENCES["broker_master"])]
    parts.append(contracts.rule_violations(brokers, rules).withColumn("entity", F.lit("broker_master")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("entity", "failed_rule").agg(F.count(F.lit(1)).alias("row_count"))
