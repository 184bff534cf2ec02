"""Table access, the query registry, and the insurance reading of the supplied tables.

Reading: an order is a policy of a customer, its line items are claims on it, a part is the
product, a supplier the broker, the supplier's nation the broker's branch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.functions.money import MONEY
from perilake.operators.joins import Dimension, star_join


class Tables:
    """Lazily read Parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(run: Callable[[Tables], DataFrame]):
        key = name or run.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(run, sql)
        return run

    return register


# --- shared column forms ------------------------------------------------------------------


def day(column):
    return F.date_format(column, "yyyy-MM-dd")


def instant(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def cents(column):
    return F.round(F.col(column) * 100).cast("long")


def as_double(*columns):
    return {c: F.col(c).cast("double") for c in columns}


# --- claims -------------------------------------------------------------------------------


def claim_lines(t: Tables) -> DataFrame:
    """Claims as they arrive: the same claim number may come in several versions."""
    full = cents("l_extendedprice")
    kept = F.lit(100) - F.round(F.col("l_discount") * 100).cast("long")
    approved = F.floor(full * kept / 100) / 100
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"),
        F.col("l_orderkey").alias("policy_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("broker_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_returnflag").alias("claim_category"),
        F.col("l_linestatus").alias("currency_code"),
        F.col("l_shipdate").alias("submitted_at"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").cast(MONEY).alias("claim_amount"),
        F.when(F.col("l_linestatus") == "F", approved.cast(MONEY)).alias("approved_amount"),
    )


CLAIM_LINES = """claim_lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS claim_id, l_orderkey AS policy_id, l_partkey AS product_id,
         l_suppkey AS broker_id, l_linenumber AS line_number, l_returnflag AS claim_category,
         l_linestatus AS currency_code, l_shipdate AS submitted_at, l_discount AS discount, l_tax AS tax,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS claim_amount,
         CASE WHEN l_linestatus = 'F' THEN CAST(
           (CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) // 100
           AS DECIMAL(18,2)) / 100 END AS approved_raw
  FROM lineitem),
claims AS (SELECT * EXCLUDE (approved_raw), CAST(approved_raw AS DECIMAL(18,2)) AS approved_amount FROM claim_lines)"""


def claim_dimensions(t: Tables) -> list[Dimension]:
    """Policy, customer, product, broker, branch and region of a claim."""
    return [
        Dimension(t.orders, "o_orderkey", "policy_id", how="inner", columns={
            "customer_id": "o_custkey", "claim_status": "o_orderstatus", "overall_risk_band": "o_orderpriority",
            "incident_date": F.to_date("o_orderdate"), "annual_premium_amount": F.col("o_totalprice").cast(MONEY)}),
        Dimension(t.customer, "c_custkey", "customer_id", how="inner", columns={"coverage_tier": "c_mktsegment"}),
        Dimension(t.part, "p_partkey", "product_id", columns={
            "product_type": "p_type", "product_category": "p_brand", "product_name": "p_name", "product_size": "p_size"}),
        Dimension(t.supplier, "s_suppkey", "broker_id", columns={"broker_name": "s_name", "branch_id": "s_nationkey", "broker_balance": "s_acctbal"}),
        Dimension(t.nation, "n_nationkey", "branch_id", columns={"branch_name": "n_name", "region_key": "n_regionkey"}),
        Dimension(t.region, "r_regionkey", "region_key", columns={"broker_region_code": "r_name"}),
    ]


def enriched_claims(t: Tables) -> DataFrame:
    """Claims with the attributes of all their dimensions."""
    joined = star_join(claim_lines(t), claim_dimensions(t))
    return joined.withColumn("vehicle_risk_category", F.when(F.col("currency_code") == "F", F.col("product_type")))


ENRICHED = CLAIM_LINES + """,
enriched AS (
  SELECT c.*, o_custkey AS customer_id, o_orderstatus AS claim_status, o_orderpriority AS overall_risk_band,
         CAST(o_orderdate AS DATE) AS incident_date, CAST(o_totalprice AS DECIMAL(18,2)) AS annual_premium_amount,
         c_mktsegment AS coverage_tier, p_type AS product_type, p_brand AS product_category, p_name AS product_name, p_size AS product_size,
         s_name AS broker_name, s_nationkey AS branch_id, s_acctbal AS broker_balance, n_name AS branch_name, n_regionkey AS region_key,
         r_name AS broker_region_code, CASE WHEN c.currency_code = 'F' THEN p_type END AS vehicle_risk_category
  FROM claims c JOIN orders ON c.policy_id = o_orderkey JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON product_id = p_partkey LEFT JOIN supplier ON broker_id = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

POLICY_KEYS = ("policy_id", "product_type", "product_category", "broker_id", "broker_name", "branch_id",
               "branch_name", "broker_region_code", "currency_code")
BROKER_KEYS = ("broker_id", "broker_name", "branch_id", "branch_name", "broker_region_code", "currency_code")

POLICIES = ENRICHED + f""",
policies AS (
  SELECT {', '.join(POLICY_KEYS)}, max(annual_premium_amount) AS annual_premium_amount,
         count(DISTINCT claim_id) AS claim_count, sum(claim_amount) AS total_claim_amount,
         sum(coalesce(approved_amount, 0)) AS total_approved_amount, max(submitted_at) AS latest_claim_submitted_at
  FROM enriched GROUP BY ALL),
brokers AS (
  SELECT {', '.join(BROKER_KEYS)}, count(DISTINCT policy_id) AS active_policy_count,
         sum(annual_premium_amount) AS total_annual_premium, sum(claim_count) AS claim_count,
         sum(total_claim_amount) AS total_claim_amount, sum(total_approved_amount) AS total_approved_amount
  FROM policies GROUP BY ALL)"""


# --- changes ------------------------------------------------------------------------------


def user_changes(t: Tables) -> DataFrame:
    """Events read as a change log of users: signup inserts, error deletes, the rest updates."""
    from perilake.functions.identity import change_id

    operation = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return t.events.select(
        "user_id", "event_id", "event_type", cents("value").alias("value_cents"), F.unix_micros(F.col("ts").cast("timestamp")).alias("order_us"),
        operation.alias("_operation"), F.col("ts").cast("timestamp").alias("_source_order"),
    ).withColumn("_source_change_id", change_id("users", "user_id", "_operation", "order_us", ["event_id", "event_type", "value_cents"]))


USER_CHANGES = """changes AS (
  SELECT *, sha256(concat_ws('||', 'users', user_id, op, order_us, event_id, event_type, value_cents)) AS change_id
  FROM (SELECT user_id, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS value_cents, epoch_us(ts) AS order_us, ts,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events))"""


def scored_documents(t: Tables) -> DataFrame:
    """Labelled documents with a score in [0, 1] derived from their length."""
    score = F.least(F.lit(1.0), F.col("n_chars") / F.lit(32768.0))
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang", "source"), "doc_id").withColumn("score", score)


SCORED = """scored AS (
  SELECT l.*, n_chars, lang, source, least(1.0::DOUBLE, n_chars / 32768.0::DOUBLE) AS score
  FROM labels l JOIN documents USING (doc_id))"""
