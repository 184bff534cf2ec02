"""Gold aggregates, BI cuts and data profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.functions.identity import row_hash
from perilake.functions.money import MONEY, ratio, total, zero_if_missing
from perilake.functions.text import col
from perilake.operators.joins import Dimension, heavy_keys_and_rows, star_join
from perilake.session import tasks_for


def daily_summary(
    claims: DataFrame, keys: Sequence[str], *, claim: str = "claim_id", amount: str = "claim_amount",
    approved: str = "approved_amount",
) -> DataFrame:
    """Claim count and totals per group, with a stable hash of the group key."""
    return (
        claims.groupBy(*keys)
        .agg(
            F.count(claim).alias("claim_count"),
            total(amount).alias("total_claim_amount"),
            total(zero_if_missing(approved)).alias("total_approved_amount"),
        )
        .withColumn("_record_hash", row_hash(list(keys), null_token=None))
    )


def policy_performance(
    claims: DataFrame, keys: Sequence[str], *, dimensions: Sequence[Dimension] = (), policy: str = "policy_id",
    premium: str = "annual_premium_amount", claim: str = "claim_id", amount: str = "claim_amount", approved: str = "approved_amount",
    submitted: str = "submitted_at",
) -> DataFrame:
    """One row per policy (and its attributes): premium once, claims, totals, loss ratio.

    The premium is a policy attribute repeated on each claim, so any non-null value is the
    value; the maximum makes the choice independent of row order.

    ``keys`` may be columns of ``claims`` or of ``dimensions``, which are joined here: the fact is cut
    to ids and measures, dealt by policy, and added up per claim and ids before any dimension
    meets it. A dimension joined on a key, or on what a key determines, is attached to the finished
    groups; only the others meet the rows. Since every grouping holds the policy, the first
    deal serves the distinct count and the totals as well: one narrow shuffle of the fact.
    Policies with a hundredth of all claims or more are dealt by (policy, claim) instead, and what
    is left of them, a row per task and group, is added up once more. The number of tasks follows the
    number of claims: every grouping of a task holds all its claims in memory.
    """
    known, early, late = {c for c in keys if c in claims.columns}, [], []
    for dim in dimensions:
        (late if dim.on in known else early).append(dim)
        known |= set(dim.columns) if dim.on in known else set(keys) & set(dim.columns)
    attached = {c for dim in late for c in dim.columns}
    groups = [k for k in keys if k not in attached]
    ids = [c for c in claims.columns if c in {*groups, *(d.on for d in early)}]
    own = [premium] if premium not in attached else []
    carried = [c for c in own if c in claims.columns]
    sums = [F.sum("_amount").alias("_amount"), F.sum("_approved").alias("_approved"), F.max("_submitted").alias("_submitted")]
    narrow = claims.select(*ids, *carried, F.col(claim).alias("_claim"), F.col(amount).alias("_amount"),
                           zero_if_missing(approved).alias("_approved"), F.col(submitted).alias("_submitted"))

    def rolled(rows: DataFrame, *by: str) -> DataFrame:
        dealt = rows.repartition(tasks, *by)
        if early:
            dealt = star_join(dealt.groupBy(*ids, "_claim").agg(*sums, *[F.max(c).alias(c) for c in carried]), early)
        once = dealt.groupBy(*groups, "_claim").agg(*sums, *[F.max(c).alias(c) for c in own])
        return once.groupBy(*groups).agg(
            *[F.max(c).alias(c) for c in own], F.count("_claim").alias("claim_count"), total("_amount").alias("total_claim_amount"),
            total("_approved").alias("total_approved_amount"), F.max("_submitted").alias("latest_claim_submitted_at"))

    heavy, count = heavy_keys_and_rows(claims, policy)
    tasks = tasks_for(claims.sparkSession, count)
    found = rolled(narrow, policy)
    if heavy:
        busy = F.coalesce(F.col(policy).isin(*heavy), F.lit(False))
        found = rolled(narrow.filter(~busy), policy).unionByName(rolled(narrow.filter(busy), policy, "_claim"))
    return star_join(found, late).select(
        *keys, F.col(premium).alias("annual_premium_amount"), "claim_count", "total_claim_amount", "total_approved_amount",
        "latest_claim_submitted_at", ratio("total_approved_amount", premium).alias("loss_ratio"))


def broker_performance(policies: DataFrame, keys: Sequence[str], *, policy: str = "policy_id") -> DataFrame:
    """Roll policies up to brokers, so each premium counts once."""
    return (
        policies.groupBy(*keys)
        .agg(
            F.count_distinct(policy).alias("active_policy_count"),
            total("annual_premium_amount").alias("total_annual_premium"),
            F.sum("claim_count").alias("claim_count"),
            total("total_claim_amount").alias("total_claim_amount"),
            total("total_approved_amount").alias("total_approved_amount"),
        )
        .withColumn("loss_ratio", ratio("total_approved_amount", "total_annual_premium"))
    )


# --- BI -------------------------------------------------------------------------------

# Projections of the BI views.
BI_FACT_COLUMNS = ("claim_id", "claim_status", "claim_amount", "approved_amount", "currency_code",
                   "incident_date", "submitted_at", "updated_at", "policy_id", "customer_id")
BI_DAILY_COLUMNS = ("incident_date", "claim_status", "claim_count", "total_claim_amount",
                    "total_approved_amount", "currency_code")
BI_BROKER_COLUMNS = ("broker_id", "broker_name", "branch_id", "branch_name", "broker_region_code",
                     "active_policy_count", "total_annual_premium", "claim_count", "loss_ratio")


def bi_fact_claim(fact: DataFrame) -> DataFrame:
    return fact.select(*BI_FACT_COLUMNS)


def bi_daily_summary(summary: DataFrame) -> DataFrame:
    return summary.select(*BI_DAILY_COLUMNS)


def broker_ranking(brokers: DataFrame) -> DataFrame:
    return brokers.select(*BI_BROKER_COLUMNS).orderBy(F.col("total_annual_premium").desc(), "broker_id", *BI_BROKER_COLUMNS[1:5])


def volume_by(enriched: DataFrame, groups: Mapping[str, str | Column], amount: str = "claim_amount") -> DataFrame:
    """Claim count and amount per group, largest amount first."""
    return (
        enriched.groupBy(*[col(c).alias(name) for name, c in groups.items()])
        .agg(F.count(F.lit(1)).alias("claim_count"), F.sum(amount).alias("total_claim_amount"))
        .orderBy(F.col("total_claim_amount").desc(), *groups)
    )


def claims_by_category_band(enriched: DataFrame) -> DataFrame:
    return volume_by(enriched, {"claim_category": "claim_category", "overall_risk_band": "overall_risk_band"})


def coverage_vehicle_cut(enriched: DataFrame) -> DataFrame:
    vehicle = F.coalesce(F.col("vehicle_risk_category"), F.lit("NOT_APPLICABLE"))
    return volume_by(enriched, {"coverage_tier": "coverage_tier", "vehicle_risk_category": vehicle})


def product_category_kpis(policies: DataFrame, category: str = "product_category", policy: str = "policy_id") -> DataFrame:
    grouped = policies.groupBy(category).agg(
        F.count_distinct(policy).alias("policy_count"),
        F.sum("annual_premium_amount").alias("written_premium"),
        F.sum("claim_count").alias("claim_count"),
        F.sum("total_approved_amount").alias("approved"),
    )
    return (
        grouped.withColumn("loss_ratio", F.col("approved") / F.nullif(F.col("written_premium"), F.lit(0)))
        .drop("approved")
        .orderBy(F.col("written_premium").desc(), category)
    )


def dashboard_kpis(fact: DataFrame, status: str = "claim_status", amount: str = "claim_amount",
                   approved: str = "approved_amount") -> DataFrame:
    """Totals per status plus one ALL row, from one pass over the fact."""
    per_status = fact.groupBy(F.col(status).alias("status")).agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum(amount).alias("total_claim_amount"),
        F.sum(approved).alias("total_approved_amount"),
    )
    return per_status.rollup("status").agg(
        F.grouping("status").alias("_all"),
        *[F.sum(c).alias(c) for c in ("claim_count", "total_claim_amount", "total_approved_amount")],
    ).select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("status")).alias("status"),
        "claim_count", "total_claim_amount", "total_approved_amount",
    )


# --- profiles -------------------------------------------------------------------------


def label_profile(features: DataFrame, label: str, averages: Mapping[str, str]) -> DataFrame:
    return features.groupBy(label).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(F.col(c).cast("double")).alias(name) for name, c in averages.items()],
    )


def completeness_profile(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Total rows and NULLs of each column (output name -> column), one pass."""
    return frame.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(name) for name, c in columns.items()],
    )


def point_in_time_profile(frame: DataFrame, *, submitted: str, incident: str, amount: str) -> DataFrame:
    return frame.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(submitted).isNull()).alias("missing_prediction_timestamp"),
        F.count_if(F.to_date(incident) > F.to_date(submitted)).alias("future_incident_date"),
        F.count_if(F.col(amount) < 0).alias("invalid_claim_amount"),
    )


def split_profile(labelled: DataFrame, *, label: str, time: str, split: str = "split") -> DataFrame:
    return labelled.groupBy(split).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(label) == 1).alias("positive_count"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        F.min(time).alias("min_prediction_timestamp"),
        F.max(time).alias("max_prediction_timestamp"),
    )


def class_distribution(frame: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return frame.groupBy(*by, label).agg(F.count(F.lit(1)).alias("row_count"))


def categorical_coverage(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of each categorical column; blank is MISSING.

    The columns are unpivoted in place and counted map-side, so one shuffle carries at most
    (levels x map tasks) rows.
    """
    level = lambda c: F.coalesce(F.nullif(F.upper(F.col(c)), F.lit("")), F.lit("MISSING"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), level(c).alias("level")) for c in columns])
    return frame.select(F.inline(pairs)).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("row_count"))


def constant_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value (min = max and not mixed with NULL)."""
    ends = frame.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("seen")).alias(c) for c in columns],
    )
    verdicts = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            ((F.col(f"{c}.seen") == 0)
             | ((F.col(f"{c}.low") == F.col(f"{c}.high")) & (F.col(f"{c}.seen") == F.col("_n")))).alias("constant"),
        ) for c in columns
    ])
    return ends.select(F.inline(verdicts)).filter("constant").select("feature")


def distinct_claims(frame: DataFrame, key: str) -> DataFrame:
    return frame.agg(F.count_distinct(key).alias("distinct_claims"))


# --- documented marts -----------------------------------------------------------------


def frequency_and_severity(claims: DataFrame, by: Sequence[str], *, amount: str, claim: str) -> DataFrame:
    """Claim frequency and average amount per product or region."""
    return claims.groupBy(*by).agg(
        F.count(claim).alias("claim_count"), F.sum(amount).alias("total_claim_amount"),
        F.avg(F.col(amount).cast("double")).alias("average_claim_amount"),
        F.max(amount).alias("largest_claim_amount"),
    )


def failed_payments(payments: DataFrame, by: Sequence[str], *, status: str = "payment_status",
                    amount: str = "payment_amount") -> DataFrame:
    failed = F.col(status) == "FAILED"
    return payments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("payment_count"), F.count_if(failed).alias("failed_count"),
        F.coalesce(F.sum(F.when(failed, F.col(amount))), F.lit(0).cast(MONEY)).alias("failed_amount"),
    )


def status_funnel(history: DataFrame, *, entity: str, status: str = "status") -> DataFrame:
    """Entities that reached each status, visits, and mean days spent there once it ended."""
    spent = (F.unix_micros("valid_to") - F.unix_micros("valid_from")) / 86_400_000_000
    return history.groupBy(status).agg(
        F.count_distinct(entity).alias("entities"), F.count(F.lit(1)).alias("visits"),
        F.avg(spent).alias("average_days"),
    )


def date_order_violations(frame: DataFrame, ordered: Sequence[str]) -> DataFrame:
    """For each neighbouring pair of business dates, rows where the later one comes first."""
    pairs = list(zip(ordered, ordered[1:]))
    counts = frame.agg(*[
        F.count_if(F.col(later) < F.col(earlier)).alias(f"v{i}") for i, (earlier, later) in enumerate(pairs)
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"v{i}").alias("violations"))
        for i, (a, b) in enumerate(pairs)
    ])))


def customer_360(customers: DataFrame, policies: DataFrame, claims: DataFrame, payments: DataFrame, as_of: Column) -> DataFrame:
    """One row per customer known at ``as_of``; each source is cut to that instant first."""
    held = policies.filter(F.col("created_at") <= as_of)
    policy_part = held.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("policy_count"), F.count_if(F.col("policy_status") == "ACTIVE").alias("active_policy_count"),
        total("premium_amount").alias("total_premium"),
    )
    claim_part = claims.filter(F.col("submitted_at") <= as_of).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("claim_count"), total("claim_amount").alias("total_claim_amount"),
    )
    payment_part = (
        payments.filter(F.col("payment_timestamp") <= as_of)
        .groupBy("policy_id").agg(
            F.count_if(F.col("payment_status") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("all"))
        .join(held.select("policy_id", "customer_id"), "policy_id")
        .groupBy("customer_id").agg(F.sum("failed").alias("failed_payment_count"), F.sum("all").alias("payment_count"))
    )
    counts = ["policy_count", "active_policy_count", "claim_count", "failed_payment_count", "payment_count"]
    return (
        customers.filter(F.col("created_at") <= as_of)
        .select("customer_id", "customer_status", F.datediff(as_of, "created_at").alias("tenure_days"))
        .join(policy_part, "customer_id", "left").join(claim_part, "customer_id", "left")
        .join(payment_part, "customer_id", "left")
        .fillna(0, counts)
        .withColumn("as_of_date", F.to_date(as_of))
    )
