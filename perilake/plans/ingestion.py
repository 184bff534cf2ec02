"""Batch and change-log runs: Bronze, Silver and Gold with gates, quarantine and audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from perilake.functions.money import MONEY
from perilake.operators.changes import envelope, live, newest_changes
from perilake.operators.contracts import (
    TableContract, add_lineage, conform, drop_sensitive, project_contract, require_columns, split_by_rules,
)
from perilake.operators.dedup import drop_exact_repeats, latest_per_key
from perilake.operators.features import feature_projection
from perilake.operators.joins import Dimension, integrity_report, star_join
from perilake.operators.marts import broker_performance, daily_summary, policy_performance
from perilake.operators.quality import GateFailure, IsUnique, evaluate, gate
from perilake.plans.contracts import (
    CHANGE_TABLES, CLAIM_CONTRACT_LABEL, CLAIM_FILE, DATASET_RULES, FOREIGN_KEYS, REFERENCES, UNIQUE_BUSINESS_KEYS, change_rules,
    reference_rules, typed_claim_rules,
)
from perilake.sources.files import read_change_log, read_csv_snapshot, snapshot_identity
from perilake.sources.tables import LAYERS, Lakehouse, Staged

# Names under which runs are audited.
BATCH, CHANGES = "batch-file", "postgresql-cdc"
EXPANDED_FILE = "broker_claims.csv"
SUMMARY_KEYS = ("incident_date", "claim_status", "currency_code")


class UnsupportedFile(ValueError):
    """The landed file name belongs to no dataset."""


@dataclass
class RunResult:
    run_id: str
    status: str
    source_file_id: str | None = None
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    quality: list[Row] = field(default_factory=list)


def dataset_of(path: str) -> str:
    """``claim`` or a reference dataset, from the landed file name."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.startswith("broker_claims") and name.endswith(".csv"):
        return "claim"
    stem = name.removesuffix(".csv")
    if name.endswith(".csv") and stem in REFERENCES:
        return stem
    raise UnsupportedFile(name)


def _stages(stage: str) -> Sequence[str]:
    if stage == "all":
        return LAYERS
    if stage not in LAYERS:
        raise ValueError(f"unsupported stage: {stage}")
    return (stage,)


# --- batch files -------------------------------------------------------------------------


def run_file(lake: Lakehouse, path: str, run_id: str, stage: str = "all", gate_when: str = "before_dedup",
             at: Column | None = None) -> RunResult:
    """Take one landed snapshot file through the layers.

    A content that was already published is an audited no-op. ``gate_when`` puts the dataset
    gate before de-duplication (an in-file duplicate fails the run) or after it (duplicates are
    collapsed, newest first).
    """
    if gate_when not in ("before_dedup", "after_dedup"):
        raise ValueError(f"unknown gate position: {gate_when}")
    stages, dataset = _stages(stage), dataset_of(path)
    contract = CLAIM_FILE if dataset == "claim" else REFERENCES[dataset]
    file_id = snapshot_identity(lake.spark, path)
    result = RunResult(run_id, "SUCCEEDED", file_id)
    audit = {"run_id": run_id, "pipeline": BATCH, "source": path, "source_file_id": file_id}

    prior = lake.processed(file_id)
    if prior is not None:
        for name in stages:
            result.counts[name] = {"input": prior.input_count, "output": 0, "rejected": 0, "duplicate": prior.input_count}
            lake.write_audit(stage=name, status="DUPLICATE", counts=result.counts[name], **audit)
        result.status = "DUPLICATE"
        return result

    for name in stages:
        try:
            if name == "bronze":
                counts = _file_bronze(lake, path, run_id, file_id, contract, at)
            elif name == "silver":
                counts = _file_silver(lake, path, run_id, file_id, contract, gate_when, result, at)
            else:
                counts = _file_gold(lake, run_id, contract, at)
        except GateFailure as failure:
            lake.write_audit(stage=name, status="FAILED", error=str(failure), counts=result.counts.get(name),
                             quality=[r.asDict() for r in failure.results], **audit)
            raise
        except Exception as problem:
            lake.write_audit(stage=name, status="FAILED", error=str(problem)[:2000], **audit)
            raise
        result.counts[name] = counts
        lake.write_audit(stage=name, status="SUCCEEDED", counts=counts,
                         quality=[r.asDict() for r in result.quality] if name == "silver" else None, **audit)
        if name == "gold":
            silver = lake.read_stage_audit(run_id, "silver")
            lake.mark_processed(file_id, path, run_id, silver.input_count if silver else counts["input"])
    return result


def _file_bronze(lake: Lakehouse, path: str, run_id: str, file_id: str, contract: TableContract, at: Column | None) -> dict[str, int]:
    raw = read_csv_snapshot(lake.spark, path)
    is_claim = contract is CLAIM_FILE
    if is_claim and path.rstrip("/").lower().endswith("/" + EXPANDED_FILE):
        require_columns(raw, [*contract.columns, *contract.optional.names], "expanded claim file")
    kept = project_contract(raw, contract.columns, contract.optional.names)
    rows = lake.publish(
        add_lineage(kept, run_id=run_id, source_system="broker_csv" if is_claim else "file_reference", source_object=path,
                    file_id=file_id, schema_version=2 if is_claim else 1, at=at),
        "bronze", contract.entity, run_id)
    return {"input": rows, "output": rows, "rejected": 0, "duplicate": 0}


def _file_silver(lake: Lakehouse, path: str, run_id: str, file_id: str, contract: TableContract, gate_when: str,
                 result: RunResult, at: Column | None) -> dict[str, int]:
    is_claim = contract is CLAIM_FILE
    typed = conform(lake.read_layer("bronze", contract.entity, file_id), contract)
    split = split_by_rules(
        typed, typed_claim_rules() if is_claim else reference_rules(contract), run_id=run_id, source=path,
        entity=contract.entity, record_columns=contract.columns, label=CLAIM_CONTRACT_LABEL if is_claim else None, at=at)
    accepted, rejected = lake.write_quarantine(split, "batch", contract.entity, run_id)
    result.counts["silver"] = {"input": accepted + rejected, "output": 0, "rejected": rejected, "duplicate": 0}
    rules = DATASET_RULES.get(contract.entity, ())
    if rules and gate_when == "before_dedup":
        result.quality = gate(evaluate(split.valid, contract.entity, rules))
    order = ["updated_at" if is_claim else "source_updated_at", "_record_hash"]
    staged = lake.stage(latest_per_key(split.valid, [contract.key], order), "silver", contract.entity, run_id)
    if rules and gate_when == "after_dedup":
        result.quality = gate(evaluate(lake.staged_frame(staged), contract.entity, rules))
    lake.release(staged)
    kept = staged.counts["rows"]
    return {"input": accepted + rejected, "output": kept, "rejected": rejected, "duplicate": accepted - kept}


def _file_gold(lake: Lakehouse, run_id: str, contract: TableContract, at: Column | None) -> dict[str, int]:
    current = lake.read_layer("silver", contract.entity)
    staged = [lake.stage(drop_sensitive(current, contract.sensitive, at), "gold", contract.gold_table, run_id)]
    rows = staged[0].counts["rows"]
    if contract is CLAIM_FILE:
        staged.append(_summary(lake, current, "claim_daily_summary", "broker_csv", run_id, at))
        if set(contract.optional.names) <= set(current.columns):
            staged += stage_enriched(lake, run_id, at)
    for one in staged:
        lake.release(one)
    return {"input": rows, "output": rows, "rejected": 0, "duplicate": 0}


def _summary(lake: Lakehouse, claims: DataFrame, table: str, system: str, run_id: str, at: Column | None) -> Staged:
    now = F.current_timestamp() if at is None else at
    summary = daily_summary(claims, SUMMARY_KEYS).withColumns({
        "_run_id": F.lit(run_id), "_source_system": F.lit(system), "_ingested_at": now, "_effective_at": now, "_schema_version": F.lit(2)})
    return lake.stage(summary, "gold", table, run_id)


# --- enrichment ---------------------------------------------------------------------------

# Silver inputs of the enriched fact, and the grouping keys of the marts.
ENRICHED_INPUTS = ("claim", "policies", "products", "customers", "product_master", "broker_master", "branch_master",
                   "claim_type_reference", "region_risk_reference", "vehicle_reference", "coverage_reference")
POLICY_KEYS = ("policy_id", "product_id", "product_type", "product_category", "broker_id", "broker_name", "branch_id",
               "branch_name", "broker_region_code", "currency_code")
BROKER_KEYS = ("broker_id", "broker_name", "branch_id", "branch_name", "broker_region_code", "currency_code")
ENRICHED_COLUMNS = (
    "claim_id", "claim_number", "policy_id", "customer_id", "product_id", "product_code", "product_name", "product_type",
    "annual_premium_amount", "product_category", "coverage_type", "product_default_excess", "max_sum_insured",
    "product_risk_tier", "broker_id", "broker_name", "years_experience", "broker_tier", "branch_id", "branch_name",
    "broker_state_code", "broker_region_code", "claim_type_id", "claim_type_code", "claim_type_name", "claim_category",
    "severity_band", "incident_region_code", "incident_region_name", "catastrophe_risk_score", "region_theft_risk_score",
    "weather_risk_score", "accident_risk_score", "natural_hazard_risk_score", "overall_risk_band", "coverage_code",
    "coverage_tier", "coverage_category", "deductible_aud", "coverage_limit_aud", "optional_flag", "vehicle_code",
    "vehicle_class", "model_year", "market_value_aud", "safety_rating", "repair_cost_band", "theft_risk_band",
    "vehicle_risk_category", "incident_date", "submitted_at", "claim_amount", "approved_amount", "claim_status",
    "currency_code", "outcome_severity", "high_risk_claim", "_run_id", "_ingested_at", "_effective_at",
)


def enrich_claims(tables: dict[str, DataFrame], at: Column | None = None) -> DataFrame:
    """Claims with policy, product, customer (required) and reference attributes (optional)."""
    same = lambda *names: {n: n for n in names}
    arms = [
        Dimension(tables["policies"], "policy_id", "policy_id", how="inner", columns={
            "product_id": "product_id", "annual_premium_amount": F.col("premium_amount").cast(MONEY)}),
        Dimension(tables["products"], "product_id", "product_id", how="inner", columns=same("product_code")),
        Dimension(tables["customers"], "customer_id", "customer_id", how="inner"),
        Dimension(tables["product_master"], "product_id", "product_id", columns={
            **same("product_name", "product_type", "product_category", "coverage_type", "max_sum_insured"),
            "product_default_excess": "default_excess", "product_risk_tier": "risk_tier"}),
        Dimension(tables["broker_master"], "broker_id", "broker_id", columns=same("broker_name", "years_experience", "broker_tier", "branch_id")),
        Dimension(tables["branch_master"], "branch_id", "branch_id", columns={
            "branch_name": "branch_name", "broker_state_code": "state_code", "broker_region_code": "region_code"}),
        Dimension(tables["claim_type_reference"], "claim_type_id", "claim_type_id", columns=same("claim_type_name", "claim_category", "severity_band")),
        Dimension(tables["region_risk_reference"], "region_code", "incident_region_code", columns={
            "incident_region_name": "region_name", "region_theft_risk_score": "theft_risk_score",
            **same("catastrophe_risk_score", "weather_risk_score", "accident_risk_score", "natural_hazard_risk_score", "overall_risk_band")}),
        Dimension(tables["vehicle_reference"], "vehicle_code", "vehicle_code", columns={
            **same("vehicle_class", "model_year", "market_value_aud", "safety_rating", "repair_cost_band", "theft_risk_band"),
            "vehicle_risk_category": "risk_category"}),
        Dimension(tables["coverage_reference"], "coverage_code", "coverage_code", columns=same(
            "coverage_tier", "coverage_category", "deductible_aud", "coverage_limit_aud", "optional_flag")),
    ]
    stamped = star_join(tables["claim"], arms).withColumn("_effective_at", F.current_timestamp() if at is None else at)
    return stamped.select(*ENRICHED_COLUMNS)


def stage_enriched(lake: Lakehouse, run_id: str, at: Column | None = None) -> list[Staged]:
    """Enriched fact, feature table and performance marts; nothing while an input is missing.

    The join runs once: the other three tables read the staged fact.
    """
    tables = {name: lake.table_or_none("silver", name) for name in ENRICHED_INPUTS}
    if any(frame is None for frame in tables.values()):
        return []
    now = F.current_timestamp() if at is None else at
    fact = lake.stage(enrich_claims(tables, at), "gold", "fact_claim_enriched", run_id)
    enriched = lake.staged_frame(fact)
    policies = lake.stage(policy_performance(enriched, POLICY_KEYS).withColumn("_effective_at", now), "gold", "policy_performance", run_id)
    brokers = broker_performance(lake.staged_frame(policies), BROKER_KEYS).withColumn("_effective_at", now)
    return [
        fact, policies,
        lake.stage(feature_projection(enriched), "gold", "claim_risk_features", run_id),
        lake.stage(brokers, "gold", "broker_performance", run_id),
    ]


# --- change log ---------------------------------------------------------------------------


def run_changes(lake: Lakehouse, root: str, run_id: str, stage: str = "all", at: Column | None = None) -> RunResult:
    """Take the landed change folders through the layers.

    Silver is all or nothing: every table is staged and judged before the first is released.
    """
    result = RunResult(run_id, "SUCCEEDED")
    audit = {"run_id": run_id, "pipeline": CHANGES, "source": root, "kind": "changes"}
    work = {"bronze": _changes_bronze, "silver": _changes_silver, "gold": _changes_gold}
    for name in _stages(stage):
        try:
            counts = work[name](lake, root, run_id, result, at)
        except GateFailure as failure:
            lake.write_audit(stage=name, status="FAILED", error=str(failure), quality=[r.asDict() for r in failure.results], **audit)
            raise
        except Exception as problem:
            lake.write_audit(stage=name, status="FAILED", error=str(problem)[:2000], **audit)
            raise
        result.counts[name] = counts
        lake.write_audit(stage=name, status="SUCCEEDED", counts=counts,
                         quality=[r.asDict() for r in result.quality] if name == "silver" else None, **audit)
    return result


def _changes_bronze(lake: Lakehouse, root: str, run_id: str, result: RunResult, at: Column | None) -> dict[str, int]:
    total = {"input": 0, "output": 0, "rejected": 0, "duplicate": 0}
    for name, raw in read_change_log(lake.spark, root, CHANGE_TABLES).items():
        source = f"{root.rstrip('/')}/{name}/"
        landed = envelope(raw, name, CHANGE_TABLES[name].key, at)
        lined = add_lineage(landed, run_id=run_id, source_system="insurance_oltp_dms", source_object=source, at=at)
        lined = lined.withColumn("_record_hash", F.col("_source_change_id"))
        split = split_by_rules(lined, change_rules(name), run_id=run_id, source=source, entity=name,
                               record_columns=raw.columns, label=f"{name}_cdc_contract_v2", at=at)
        accepted, rejected = lake.write_quarantine(split, "cdc", name, run_id)
        kept = lake.publish(drop_exact_repeats(split.valid, "_source_change_id"), "bronze", f"{name}_cdc", run_id)
        total["input"] += accepted + rejected
        total["output"] += kept
        total["rejected"] += rejected
        total["duplicate"] += accepted - kept
    return total


def _changes_silver(lake: Lakehouse, root: str, run_id: str, result: RunResult, at: Column | None) -> dict[str, int]:
    total = {"input": 0, "output": 0, "rejected": 0, "duplicate": 0}
    staged: list[Staged] = []
    judged: list[DataFrame] = []
    for name, contract in CHANGE_TABLES.items():
        log = lake.table_or_none("bronze", f"{name}_cdc")
        if log is None:
            continue
        size = log.agg(F.count(F.lit(1)).alias("changes"), F.count_distinct(contract.key).alias("keys")).first()
        newest = newest_changes(log, contract.key)
        one = lake.stage(conform(live(newest), contract), "silver", name, run_id)
        if name in DATASET_RULES:
            judged.append(evaluate(lake.staged_frame(one), name, DATASET_RULES[name]))
        staged.append(one)
        total["input"] += size.changes
        total["output"] += one.counts["rows"]
        total["duplicate"] += size.changes - size["keys"]
    result.quality = gate(judged)
    for one in staged:
        lake.release(one)
    return total


def change_integrity(lake: Lakehouse) -> tuple[DataFrame | None, DataFrame | None]:
    """Orphans of the source's foreign keys, and how unique its business keys are, over the Silver change tables.

    Tables that were never delivered are left out, with the keys that need them.
    """
    tables = {name: frame for name in CHANGE_TABLES if (frame := lake.table_or_none("silver", name)) is not None}
    keys = [k for k in FOREIGN_KEYS if k[0] in tables and k[2] in tables]
    unique = [evaluate(tables[name], name, [IsUnique(key)]) for name, key in UNIQUE_BUSINESS_KEYS.items() if name in tables]
    return integrity_report(tables, keys) if keys else None, reduce(DataFrame.unionByName, unique) if unique else None


def _changes_gold(lake: Lakehouse, root: str, run_id: str, result: RunResult, at: Column | None) -> dict[str, int]:
    return changes_to_gold(lake, run_id, at)


def changes_to_gold(lake: Lakehouse, run_id: str, at: Column | None = None) -> dict[str, int]:
    """Fact and daily summary of the claims in Silver."""
    contract = CHANGE_TABLES["claims"]
    claims = lake.read_layer("silver", "claims")
    fact = lake.stage(drop_sensitive(claims, contract.sensitive, at), "gold", contract.gold_table, run_id)
    summary = _summary(lake, claims, "claim_daily_summary_cdc", "insurance_oltp_dms", run_id, at)
    for one in (fact, summary):
        lake.release(one)
    rows = fact.counts["rows"]
    return {"input": rows, "output": rows, "rejected": 0, "duplicate": 0}
