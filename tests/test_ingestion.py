"""Batch files and change logs end to end, with their golden results."""

import csv

import pytest
from pyspark.sql import functions as F

from perilake.operators.audit import audit_errors
from perilake.operators.contracts import SchemaMismatch
from perilake.operators.quality import GateFailure
from perilake.plans.contracts import CHANGE_TABLES, CLAIM_FILE, REFERENCES
from perilake.plans.ingestion import UnsupportedFile, change_integrity, dataset_of, run_changes, run_file

CLAIM = dict(
    claim_id="clm-1", claim_number="BRK-1", policy_id="pol_6001", customer_id="cus_4001", claim_status="submitted",
    incident_date="2026-09-01", submitted_at="2026-09-02T00:00:00Z", claim_amount="100.00", approved_amount="",
    currency_code="aud", description="a dent", updated_at="2026-09-02T01:00:00Z")


def claim(**changes):
    return {**CLAIM, **changes}


def write_csv(path, rows, columns=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as out:
        writer = csv.DictWriter(out, fieldnames=list(columns or rows[0]), extrasaction="ignore", restval="")
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def audit(lake, run_id, stage):
    return lake.read_stage_audit(run_id, stage)


def test_dispatch_by_file_name():
    assert dataset_of("s3://x/broker_claims_2026.csv") == "claim"
    assert dataset_of("/a/Branch_Master.csv") == "branch_master"
    with pytest.raises(UnsupportedFile):
        dataset_of("/a/other.csv")


def test_happy_path_totals(lake, tmp_path):
    path = write_csv(tmp_path / "in/broker_claims_a.csv", [
        claim(claim_id="a", claim_status="approved", claim_amount="840.50", approved_amount="800", extra="x"),
        claim(claim_id="b", claim_amount="1250.00"),
        claim(claim_id="c", claim_status=" under_review ", claim_amount="3200.00"),
    ], [*CLAIM, "extra"])
    result = run_file(lake, path, "run-1")
    assert result.status == "SUCCEEDED"
    summary = {r.claim_status: (str(r.total_claim_amount), str(r.total_approved_amount), r.claim_count)
               for r in lake.read_layer("gold", "claim_daily_summary").collect()}
    assert summary == {"APPROVED": ("840.50", "800.00", 1), "SUBMITTED": ("1250.00", "0.00", 1), "UNDER_REVIEW": ("3200.00", "0.00", 1)}
    fact = lake.read_layer("gold", "fact_claim")
    assert "description" not in fact.columns and "extra" not in fact.columns and "_effective_at" in fact.columns
    assert {r.currency_code for r in fact.collect()} == {"AUD"}
    assert lake.table_or_none("gold", "fact_claim_enriched") is None


def test_failing_gate_leaves_silver_and_gold_untouched(lake, tmp_path):
    path = write_csv(tmp_path / "in/broker_claims_dq.csv", [
        claim(claim_id="CLM-DQ-001", claim_amount="1250.00"), claim(claim_id="CLM-DQ-001", claim_amount="1300.00"),
        claim(claim_id="CLM-DQ-002", claim_amount="850.00"), claim(claim_id="CLM-DQ-003", claim_amount="-25.00")])
    with pytest.raises(GateFailure) as failure:
        run_file(lake, path, "run-dq")
    judged = {r.rule: (r.outcome, r.metric) for r in failure.value.results}
    assert judged['IsUnique "claim_id"'] == ("Failed", 0.333333)
    assert sum(o == "Passed" for o, _ in judged.values()) == 3 and len(judged) == 4
    assert lake.table_or_none("silver", "claim") is None and lake.table_or_none("gold", "fact_claim") is None
    silver = audit(lake, "run-dq", "silver")
    assert (silver.status, silver.input_count, silver.rejected_count, silver.reconciliation_passed) == ("FAILED", 4, 1, False)
    assert lake.ledger().count() == 0


def test_in_file_duplicate_collapses_when_gated_after_dedup(lake, tmp_path):
    path = write_csv(tmp_path / "in/broker_claims_v.csv", [
        claim(claim_amount="100"), claim(claim_amount="120", updated_at="2026-09-03T01:00:00Z")])
    result = run_file(lake, path, "run-v", gate_when="after_dedup")
    assert result.counts["silver"] == {"input": 2, "output": 1, "rejected": 0, "duplicate": 1}
    assert str(lake.read_layer("silver", "claim").first().claim_amount) == "120.00"
    held = lake.read_layer("silver", "claim")
    other = write_csv(tmp_path / "in/broker_claims_w.csv", [claim(claim_amount="7")])
    run_file(lake, other, "run-v")  # the same run id again must not touch the version in use
    assert str(held.first().claim_amount) == "120.00"
    assert str(lake.read_layer("silver", "claim").first().claim_amount) == "7.00"


def test_bad_recovery_duplicate_drill(lake, tmp_path, spark):
    baseline = [claim(claim_id=f"c{i}") for i in range(5)]
    bad = write_csv(tmp_path / "bad/broker_claims_x.csv", [*baseline, claim(claim_id="new", claim_amount="-1")])
    good = write_csv(tmp_path / "good/broker_claims_x.csv", [*baseline, claim(claim_id="new", claim_amount="1")])
    copy = write_csv(tmp_path / "copy/broker_claims_other_name.csv", [*baseline, claim(claim_id="new", claim_amount="1")])
    expected = {("r1", bad): (6, 5, 1, 0), ("r2", good): (6, 6, 0, 0), ("r3", copy): (6, 0, 0, 6)}
    for (run_id, path), counts in expected.items():
        run_file(lake, path, run_id)
        a = audit(lake, run_id, "silver")
        assert (a.input_count, a.output_count, a.rejected_count, a.duplicate_count) == counts
        assert a.reconciliation_passed
    assert audit(lake, "r1", "silver").quality_score == round(5 / 6, 6)
    assert audit(lake, "r3", "gold").status == "DUPLICATE"
    assert lake.read_layer("gold", "fact_claim").count() == 6
    quarantined = spark.read.json(lake.quarantine_path("batch", "claim", "r1"))
    assert quarantined.select("entity", F.col("failed_rules")[0]).collect() == [("claim", "claim_contract_v2")]
    frame = spark.read.parquet(f"{lake.root}/control/audit/run=r2")
    assert all(not r[0] for r in frame.select(audit_errors(frame)).collect())


def test_missing_columns_fail_fast(lake, tmp_path):
    path = write_csv(tmp_path / "in/broker_claims_m.csv", [claim()], [c for c in CLAIM if c != "policy_id"])
    with pytest.raises(SchemaMismatch, match="missing columns: policy_id"):
        run_file(lake, path, "run-m")
    assert audit(lake, "run-m", "bronze").status == "FAILED"
    expanded = write_csv(tmp_path / "in/broker_claims.csv", [claim()])
    with pytest.raises(SchemaMismatch, match="broker_id"):
        run_file(lake, expanded, "run-e")


# --- change log ---------------------------------------------------------------------------

T0, T1 = "2026-09-01 00:00:00", "2026-09-02 00:00:00"


def change(table, key, op="I", at=T0, **values):
    base = {c: "" for c in CHANGE_TABLES[table].columns}
    stamps = {c: at for c in base if c in ("created_at", "updated_at")}
    return {"Op": op, "_dms_timestamp": at, **base, **stamps, CHANGE_TABLES[table].key: key, **values}


def seed():
    claims = dict(policy_id="pol_6001", customer_id="cus_4001", incident_date="2026-08-01", submitted_at=T0, currency_code="AUD")
    policies = dict(policy_status="ACTIVE", start_date="2026-01-01", end_date="2027-01-01", currency_code="AUD")
    return {
        "customers": [change("customers", f"cus_400{i}", first_name="F", last_name="L", customer_status="ACTIVE") for i in (1, 2, 3)],
        "products": [change("products", "prd_5001", product_code="HOME", effective_from="2026-01-01"),
                     change("products", "prd_5002", product_code="AUTO", effective_from="2026-01-01")],
        "policies": [change("policies", "pol_6001", customer_id="cus_4001", product_id="prd_5001", premium_amount="1200.00", policy_number="P1", **policies),
                     change("policies", "pol_6002", customer_id="cus_4002", product_id="prd_5002", premium_amount="900.00", policy_number="P2", **policies),
                     change("policies", "pol_6003", customer_id="cus_4003", product_id="prd_5001", premium_amount="1100.00", policy_number="P3", **policies)],
        "claims": [change("claims", "clm_7001", claim_status="SUBMITTED", claim_amount="500.00", **claims),
                   change("claims", "clm_7002", claim_status="UNDER_REVIEW", claim_amount="750.00", **claims),
                   change("claims", "clm_7003", "I", T1, claim_status="SUBMITTED", claim_amount="300.00", **claims),
                   change("claims", "clm_7001", "U", T1, claim_status="APPROVED", claim_amount="500.00", approved_amount="450.00", **claims)],
        "payments": [change("payments", "pay_8001", policy_id="pol_6001", payment_amount="100.00", payment_status="SUCCEEDED"),
                     change("payments", "pay_8001", "D", T1)],
    }


def land(tmp_path, tables):
    for name, changes in tables.items():
        write_csv(tmp_path / "cdc" / name / "load.csv", changes)
    return str(tmp_path / "cdc")


def test_change_log_golden_run(lake, tmp_path):
    result = run_changes(lake, land(tmp_path, seed()), "cdc-1")
    assert result.counts["bronze"] == {"input": 14, "output": 14, "rejected": 0, "duplicate": 0}
    assert result.counts["silver"] == {"input": 14, "output": 11, "rejected": 0, "duplicate": 2}
    assert result.counts["gold"]["output"] == 3
    outcomes = [r.outcome for r in result.quality]
    assert outcomes.count("Passed") == 10 and outcomes.count("Failed") == 0 and outcomes.count("Skipped") == 3
    claims = {r.claim_id: r for r in lake.read_layer("gold", "fact_claim_cdc").collect()}
    assert (claims["clm_7001"].claim_status, str(claims["clm_7001"].approved_amount)) == ("APPROVED", "450.00")
    assert "description" not in claims["clm_7001"] and "_operation" not in claims["clm_7001"]
    assert lake.read_layer("silver", "payments").count() == 0
    assert lake.read_layer("gold", "claim_daily_summary_cdc").count() == 3
    orphans, unique = change_integrity(lake)
    assert sum(r.orphan_rows for r in orphans.collect()) == 0 and orphans.count() == 6
    assert {r.entity: r.outcome for r in unique.collect()} == {"products": "Passed", "policies": "Passed", "claims": "Failed"}  # the seed gives no claim numbers
    again = run_changes(lake, str(tmp_path / "cdc"), "cdc-2")
    assert again.counts == result.counts


def test_bad_changes_are_quarantined_and_repeats_counted(lake, tmp_path, spark):
    tables = seed()
    tables["claims"] += [dict(tables["claims"][0]), change("claims", "clm_x", "X"), change("claims", "clm_y", claim_amount="-5", submitted_at=T0, incident_date="2026-08-01")]
    result = run_changes(lake, land(tmp_path, tables), "cdc-bad")
    assert result.counts["bronze"] == {"input": 17, "output": 14, "rejected": 2, "duplicate": 1}
    rejected = spark.read.json(lake.quarantine_path("cdc", "claims", "cdc-bad"))
    assert rejected.count() == 2
    assert {r[0][0] for r in rejected.select("failed_rules").collect()} == {"claims_cdc_contract_v2"}


def test_no_table_is_released_when_one_gate_fails(lake, tmp_path):
    tables = seed()
    run_changes(lake, land(tmp_path, tables), "ok")
    before = lake.read_layer("silver", "customers").count()
    tables["policies"].append(change("policies", "pol_bad", customer_id="", product_id="p", premium_amount="1", start_date="2026-01-01", end_date="2027-01-01"))
    tables["policies"][-1]["customer_id"] = None
    tables["customers"].append(change("customers", "cus_new"))
    write_csv(tmp_path / "cdc" / "policies" / "load.csv", tables["policies"])
    write_csv(tmp_path / "cdc" / "customers" / "load.csv", tables["customers"])
    with pytest.raises(GateFailure, match="policies"):
        run_changes(lake, str(tmp_path / "cdc"), "bad")
    assert lake.read_layer("silver", "customers").count() == before
    assert lake.read_stage_audit("bad", "silver").status == "FAILED"


def test_absent_and_keyless_folders_are_skipped(lake, tmp_path):
    root = land(tmp_path, {"customers": seed()["customers"]})
    write_csv(tmp_path / "cdc" / "payments" / "x.csv", [{"other": "1"}])
    assert run_changes(lake, root, "part", stage="bronze").counts["bronze"]["input"] == 3
    assert lake.table_or_none("bronze", "payments_cdc") is None


# --- references and enrichment --------------------------------------------------------------


def reference_row(name, key, **values):
    base = {c: "" for c in REFERENCES[name].columns}
    return {**base, "source_updated_at": "2026-01-01T00:00:00Z", REFERENCES[name].key: key, **values}


def load_references(lake, tmp_path):
    content = {
        "product_master": [reference_row("product_master", "prd_5001", product_type="HOME", product_category="PROPERTY", risk_tier="LOW", product_name="Home")],
        "broker_master": [reference_row("broker_master", "b1", branch_id="br1", broker_name="Old", source_updated_at="2025-01-01T00:00:00Z"),
                          reference_row("broker_master", "b1", branch_id="br1", broker_name="New", years_experience="7", commission_rate="0.1"),
                          reference_row("broker_master", "  ")],
        "branch_master": [reference_row("branch_master", "br1", branch_name="Main", region_code="R1", state_code="NSW")],
        "claim_type_reference": [reference_row("claim_type_reference", "ct1", claim_category="FIRE")],
        "region_risk_reference": [reference_row("region_risk_reference", "R1", overall_risk_band="HIGH", weather_risk_score="0.4")],
        "vehicle_reference": [reference_row("vehicle_reference", "v1", model_year="2020")],
        "coverage_reference": [reference_row("coverage_reference", "cv1", coverage_tier="BASIC", deductible_aud="500")],
    }
    for name, content_rows in content.items():
        run_file(lake, write_csv(tmp_path / "ref" / f"{name}.csv", content_rows), f"ref-{name}")


def check_broker_reference(lake, spark):
    brokers = lake.read_layer("gold", "dim_broker")
    assert [(r.broker_name, r.years_experience) for r in brokers.collect()] == [("New", 7)]
    assert "_source_object" not in brokers.columns
    a = audit(lake, "ref-broker_master", "silver")
    assert (a.input_count, a.output_count, a.rejected_count, a.duplicate_count) == (3, 1, 1, 1)
    bad = spark.read.json(lake.quarantine_path("batch", "broker_master", "ref-broker_master")).first()
    assert bad.failed_rules == ["broker_id must not be null or blank"]


def test_references_enrichment_and_performance(lake, tmp_path, spark):
    run_changes(lake, land(tmp_path, seed()), "cdc")
    load_references(lake, tmp_path)
    check_broker_reference(lake, spark)
    links = dict(broker_id="b1", claim_type_id="ct1", claim_type_code="F", incident_region_code="R1", coverage_code="cv1",
                 vehicle_code="", outcome_severity="LOW", high_risk_claim="1")
    path = write_csv(tmp_path / "in/broker_claims.csv", [
        claim(claim_id="a", claim_amount="100", approved_amount="60", **links),
        claim(claim_id="b", claim_amount="50", approved_amount="", **links),
        claim(claim_id="c", policy_id="pol_6003", customer_id="cus_4003", claim_amount="10", approved_amount="10", **links),
        claim(claim_id="d", policy_id="unknown", **links)])
    run_file(lake, path, "claims")
    enriched = lake.read_layer("gold", "fact_claim_enriched")
    assert enriched.count() == 3 and len(enriched.columns) == 60
    first = enriched.filter("claim_id = 'a'").first()
    assert (first.broker_name, first.branch_name, first.claim_category, first.vehicle_class) == ("New", "Main", "FIRE", None)
    policies = {r.policy_id: r for r in lake.read_layer("gold", "policy_performance").collect()}
    assert (str(policies["pol_6001"].annual_premium_amount), policies["pol_6001"].claim_count, str(policies["pol_6001"].total_approved_amount)) == ("1200.00", 2, "60.00")
    assert float(policies["pol_6001"].loss_ratio) == 0.05
    broker = lake.read_layer("gold", "broker_performance").collect()
    assert len(broker) == 1 and (broker[0].active_policy_count, str(broker[0].total_annual_premium), broker[0].claim_count) == (2, "2300.00", 3)
    features = lake.read_layer("gold", "claim_risk_features")
    assert not {"approved_amount", "claim_status", "outcome_severity", "updated_at"} & set(features.columns)
    assert features.filter("vehicle_age IS NOT NULL").count() == 0
    assert set(CLAIM_FILE.optional.names) <= set(lake.read_layer("silver", "claim").columns)
