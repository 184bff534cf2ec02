"""Incremental change runs against full runs over the same deliveries."""

import pytest

from perilake.operators.quality import GateFailure
from perilake.plans.contracts import CHANGE_TABLES
from perilake.plans.increments import run_change_increment, state_of, taken_files
from perilake.plans.ingestion import run_changes
from perilake.sources.tables import Lakehouse
from test_ingestion import T0, change, land, seed, write_csv

T1, T2, T3 = "2026-09-05 00:00:00", "2026-09-06 00:00:00", "2026-08-15 00:00:00"


def plain(frame, contract):
    return sorted(tuple(str(r[c]) for c in contract.columns) for r in frame.collect())


@pytest.fixture()
def other(spark, tmp_path):
    made = Lakehouse(spark, str(tmp_path / "full"), f"f{abs(hash(str(tmp_path))) % 10**8}_")
    yield made
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"DROP DATABASE IF EXISTS {made.database(layer)} CASCADE")


def second():
    """A later delivery: an update, a late older change, a delete, a revival, a new row and a repeat of an old file's row."""
    first = seed()
    return {
        "claims": [change("claims", "clm_7002", "U", T1, **{k: v for k, v in first["claims"][1].items() if k not in ("claim_id", "Op", "_dms_timestamp", "claim_status")}, claim_status="APPROVED"),
                   change("claims", "clm_7001", "U", T3, claim_number="old", policy_id="pol_6001", customer_id="cus_4001", claim_amount="1", submitted_at=T0, incident_date="2026-01-01"),
                   dict(first["claims"][0])],
        "customers": [change("customers", "cus_4003", "D", T1), change("customers", "cus_9", "I", T2, first_name="New")],
    }


def test_two_deliveries_equal_a_full_run(lake, other, tmp_path, spark):
    root = land(tmp_path, seed())
    one = run_change_increment(lake, root, "d1", buckets=8)
    assert one.counts["bronze"] == {"input": 14, "output": 14, "rejected": 0, "duplicate": 0}
    assert one.counts["silver"] == {"input": 14, "output": 11, "rejected": 0, "duplicate": 2} and one.counts["gold"]["output"] == 3
    for name, rows in second().items():
        write_csv(tmp_path / "cdc" / name / "second.csv", rows)
    before = {name: state_of(lake, name, 8).current() for name in CHANGE_TABLES}
    two = run_change_increment(lake, root, "d2", buckets=8)
    assert two.counts["bronze"] == {"input": 5, "output": 5, "rejected": 0, "duplicate": 0}
    assert two.counts["silver"]["input"] == 5 and two.counts["silver"]["duplicate"] == 2
    run_changes(other, root, "full")
    for name, contract in CHANGE_TABLES.items():
        assert plain(lake.read_layer("silver", name), contract) == plain(other.read_layer("silver", name), contract), name
    for table in ("fact_claim_cdc", "claim_daily_summary_cdc"):
        columns = [c for c in lake.read_layer("gold", table).columns if not c.startswith("_")]  # full runs also keep the feed's own columns
        assert sorted(map(str, lake.read_layer("gold", table).select(columns).collect())) == sorted(map(str, other.read_layer("gold", table).select(columns).collect()))
    # Copy on write: untouched buckets and tables keep their generation.
    for name in ("products", "policies", "payments"):
        assert state_of(lake, name, 8).current() == before[name]
    assert state_of(lake, "customers", 8).current()[0] == 2
    # The same run again, and the same rows in a file of another name.
    again = run_change_increment(lake, root, "d3", buckets=8)
    assert again.status == "DUPLICATE" and again.counts["bronze"]["input"] == 0
    assert state_of(lake, "customers", 8).current()[0] == 2
    write_csv(tmp_path / "cdc" / "customers" / "third.csv", second()["customers"])
    rows = plain(lake.read_layer("silver", "customers"), CHANGE_TABLES["customers"])
    assert run_change_increment(lake, root, "d4", buckets=8).counts["silver"]["duplicate"] == 2
    assert plain(lake.read_layer("silver", "customers"), CHANGE_TABLES["customers"]) == rows
    assert taken_files(lake).count() == 8


def test_second_delivery_reads_its_own_files_and_touched_buckets(lake, tmp_path, spark):
    state = state_of(lake, "customers", 16)
    root = land(tmp_path, {"customers": [change("customers", f"c{i}", first_name="a") for i in range(200)]})
    run_change_increment(lake, root, "d1", buckets=16)
    write_csv(tmp_path / "cdc" / "customers" / "second.csv", [change("customers", "c7", "U", T1, first_name="b")])
    run_change_increment(lake, root, "d2", buckets=16)
    bronze = spark.read.parquet(f"{lake.root}/bronze/customers_cdc/delivery=d2")
    assert bronze.count() == 1
    _, entries = state.current()
    changed = [e for e in entries if e.generation.startswith("d2")]
    assert len(entries) == 16 and len(changed) == 1
    files = state.rows(entries, [changed[0].bucket]).inputFiles()
    assert len(files) == 1 and f"bucket={changed[0].bucket}" in files[0]
    # The state side of the fold is not shuffled: the only exchanges are those of the delivery.
    changes = lake.spark.read.parquet(f"{lake.root}/bronze/customers_cdc/delivery=d2").drop("_extra")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = state.folded(changes, entries, [changed[0].bucket])
        plan = folded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    scans = [line for line in lines if "Scan parquet" in line]
    assert len(scans) == 2 and sum("Bucketed: true" in s for s in scans) == 1
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(i for i in range(at) if "SortMergeJoin" in lines[i])
    assert not any("Exchange" in line for line in lines[join:at])
    assert spark.table(f"{lake.database('silver')}.customers").filter("customer_id = 'c7'").first().first_name == "b"


def test_failed_gate_commits_nothing_and_is_repeated(lake, tmp_path):
    root = land(tmp_path, seed())
    run_change_increment(lake, root, "d1", buckets=4)
    bad = change("policies", "pol_bad", at=T1, product_id="p", premium_amount="1", start_date="2026-01-01", end_date="2027-01-01")
    bad["customer_id"] = None
    write_csv(tmp_path / "cdc" / "policies" / "bad.csv", [bad])
    write_csv(tmp_path / "cdc" / "customers" / "new.csv", [change("customers", "cus_new", at=T1)])
    with pytest.raises(GateFailure, match="policies"):
        run_change_increment(lake, root, "d2", buckets=4)
    assert state_of(lake, "customers", 4).current()[0] == 1 and lake.read_layer("silver", "customers").count() == 3
    assert lake.read_stage_audit("d2", "silver").status == "FAILED"
    write_csv(tmp_path / "cdc" / "policies" / "bad.csv", [{**bad, "customer_id": "cus_4001"}])
    run_change_increment(lake, root, "d3", buckets=4)
    assert lake.read_layer("silver", "customers").count() == 4 and lake.read_layer("silver", "policies").count() == 4
    # Partitions of the failed run and of replaced buckets go; the current rows stay.
    state = state_of(lake, "policies", 4)
    assert state.expire(keep=1) > 0 and lake.read_layer("silver", "policies").count() == 4 and state.expire(keep=1) == 0


def test_quarantine_extra_columns_and_full_lake(lake, other, tmp_path, spark):
    root = land(tmp_path, {"payments": [{**change("payments", "p1", policy_id="pol", payment_amount="5"), "note": "x"}, {**change("payments", "p2", "X"), "note": "y"}]})
    result = run_change_increment(lake, root, "d1", buckets=4)
    assert result.counts["bronze"] == {"input": 2, "output": 1, "rejected": 1, "duplicate": 0}
    bronze = spark.read.parquet(f"{lake.root}/bronze/payments_cdc/delivery=d1").first()
    assert bronze._extra == {"note": "x"} and "gold" not in result.counts
    assert spark.read.json(lake.quarantine_path("cdc", "payments", "d1")).count() == 1
    for stage in ("bronze", "silver"):
        run_changes(other, root, "full", stage=stage)
    run_change_increment(other, root, "d1", buckets=4)  # a lake of full runs goes on incrementally
    assert other.read_layer("silver", "payments").select("payment_id").collect() == lake.read_layer("silver", "payments").select("payment_id").collect()
