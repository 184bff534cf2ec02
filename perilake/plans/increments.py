"""Incremental change-log runs: each delivery reads its own files and rewrites the buckets it touches.

:func:`perilake.plans.ingestion.run_changes` replays the whole log; here a ledger remembers the
files that were taken, Bronze is appended, and Silver is the live part of a bucketed state
(:mod:`perilake.sources.state`). The result is the same: equal to a full run over all deliveries so far.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.operators.changes import OPERATION_COLUMNS, ORDER_COLUMNS, envelope
from perilake.operators.contracts import TableContract, add_lineage, conform, split_by_rules
from perilake.operators.dedup import drop_exact_repeats
from perilake.operators.quality import GateFailure, gate
from perilake.plans.contracts import CHANGE_TABLES, DATASET_RULES, change_rules
from perilake.plans.ingestion import CHANGES, RunResult, changes_to_gold
from perilake.sources.files import landed_files, read_change_files
from perilake.sources.state import Fold, StateTable
from perilake.sources.tables import Lakehouse

TAKEN_DDL = "table string, path string, modified timestamp, length long, run_id string"


def state_of(lake: Lakehouse, name: str, buckets: int = 64) -> StateTable:
    return StateTable(lake, name, CHANGE_TABLES[name].key, buckets, tuple(DATASET_RULES.get(name, ())))


def taken_files(lake: Lakehouse) -> DataFrame:
    """Ledger of the change files that earlier runs took."""
    try:
        return lake.spark.read.schema(TAKEN_DDL).parquet(_ledger(lake))
    except AnalysisException as problem:
        if (problem.getCondition() or "").startswith("PATH_NOT_FOUND"):
            return lake.spark.createDataFrame([], TAKEN_DDL)
        raise


def _ledger(lake: Lakehouse) -> str:
    return f"{lake.root}/control/change_files"


def new_deliveries(lake: Lakehouse, root: str, run_id: str) -> dict[str, list[tuple]]:
    """Landed files that no run took yet, per table. A file that was written again counts as new."""
    found: dict[str, list[tuple]] = {}
    known = taken_files(lake)
    for name in CHANGE_TABLES:
        landed = landed_files(lake.spark, root, name)
        if landed is None:
            continue
        fresh = landed.join(known.filter(F.col("table") == name).select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
        rows = fresh.collect()  # a listing: the driver plans the scan of these files anyway
        if rows:
            found[name] = [(name, r.path, r.modified, r.length, run_id) for r in rows]
    return found


def landed_changes(raw: DataFrame, contract: TableContract, at: Column | None = None) -> DataFrame:
    """Contract columns of landed changes as text with their envelope; all other columns in ``_extra``.

    The columns of Bronze stay the same whatever a delivery adds.
    """
    enveloped = envelope(raw, contract.entity, contract.key, at)
    other = [c for c in raw.columns if c not in contract.columns and c not in (*OPERATION_COLUMNS, *ORDER_COLUMNS)]
    extra = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c)) for c in other])) if other else F.lit(None)
    filled = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in contract.columns]
    return enveloped.select(*filled, "_operation", "_source_order", "_source_change_id", extra.cast("map<string,string>").alias("_extra"))


def run_change_increment(lake: Lakehouse, root: str, run_id: str, at: Column | None = None, buckets: int = 64) -> RunResult:
    """Take the change files that landed since the last run through the layers.

    All tables are folded and judged before the first is committed. The ledger is written last: a run
    that fails before it is repeated with the same files, and folding changes again changes nothing.
    Without new files the run is an audited no-op that reads no table.
    """
    result = RunResult(run_id, "SUCCEEDED")
    audit = {"run_id": run_id, "pipeline": CHANGES, "source": root, "kind": "changes"}
    files = new_deliveries(lake, root, run_id)
    if not files:
        result.status = "DUPLICATE"
        for stage in ("bronze", "silver", "gold"):
            result.counts[stage] = {"input": 0, "output": 0, "rejected": 0, "duplicate": 0}
            lake.write_audit(stage=stage, status="DUPLICATE", counts=result.counts[stage], **audit)
        return result
    stage = "bronze"
    try:
        deliveries = {name: one for name in files if (one := _to_bronze(lake, root, name, [f[1] for f in files[name]], run_id, result, at)) is not None}
        lake.write_audit(stage=stage, status="SUCCEEDED", counts=result.counts[stage], **audit)
        stage = "silver"
        _to_silver(lake, deliveries, run_id, result, buckets)
        lake.write_audit(stage=stage, status="SUCCEEDED", counts=result.counts[stage], quality=[r.asDict() for r in result.quality], **audit)
        stage = "gold"
        if "claims" in deliveries:
            result.counts[stage] = changes_to_gold(lake, run_id, at)
            lake.write_audit(stage=stage, status="SUCCEEDED", counts=result.counts[stage], **audit)
    except GateFailure as failure:
        lake.write_audit(stage=stage, status="FAILED", error=str(failure), quality=[r.asDict() for r in failure.results], **audit)
        raise
    except Exception as problem:
        lake.write_audit(stage=stage, status="FAILED", error=str(problem)[:2000], **audit)
        raise
    listed = [row for rows in files.values() for row in rows]
    lake.spark.createDataFrame(listed, TAKEN_DDL).coalesce(1).write.mode("append").parquet(_ledger(lake))
    return result


def _to_bronze(lake: Lakehouse, root: str, name: str, paths: list[str], run_id: str, result: RunResult, at: Column | None) -> DataFrame | None:
    contract = CHANGE_TABLES[name]
    counts = result.counts.setdefault("bronze", {"input": 0, "output": 0, "rejected": 0, "duplicate": 0})
    raw = read_change_files(lake.spark, paths, contract.key)
    if raw is None:
        return None
    source = f"{root.rstrip('/')}/{name}/"
    lined = add_lineage(landed_changes(raw, contract, at), run_id=run_id, source_system="insurance_oltp_dms", source_object=source, at=at)
    lined = lined.withColumn("_record_hash", F.col("_source_change_id"))
    split = split_by_rules(lined, change_rules(name), run_id=run_id, source=source, entity=name,
                           record_columns=[*contract.columns, "_operation", "_extra"], label=f"{name}_cdc_contract_v2", at=at)
    accepted, rejected = lake.write_quarantine(split, "cdc", name, run_id)
    folder = f"{lake.root}/bronze/{name}_cdc/delivery={run_id}"
    drop_exact_repeats(split.valid, "_source_change_id").write.format(lake.table_format).mode("overwrite").save(folder)
    delivery = lake.spark.read.format(lake.table_format).load(folder)
    kept = delivery.count()
    for key, n in (("input", accepted + rejected), ("output", kept), ("rejected", rejected), ("duplicate", accepted - kept)):
        counts[key] += n
    return delivery


def _to_silver(lake: Lakehouse, deliveries: dict[str, DataFrame], run_id: str, result: RunResult, buckets: int) -> None:
    counts = result.counts["silver"] = {"input": 0, "output": 0, "rejected": 0, "duplicate": 0}
    folds: list[tuple[StateTable, Fold]] = []
    for name, delivery in deliveries.items():
        state = state_of(lake, name, buckets)
        fold = state.fold(conform(delivery.drop("_extra"), CHANGE_TABLES[name]), run_id)
        folds.append((state, fold))
        counts["input"] += fold.accepted
        counts["output"] += sum(e.live for e in fold.entries)
        counts["duplicate"] += fold.accepted - fold.won
    result.quality = gate([j for state, fold in folds if (j := state.judged(fold)) is not None])
    for state, fold in folds:
        if fold.touched:
            state.commit(fold)
            state.publish_view([c for c in lake.spark.table(state.name).columns if c not in ("generation", "bucket")])
