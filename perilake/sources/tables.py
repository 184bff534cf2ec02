"""Lakehouse tables: layers, snapshot publication, quarantine, audit and the file ledger."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from perilake.operators.audit import AUDIT_DDL, TERMINAL_STATUSES, finish_audit
from perilake.operators.contracts import Split

LAYERS = ("bronze", "silver", "gold")
LEDGER_DDL = "source_file_id string, source string, run_id string, input_count long, status string, recorded_at timestamp"


@dataclass(frozen=True)
class Staged:
    """A written snapshot that readers do not see yet."""

    layer: str
    table: str
    folder: str
    counts: dict[str, int]


@dataclass(frozen=True)
class Lakehouse:
    """Where tables, quarantine and control data live. ``root`` must be a shared folder."""

    spark: SparkSession
    root: str
    prefix: str = ""
    table_format: str = "parquet"

    # --- tables ---------------------------------------------------------------------

    def database(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return f"{self.prefix}{layer}"

    def name(self, layer: str, table: str) -> str:
        return f"{self.database(layer)}.{table}"

    def table_or_none(self, layer: str, table: str) -> DataFrame | None:
        full = self.name(layer, table)
        return self.spark.table(full) if self.spark.catalog.tableExists(full) else None

    def read_layer(self, layer: str, table: str, source_file_id: str | None = None) -> DataFrame:
        """Layer table, optionally only the rows of one landed file (filter reaches the scan)."""
        frame = self.spark.table(self.name(layer, table))
        return frame if source_file_id is None else frame.filter(F.col("_source_file_id") == source_file_id)

    def stage(self, frame: DataFrame, layer: str, table: str, run_id: str, counts: Mapping[str, Column] | None = None) -> Staged:
        """Write a full snapshot to a folder of its own, not visible to readers yet.

        ``counts`` are aggregates collected while writing, so no second pass is needed. The folder
        is new for every try: repeating a run never writes into the version readers are on.
        """
        folder = f"{self.root}/{layer}/{table}/{run_id}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        measured = {"rows": F.count(F.lit(1)), **(counts or {})}
        observed = frame.observe(seen, *[c.alias(n) for n, c in measured.items()])
        observed.write.format(self.table_format).mode("overwrite").save(folder)
        return Staged(layer, table, folder, dict(seen.get))

    def staged_frame(self, staged: Staged) -> DataFrame:
        return self.spark.read.format(self.table_format).load(staged.folder)

    def release(self, staged: Staged) -> None:
        """Point the table, a view over one snapshot folder, at a staged snapshot.

        The view is replaced in one step of the catalog, whatever the schema: readers see the
        old version or the new one, never a missing table. A failed write changes nothing, and a
        table may be replaced from a query that reads it.
        """
        full = self.name(staged.layer, staged.table)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database(staged.layer)}")
        known = self.spark.catalog.tableExists(full)
        if known and self.spark.catalog.getTable(full).tableType != "VIEW":
            self.spark.sql(f"DROP TABLE {full}")  # of an older lake, once; external: the files stay
        self.spark.sql(f"CREATE OR REPLACE VIEW {full} AS SELECT * FROM {self.table_format}.`{staged.folder}`")

    def expire_snapshots(self, layer: str, table: str, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` snapshot folders of a table, and never the one readers are on.

        A reader that began before keeps its folder as long as it is among them. Folders of failed tries go too.
        """
        spark = self.spark
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{layer}/{table}")
        files = base.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration())
        if not files.exists(base):
            return []
        found = sorted(((f.getModificationTime(), f.getPath()) for f in files.listStatus(base) if f.isDirectory()), key=lambda x: (x[0], str(x[1])))
        frame = self.table_or_none(layer, table)
        used = {name.rsplit("/", 2)[-2] for name in frame.inputFiles()} if frame is not None else set()
        old = [path for _, path in found[: max(0, len(found) - keep)] if path.getName() not in used]
        for path in old:
            files.delete(path, True)
        return [path.getName() for path in old]

    def publish(self, frame: DataFrame, layer: str, table: str, run_id: str) -> int:
        """Replace a table with a full snapshot; returns its row count."""
        staged = self.stage(frame, layer, table, run_id)
        self.release(staged)
        return staged.counts["rows"]

    # --- quarantine -------------------------------------------------------------------

    def quarantine_path(self, flow: str, entity: str, run_id: str) -> str:
        return f"{self.root}/quarantine/{flow}/{entity}/{run_id}"

    def write_quarantine(self, split: Split, flow: str, entity: str, run_id: str) -> tuple[int, int]:
        """Rejected rows as JSON lines, replacing an earlier try of the same run.

        Returns (accepted, rejected). Both are counted in one pass, and nothing is written when
        nothing was rejected.
        """
        sizes = split.sizes.first()
        if sizes.rejected:
            split.rejected.write.mode("overwrite").json(self.quarantine_path(flow, entity, run_id))
        return sizes.accepted, sizes.rejected

    # --- audit ------------------------------------------------------------------------

    def _one_row(self, **values: str | int | None) -> DataFrame:
        """A control record: counts are long, everything else text."""
        columns = [F.lit(v).cast("long" if n.endswith("_count") else "string").alias(n) for n, v in values.items()]
        return self.spark.range(1, numPartitions=1).select(*columns, F.current_timestamp().alias("recorded_at"))

    def write_audit(self, *, run_id: str, pipeline: str, source: str, stage: str, status: str, kind: str = "batch",
                    counts: Mapping[str, int] | None = None, source_file_id: str | None = None,
                    error: str | None = None, quality: object = None) -> None:
        """One audit row per run and stage; the newest row of a stage counts."""
        if status not in TERMINAL_STATUSES:
            raise ValueError(f"unsupported terminal status: {status}")
        numbers = {k: int((counts or {}).get(k, 0)) for k in ("input", "output", "rejected", "duplicate")}
        if min(numbers.values()) < 0:
            raise ValueError("audit counts must be non-negative integers")
        one = self._one_row(
            run_id=run_id, pipeline_name=pipeline, source=source, stage=stage, status=status, source_file_id=source_file_id,
            input_count=numbers["input"], output_count=numbers["output"], rejected_count=numbers["rejected"],
            duplicate_count=numbers["duplicate"], error_message=error,
            data_quality=json.dumps(quality, default=str) if quality else None)
        finish_audit(one, kind).write.mode("append").parquet(f"{self.root}/control/audit/run={run_id}")

    def read_stage_audit(self, run_id: str, stage: str) -> Row | None:
        try:
            rows = self.spark.read.schema(AUDIT_DDL).parquet(f"{self.root}/control/audit/run={run_id}")
        except AnalysisException as problem:
            if (problem.getCondition() or "").startswith("PATH_NOT_FOUND"):
                return None
            raise
        return rows.filter(F.col("stage") == stage).orderBy(F.col("recorded_at").desc()).first()

    # --- ledger of published files ------------------------------------------------------

    @property
    def ledger_path(self) -> str:
        return f"{self.root}/control/processed_files"

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER_DDL).parquet(self.ledger_path)
        except AnalysisException as problem:
            if (problem.getCondition() or "").startswith("PATH_NOT_FOUND"):
                return self.spark.createDataFrame([], LEDGER_DDL)
            raise

    def processed(self, source_file_id: str) -> Row | None:
        return self.ledger().filter(F.col("source_file_id") == source_file_id).first()

    def mark_processed(self, source_file_id: str, source: str, run_id: str, input_count: int) -> None:
        """Record a file as published; call it only after Gold is complete."""
        one = self._one_row(source_file_id=source_file_id, source=source, run_id=run_id, input_count=input_count, status="SUCCEEDED")
        one.write.mode("append").parquet(self.ledger_path)
