"""Current state of keyed changes, kept in buckets that are rewritten only when a change touches them.

A state is one partitioned and bucketed table: rows are bucketed by their key, and each (generation,
bucket) is a partition of its own. Folding a delivery writes the buckets it touches as a new
generation; a manifest, one row a bucket, says which generation of each bucket is current. Readers
are pruned to the current partitions when the scan is planned. Because the table is bucketed by the
join key, the state side of a fold is read bucket by bucket without a shuffle: only the delivery,
cut to one row a key, travels.

Manifests are numbered and never overwritten. A second writer of the same number fails, and a reader
keeps the version it started with until :meth:`StateTable.expire` removes it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from perilake.operators.changes import live, newest_changes
from perilake.operators.quality import DatasetRule, judge, passing_by
from perilake.sources.tables import Lakehouse

MANIFEST_DDL = "bucket int, generation string, keys long, live long, measures array<struct<position:int,rule:string,passing:long,total:long>>"


@dataclass(frozen=True)
class Fold:
    """A written generation that no manifest names yet."""

    generation: str
    version: int
    entries: tuple[Row, ...]
    touched: tuple[int, ...]
    accepted: int
    won: int


@dataclass(frozen=True)
class StateTable:
    """Newest change per key of one entity, tombstones included."""

    lake: Lakehouse
    entity: str
    key: str
    buckets: int = 64
    rules: tuple[DatasetRule, ...] = ()
    order: str = "_source_order"
    identity: str = "_source_change_id"
    operation: str = "_operation"

    @property
    def name(self) -> str:
        return self.lake.name("silver", f"{self.entity}_state")

    @property
    def manifests(self) -> str:
        return f"{self.lake.root}/control/state/{self.entity}"

    def bucket_of(self) -> Column:
        """The bucket Spark itself gives a key."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int")

    # --- manifests ----------------------------------------------------------------------

    def versions(self) -> DataFrame | None:
        try:
            return self.lake.spark.read.schema(f"{MANIFEST_DDL}, version int").parquet(self.manifests)
        except AnalysisException as problem:
            if (problem.getCondition() or "").startswith("PATH_NOT_FOUND"):
                return None
            raise

    def current(self) -> tuple[int, list[Row]]:
        """Number and entries of the newest manifest: at most one row a bucket."""
        known = self.versions()
        newest = known.agg(F.max("version")).first()[0] if known is not None else None
        if newest is None:
            return 0, []
        return newest, known.filter(F.col("version") == newest).drop("version").collect()

    def rows(self, entries: Sequence[Row] | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """State rows of the given manifest entries (or the newest), pruned to their partitions; tombstones included."""
        wanted = defaultdict(list)
        for entry in self.current()[1] if entries is None else entries:
            if buckets is None or entry.bucket in buckets:
                wanted[entry.generation].append(entry.bucket)
        if not self.lake.spark.catalog.tableExists(self.name):
            return None
        chosen = F.lit(False)
        for generation, those in sorted(wanted.items()):
            chosen = chosen | ((F.col("generation") == generation) & F.col("bucket").isin(*those))
        return self.lake.spark.table(self.name).filter(chosen)

    # --- folding ------------------------------------------------------------------------

    def folded(self, changes: DataFrame, entries: Sequence[Row], touched: Sequence[int]) -> DataFrame:
        """New rows of the touched buckets. Replayed and older changes leave a row as it is."""
        arriving = newest_changes(changes, self.key, self.order, self.identity).repartition(self.buckets, self.key)
        held = self.rows(entries, touched)
        if held is None:
            return arriving
        names = [c for c in held.columns if c not in ("generation", "bucket")]
        place = lambda side: F.struct(F.col(f"{side}.{self.order}"), F.col(f"{side}.{self.identity}"))
        newer = F.col(f"old.{self.key}").isNull() | (place("new") > place("old"))
        both = held.select(*names).alias("old").join(arriving.select(*names).alias("new"), F.col(f"old.{self.key}") == F.col(f"new.{self.key}"), "full")
        return both.select(*[F.when(F.coalesce(newer, F.lit(False)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in names])

    def fold(self, changes: DataFrame, run_id: str) -> Fold:
        """Write the buckets that ``changes`` touch as a new generation.

        ``changes`` should be a written table: it is read to list its buckets, and to fold.
        """
        version, entries = self.current()
        sizes = changes.groupBy(self.bucket_of().alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a bucket
        touched = tuple(sorted(r.bucket for r in sizes))
        generation = f"{run_id}-{uuid.uuid4().hex[:8]}"
        if not touched:
            return Fold(generation, version, tuple(entries), (), 0, 0)
        self.lake.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.lake.database('silver')}")
        fresh = self.folded(changes, entries, touched)
        kept = [c for c in fresh.columns if c not in ("generation", "bucket")]
        (fresh.select(*kept, F.lit(generation).alias("generation"), self.bucket_of().alias("bucket"))
         .write.format("parquet").mode("append").partitionBy("generation", "bucket").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", f"{self.lake.root}/silver/{self.entity}_state").saveAsTable(self.name))
        written = self.lake.spark.table(self.name).filter(F.col("generation") == generation)
        won, measured = self._measured(written, run_id)
        old = [e for e in entries if e.bucket not in touched]
        return Fold(generation, version, (*old, *measured), touched, sum(r.n for r in sizes), won)

    def _measured(self, written: DataFrame, run_id: str) -> tuple[int, list[Row]]:
        """Manifest entries of the new buckets, with what their live rows add to each dataset rule."""
        mine = F.count_if(F.col("_run_id") == run_id) if "_run_id" in written.columns else F.lit(0)
        sizes = written.groupBy("bucket", "generation").agg(
            F.count(F.lit(1)).alias("keys"), F.count_if(F.col(self.operation) != "D").alias("live"), mine.alias("won"))
        if self.rules:
            passing = passing_by(live(written, self.operation), self.rules, "bucket").groupBy("bucket").agg(
                F.collect_list(F.struct("position", "rule", "passing", "total")).alias("measures"))
            sizes = sizes.join(passing, "bucket", "left")
        else:
            sizes = sizes.withColumn("measures", F.lit(None))
        listed = sizes.withColumn("measures", F.coalesce(F.col("measures").cast("array<struct<position:int,rule:string,passing:long,total:long>>"), F.array()))
        found = listed.collect()  # one row a touched bucket
        return sum(r.won for r in found), [Row(bucket=r.bucket, generation=r.generation, keys=r["keys"], live=r.live, measures=r.measures) for r in found]

    def judged(self, fold: Fold) -> DataFrame | None:
        """The dataset rules over the whole state as it would be, from the measures of its buckets."""
        if not self.rules:
            return None
        named = [(i, str(r)) for i, r in enumerate(self.rules)]
        added = {i: [0, 0] for i, _ in named}
        for entry in fold.entries:
            for m in entry.measures or ():
                added[m.position][0] += m.passing
                added[m.position][1] += m.total
        rows = [(i, rule, added[i][0], added[i][1]) for i, rule in named]
        return judge(self.lake.spark.createDataFrame(rows, "position int, rule string, passing long, total long"), self.entity)

    def commit(self, fold: Fold) -> None:
        """Make a fold the current version."""
        entries = self.lake.spark.createDataFrame(list(fold.entries), MANIFEST_DDL)
        entries.coalesce(1).write.mode("errorifexists").parquet(f"{self.manifests}/version={fold.version + 1}")

    def publish_view(self, columns: Sequence[Column | str]) -> None:
        """Point the Silver view of the entity at the live rows of the newest version."""
        full = self.lake.name("silver", self.entity)
        _, entries = self.current()
        by_generation = defaultdict(list)
        for entry in entries:
            by_generation[entry.generation].append(entry.bucket)
        chosen = " OR ".join(f"(generation = '{g}' AND bucket IN ({', '.join(map(str, sorted(b)))}))" for g, b in sorted(by_generation.items())) or "false"
        self.lake.spark.sql(f"CREATE OR REPLACE VIEW {full} AS SELECT {', '.join(f'`{c}`' for c in columns)} FROM {self.name} WHERE {self.operation} <> 'D' AND ({chosen})")

    def expire(self, keep: int = 2) -> int:
        """Drop partitions that none of the newest ``keep`` manifests names; returns their number.

        Generations of failed runs go the same way. Run it when no fold is being written.
        """
        known = self.versions()
        if known is None or not self.lake.spark.catalog.tableExists(self.name):
            return 0
        newest = known.agg(F.max("version")).first()[0] or 0
        used = known.filter(F.col("version") > newest - keep).select("generation", "bucket").distinct()
        stored = self.lake.spark.sql(f"SHOW PARTITIONS {self.name}").select(
            F.regexp_extract("partition", "generation=(.*)/bucket=", 1).alias("generation"), F.regexp_extract("partition", "bucket=([0-9]+)$", 1).cast("int").alias("bucket"))
        stale = stored.join(used, ["generation", "bucket"], "left_anti").collect()  # partitions are catalog entries, known to the driver
        session = self.lake.spark._jsparkSession.sparkContext().hadoopConfiguration()
        for r in stale:
            self.lake.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (generation = '{r.generation}', bucket = {r.bucket})")
            path = self.lake.spark._jvm.org.apache.hadoop.fs.Path(f"{self.lake.root}/silver/{self.entity}_state/generation={r.generation}/bucket={r.bucket}")
            path.getFileSystem(session).delete(path, True)
        return len(stale)
