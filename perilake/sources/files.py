"""Landed files: CSV snapshots, change logs, text lines, manifests and documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.functions.identity import content_hash
from perilake.operators.contracts import TableContract
from perilake.operators.ordering import file_positions


def _missing_path(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND") or "Path does not exist" in str(error)


def read_csv_snapshot(spark: SparkSession, path: str, header_from: Sequence[str] | None = None) -> DataFrame:
    """Header CSV, every column text, malformed lines fail the read.

    Without inference only the header line is read up front; the columns are whatever the file
    names, so the caller's contract decides what is missing or extra.
    """
    reader = spark.read.options(header=True, mode="FAILFAST", inferSchema=False, enforceSchema=False)
    if header_from:
        reader = reader.schema(", ".join(f"`{c}` string" for c in header_from))
    return reader.csv(path)


def read_change_log(spark: SparkSession, root: str, tables: Mapping[str, TableContract]) -> dict[str, DataFrame]:
    """Landed changes per table folder under ``root``; absent, empty or keyless folders are left out."""
    found: dict[str, DataFrame] = {}
    for name, contract in tables.items():
        try:
            raw = spark.read.options(header=True, inferSchema=False).csv(f"{root.rstrip('/')}/{name}/")
        except AnalysisException as error:
            if _missing_path(error):
                continue
            raise
        if contract.key in raw.columns:
            found[name] = raw
    return found


def landed_files(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """``path, modified, length`` of the files in a table's folder (a listing, no content); nothing if it is absent."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{table}/")
    except AnalysisException as error:
        if _missing_path(error):
            return None
        raise
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def read_change_files(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame | None:
    """Changes of the given files, every column text; nothing if they don't name the key.

    Files of one delivery have one header; a file with another one fails the read instead of
    having its columns taken for others.
    """
    raw = spark.read.options(header=True, inferSchema=False, enforceSchema=False).csv(list(paths))
    return raw if key in raw.columns else None


def file_identities(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(source_object, source_file_id, size) per landed file; identity is the content alone.

    Each file is hashed whole by one task; :func:`snapshot_identity` splits large ones.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True)
    return reader.load(path).select(
        F.col("path").alias("source_object"), content_hash("content").alias("source_file_id"), F.col("length").alias("size")
    )


def snapshot_identity(spark: SparkSession, path: str) -> str:
    """Content identity of a landed snapshot (a file or a folder of part files), at any size.

    Each file is read in splits by all tasks. A line counts with its place in its file and its raw
    bytes; the SHA-256 of each (place, line) and of each file's length are added up in four 64-bit
    lanes, first per file and then, over the hashes of those sums, per snapshot. So reordered, padded
    or trimmed lines change it, and neither the split size nor the names of part files do.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").cast("string").alias("length"))
    if found.isEmpty():
        raise FileNotFoundError(path)
    # The separator is fixed, so a carriage return stays part of its line.
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    hashed = _placed(lines.withColumn("line", F.sha2(F.col("value").cast("binary"), 256)), ["line"])
    positioned = file_positions(hashed, "place", keep_file=True)
    of_line = positioned.select(F.col("_file").alias("path"), F.sha2(F.concat_ws(":", "place", "line"), 256).alias("hash"))
    of_size = found.select("path", F.sha2(F.concat_ws(":", F.lit("length"), "length"), 256).alias("hash"))
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/+", "file:/")
    per_file = of_line.unionByName(of_size).groupBy(plain.alias("path")).agg(_hash_sum("hash").alias("hash"))
    return per_file.agg(_hash_sum("hash").alias("hash")).first().hash


def _hash_sum(column: str) -> Column:
    """Order-free sum of hexadecimal SHA-256 values, kept as one more SHA-256 (64 digits)."""
    lanes = [F.conv(F.substring(column, 1 + 16 * lane, 16), 16, 10).cast("decimal(20,0)") for lane in range(4)]
    return F.sha2(F.concat_ws(":", *[F.sum(lane).cast("string") for lane in lanes]), 256)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder as (source, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("source"), "content")


def _placed(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.select(
        *columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def read_text_lines_indexed(spark: SparkSession, path: str, name: str = "raw_probability") -> DataFrame:
    """First comma field of each non-blank line with its position in file order."""
    lines = _placed(spark.read.text(path), ["value"]).filter(F.trim("value") != "")
    first = F.trim(F.split("value", ",")[0])
    return file_positions(lines.select(first.alias(name), "_file", "_block"))


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of a header CSV with the position of each row in file order."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    return file_positions(_placed(raw, columns))


def write_matrix_csv(vectors: DataFrame, path: str, names: Sequence[str], order: Sequence[str], label: str | None = None) -> None:
    """Label-first headerless numeric CSV in ``order``; part files sort like the rows."""
    columns = ([F.col(label).cast("int")] if label else []) + [F.col(n) for n in names]
    ordered = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(*columns).write.mode("overwrite").csv(path, header=False)


def write_json_report(spark: SparkSession, report: Mapping[str, object], path: str) -> None:
    """A one-row JSON report (metadata, evaluation, validation)."""
    import json

    text = json.dumps(report, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_prepared_snapshot(spark: SparkSession, path: str, parts: Sequence[str]) -> dict[str, DataFrame] | None:
    """Prepared artefacts stored as Parquet below ``path``, or None unless all are there."""
    found = {}
    for part in parts:
        try:
            found[part] = spark.read.parquet(f"{path.rstrip('/')}/{part}")
        except AnalysisException as error:
            if _missing_path(error):
                return None
            raise
    return found
