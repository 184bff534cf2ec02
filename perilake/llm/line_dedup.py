"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

The state is what a log-structured store keeps: sorted runs ``(key hash, documents)`` on levels,
plus settled runs with the keys already known to be frequent. A batch of documents becomes one
sorted run. It is merge-anti-joined with the settled runs (what is decided needs no counting) and
added on level 0. When a level holds ``fanout`` runs they are merged into one run of the next
level; keys that reach the limit leave the counting runs for a settled run. A last compaction
settles the rest. Only hashes (128 bits of the key) move; a document's text moves once, to meet the
keys it has to drop.

Defined results: a missing or empty text is one empty line. A line whose key is shorter than
``min_chars`` always stays. Every row is a document of its own, also where ids repeat or are
missing. An empty table gives an empty result. Columns of the input are untouched except ``text``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perilake.llm.common import column_values, durable, forget, int64, of_batches, query, same, table

KEY = ["__h1", "__h2"]


def key_hashes(lines: Sequence[bytes], min_chars: int) -> np.ndarray:
    """128-bit hashes of the keys of lines as an (n, 2) array; zeros for keys that are too short.

    ``bytes`` strips exactly space and 09-0D and lower-cases exactly A-Z.
    """
    out = bytearray()
    for line in lines:
        key = line.strip().lower()
        short = len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars)
        out += b"\0" * 16 if short else xxhash.xxh3_128_digest(key)
    return np.frombuffer(bytes(out), dtype=np.int64).reshape(-1, 2)


def document_keys(documents: DataFrame, carried: Sequence[str], text: str, min_chars: int) -> DataFrame:
    """One row per document and distinct key: the carried columns and the key's hash."""
    schema = documents.select(*carried).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, found = [], []
        for i, value in enumerate(column_values(batch, text)):
            hashes = np.unique(key_hashes((value or "").encode().split(b"\n"), min_chars), axis=0)
            hashes = hashes[hashes.any(axis=1)]
            found.append(hashes)
            of.append(np.full(len(hashes), i))
        at, keys = pa.array(np.concatenate(of)), np.concatenate(found)
        columns = [batch.column(batch.schema.get_field_index(c)).take(at) for c in carried]
        return pa.RecordBatch.from_arrays([*columns, int64(keys[:, 0]), int64(keys[:, 1])], names=[*carried, *KEY])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "__h1 long", "__h2 long"])
    return documents.select(*carried, text).mapInArrow(of_batches(rows), fields)


class LineRuns:
    """Levels of sorted runs and the settled runs, each a durable table."""

    def __init__(self, min_docs: int, fanout: int):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.written: list[DataFrame] = []

    def add(self, run: DataFrame) -> None:
        """Merge-anti-join a batch's run with what is settled and put the rest on level 0."""
        for done in self.settled:
            run = run.join(done.select(*KEY), KEY, "left_anti")
        self._place(run, 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        """Merge all runs of a level: frequent keys are settled, the others form a run of the next level."""
        runs, self.levels[level] = self.levels[level], []
        merged = runs[0]
        for other in runs[1:]:
            merged = merged.unionByName(other)
        merged = durable(merged.groupBy(*KEY).agg(F.sum("__n").alias("__n")).sortWithinPartitions(*KEY))
        self.written.append(merged)
        self.settled.append(merged.filter(F.col("__n") >= self.min_docs))
        self._place(merged.filter(F.col("__n") < self.min_docs), level + 1)

    def close(self) -> DataFrame:
        """Compact every level and return the frequent keys, each once."""
        left = [run for level in self.levels for run in level]
        self.levels = [left]
        if left:
            last = left[0]
            for other in left[1:]:
                last = last.unionByName(other)
            if len(left) > 1:
                last = last.groupBy(*KEY).agg(F.sum("__n").alias("__n"))
            self.settled.append(last.filter(F.col("__n") >= self.min_docs))
        out = self.settled[0]
        for other in self.settled[1:]:
            out = out.unionByName(other)
        found = durable(out.select(*KEY).sortWithinPartitions(*KEY))
        for run in self.written:
            forget(run)
        return found


def frequent_keys(documents: DataFrame, text: str, min_docs: int, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """Hashes of the keys that at least ``min_docs`` documents hold."""
    batch = F.pmod(F.xxhash64(text, F.lit(1)), F.lit(batches)).cast("int")
    dealt = documents.select(F.col(text), batch.alias("__batch"))
    counted = document_keys(dealt, ["__batch"], text, min_chars).groupBy("__batch", *KEY).agg(F.count(F.lit(1)).alias("__n"))
    staged = durable(counted.sortWithinPartitions("__batch", *KEY))
    runs = LineRuns(min_docs, fanout)
    for number in range(batches):
        runs.add(staged.filter(F.col("__batch") == number).drop("__batch"))
    found = runs.close()
    forget(staged)
    return found


KEPT = StructType().add("lines", "long").add("dropped", "long").add("kept", "string")


@F.pandas_udf(KEPT)
def _keep(text: pd.Series, drop1: pd.Series, drop2: pd.Series, min_chars: pd.Series, spare: pd.Series) -> pd.DataFrame:
    out = []
    for value, one, two, least, spared in zip(text, drop1, drop2, min_chars, spare, strict=True):
        lines = (value or "").split("\n")
        if one is None or not len(one):
            out.append((len(lines), 0, value or ""))
            continue
        gone = set(zip(map(int, one), map(int, two), strict=True))
        hashes = key_hashes([x.encode() for x in lines], least).tolist()
        kept = [line for line, (a, b) in zip(lines, hashes, strict=True) if (a, b) not in gone]
        if spared and not any(map(str.strip, kept)):
            kept = lines
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=["lines", "dropped", "kept"])


def dedup_lines(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1,
    batches: int = 4, fanout: int = 2, spare_copies: bool = False,
) -> DataFrame:
    """Documents with ``text`` freed of lines whose key occurs in ``min_docs`` documents or more.

    Adds ``n_lines`` (before) and ``n_dropped``; columns of these names in the input are replaced.
    With ``spare_copies`` a document that would lose every line is left whole: it is a copy of other
    documents, which is for a later stage to settle, and its text would vanish with all its copies.
    """
    frequent = frequent_keys(documents, text, min_docs, min_chars, batches, fanout)
    named = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    hits = document_keys(named, ["__id"], "__text", min_chars).join(frequent, KEY, "left_semi")
    drops = hits.groupBy("__id").agg(F.collect_set(F.struct(*KEY)).alias("__drop"))
    met = documents.join(drops, same(F.col(doc_id), F.col("__id")), "left")
    judged = met.withColumn("__kept", _keep(text, F.col("__drop.__h1"), F.col("__drop.__h2"), F.lit(min_chars), F.lit(spare_copies)))
    return judged.withColumns({
        text: F.col("__kept.kept"), "n_lines": F.col("__kept.lines"), "n_dropped": F.col("__kept.dropped"),
    }).drop("__id", "__drop", "__kept")


SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM cut)),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
