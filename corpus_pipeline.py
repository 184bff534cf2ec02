"""Training-corpus pipeline: quality, repeated lines, near copies, benchmark passages, mixing.

Each stage takes the rows its predecessor kept, written as Parquet and read again, so a lost
executor repeats no finished stage; what a stage has read is then deleted. All stages but the last return the columns of ``documents``.

Defined results, as the operators have them: documents without words are rejected by the first
stage; rows that repeat id and text stay once after the third; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import forget
from perilake.llm.decontamination import without_passages
from perilake.llm.line_dedup import dedup_lines
from perilake.llm.mixing import mix_sources
from perilake.llm.ngram_join import one_of_each
from perilake.llm.quality import keep_quality
from perilake.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weak-label classifier accepts."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more share; copies that consist of such lines are left to the next stage."""
    freed = dedup_lines(docs, spare_copies=True)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return freed.withColumn("n_chars", changed).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 Jaccard similarity of five-word shingles."""
    return one_of_each(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_passages(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, by source targets."""
    return mix_sources(docs)[1].select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mixture),
]

ORACLE_SQL = None  # a fitted classifier, edit distances and pseudorandom draws are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None  # never the input
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
