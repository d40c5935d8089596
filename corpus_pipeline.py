"""Corpus pipeline: five stages over documents; each one's rows are written as Parquet and read again by the next.

Ids are taken to be unique. Null and empty texts fail the quality rules, an empty table passes
through all stages as an empty table, and extra columns of documents stay up to the last stage,
which returns the encoded documents: doc_id, n_pieces, pieces_sha256, lossless. The tables between
stages go when the application ends; a run that is given a folder keeps them there, and a later one with
the same folder goes on behind the last stage that was written whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, decontamination, jaccard_join, line_dedup, quality, sentencepiece_codec
from quire.session import importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier; one that is left without a word goes. n_chars follows the text, where there is such a column."""
    taken = "__taken"
    left = line_dedup.deduplicated(docs, count_col=taken).filter((F.col(taken) == 0) | F.col("text").rlike(common.WORD))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of shingles of five words and a similarity of 0.8 make: the one of least id."""
    return jaccard_join.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents, and whether each decodes to its text."""
    return sentencepiece_codec.checked(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL can't express the merges of the last stage; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def _written(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents."""
    importable(spark)
    base = folder.rstrip("/") if folder else common.shared_path(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        if not (folder and _written(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
