"""Queries whose functions SQL has no form for; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import vectors
from quire.sources.tables import block_rows, table

from .book import query


@query()
def html_block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: block elements of pages."""
    return vectors.html_blocks(table(spark, sf_dir, "pages"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-21: pages as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", vectors.to_markdown("html").alias("markdown"))


@query()
def html_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: pages with allowed tags only."""
    return table(spark, sf_dir, "pages").select("page_id", vectors.sanitise("html").alias("html"))


@query()
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10: blocks of documents filled into batches."""
    return vectors.micro_batches(block_rows(spark, sf_dir), "doc_id")


@query()
def evidence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, SRT-09: blocks that cover a document within a budget."""
    return vectors.spread_sample(block_rows(spark, sf_dir), "doc_id", 1500)


@query()
def record_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12, FUN-33: parts of one brand, type and size matched by name: 0.72 title, 0.20 brand, 0.08 price."""
    part = table(spark, sf_dir, "part")
    a, b = (part.select(F.col("p_partkey").alias(f"{x}_key"), F.col("p_name").alias(f"{x}_name"), "p_brand", "p_type", "p_size", F.col("p_retailprice").alias(f"{x}_price")) for x in ("l", "r"))
    # What pairs cost can't be told from the bytes of the parts: the number of partitions is held.
    on, parts = ["p_brand", "p_type", "p_size"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = a.repartition(parts, *on).join(b.repartition(parts, *on).hint("merge"), on).filter("l_key < r_key")
    year = F.when(F.abs(F.col("l_price") - F.col("r_price")) <= 100, 1.0).otherwise(0.0)
    score = 0.72 * vectors.title_ratio("l_name", "r_name") + 0.20 + 0.08 * year
    return both.select("l_key", "r_key", F.round(score, 6).alias("confidence"))


@query()
def term_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-05, FUN-08: NFKC and case folding of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(vectors.nfkc_fold("text").cast("binary"), 256).alias("key"))
