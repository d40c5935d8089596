"""Reconstruction and fusion over the driver's tables; boxes are synthetic and their texts are columns of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import reconstruct
from quire.sources.tables import table

from .book import query


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx")).agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("bigint").alias("q"))
    x0, y0 = F.col("p") % 400, F.col("idx") * 90
    one = li.select("page", "idx", x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 60).alias("y1"), F.concat(F.lit("Cell "), "p", F.lit(" of "), "q").alias("text"), "q", "p")
    text = F.when(F.col("q") % 4 == 0, F.concat("text", F.lit("."))).when(F.col("q") % 4 == 1, F.concat(F.lit("Cell "), F.col("p") + 1, F.lit(" of "), "q")).when(F.col("q") % 4 == 2, F.replace("text", F.lit("of"), F.lit("or"))).otherwise(F.col("text"))
    two = one.filter("q <> 7").withColumn("text", text).withColumn("x0", F.col("x0") + F.col("q") % 9)
    return one.drop("p", "q"), two.drop("p", "q")


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS idx, max(l_partkey) AS p, max(l_quantity)::bigint AS q FROM lineitem GROUP BY ALL), o AS (SELECT *, 'Cell ' || p || ' of ' || q AS a FROM l),
    t AS (SELECT *, CASE WHEN q = 7 THEN NULL WHEN q % 4 = 0 THEN a || '.' WHEN q % 4 = 1 THEN 'Cell ' || (p + 1) || ' of ' || q WHEN q % 4 = 2 THEN replace(a, 'of', 'or') ELSE a END AS b FROM o)
    SELECT page, idx, CASE WHEN q <> 7 THEN idx END AS "match", CASE WHEN q % 4 = 0 THEN b ELSE a END AS text, CASE WHEN b IS NULL THEN 'left only' WHEN q % 4 = 0 THEN 'punctuation' WHEN q % 4 = 1 THEN 'numbers' WHEN q % 4 = 2 THEN 'words' ELSE 'exact' END AS decision FROM t""")
def engine_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-09, FUN-24, FUN-26, SRC-09: what two engines read, block by block."""
    one, two = _read(spark, sf_dir)
    return reconstruct.fused(one, two)


@query()
def document_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-01, DOC-02, WIN-04, FLT-13: elements of raw blocks; every seven orders make a document."""
    one, _ = _read(spark, sf_dir)
    raw = one.withColumn("doc", F.floor(F.col("page") / 7)).withColumn("text", F.when(F.col("idx") % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    return reconstruct.build(raw, 612, 792)


@query()
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: a verdict on each rebuilt document."""
    one, _ = _read(spark, sf_dir)
    raw = one.withColumn("doc", F.floor(F.col("page") / 7))
    return reconstruct.quality(reconstruct.build(raw, 612, 792), raw)
