"""Marks of captions and paragraphs, over pages made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import markers
from quire.sources.tables import table

from .book import query

#: Red, green and blue.
_RGB = "element_at(array(13369344, 39168, 204), cast(p % 3 as int) + 1)"


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order is a page; each of its lines is a paragraph with two cues, each behind a line with a shape on it. Of five paragraphs one lacks a shape and one has a shape of another colour."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx")).agg(F.max("l_partkey").alias("p")).withColumn("y", (F.col("idx") * 100).cast("double"))
    text = F.concat(F.lit("Part "), "p", F.lit("; indicates growth and denotes loss."))
    blocks = li.select("page", "idx", F.lit("paragraph").alias("kind"), text.alias("text"), F.lit(50.0).alias("x0"), F.col("y").alias("y0"), F.lit(400.0).alias("x1"), (F.col("y") + 40).alias("y1"))
    cues = li.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"cx": F.lit(100.0) + 120 * F.col("k"), "cy": F.col("y") + 10})
    word = F.when(F.col("k") == 0, "indicates growth").otherwise("denotes loss")
    spans = cues.select("page", word.alias("text"), F.lit(10.0).alias("size"), F.col("cx").alias("x0"), (F.col("cy") - 5).alias("y0"), (F.col("cx") + 60).alias("x1"), (F.col("cy") + 5).alias("y1"))
    n = F.col("idx") * 10 + F.col("k")
    lines = cues.select("page", n.alias("n"), F.lit("l").alias("commands"), F.expr(_RGB).alias("line"), F.lit(None).cast("int").alias("fill"), (F.col("cx") - 13).alias("x0"), F.col("cy").alias("y0"), (F.col("cx") - 1).alias("x1"), (F.col("cy") + 1).alias("y1"))
    fill = F.when((F.col("p") % 5 == 1) & (F.col("k") == 1), 8388736).otherwise(F.expr(_RGB))
    shapes = cues.filter("not (p % 5 = 0 and k = 0)").select("page", (n + 5).alias("n"), F.when(F.col("p") % 2 == 0, "cccc").otherwise("llll").alias("commands"), F.lit(None).cast("int").alias("line"), fill.alias("fill"), (F.col("cx") - 9).alias("x0"), (F.col("cy") - 2).alias("y0"), (F.col("cx") - 5).alias("x1"), (F.col("cy") + 2).alias("y1"))
    return blocks, spans, lines.unionByName(shapes)


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS idx, max(l_partkey) AS p FROM lineitem GROUP BY ALL), m AS (SELECT *, CASE WHEN p % 2 = 0 THEN 'circle ' ELSE 'square ' END || CASE p % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS m FROM l WHERE p % 5 > 1)
    SELECT page, idx, 'Part ' || p || '; [' || m || '] indicates growth and [' || m || '] denotes loss.' AS text, [m, m] AS markers FROM m""")
def inline_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-05: drawings between words, put back into the text before the words that they stand before."""
    return markers.recovered(*pages(spark, sf_dir))
