"""The data model's relations from the driver's tables: library items, blocks, annotations, folders and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items: documents with what labels say; a toxic one is in the trash."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("job_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("abstract"), "lang", F.col("source").alias("folder_id"),
        F.col("quality").alias("importance"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"), "n_chars",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks: the lines of documents that aren't blank, stripped, with their place."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.btrim("line").alias("text"), F.concat_ws("-", "doc_id", "pos").alias("block_id")).filter("text <> ''")


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks): the same blocks as an array of (pos, block_id, text) beside their document, so that nothing is shuffled."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("pos"), F.concat_ws("-", "doc_id", i).alias("block_id"), F.btrim(line).alias("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda b: b["text"] != "").alias("blocks"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations: turns of conversations; those of the assistant count as suggested."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "ai").otherwise("manual").alias("source"), F.col("text").alias("quote")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic geometry: line items as boxes on the page of their order, in whole points."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_returnflag") == "N", "b").otherwise("a").alias("engine"),
        (F.col("l_partkey") % 400).alias("x0"), (F.col("l_suppkey") % 300).alias("y0"),
        (F.col("l_partkey") % 400 + F.col("l_quantity").cast("bigint") * 6).alias("x1"), (F.col("l_suppkey") % 300 + 40 + F.col("l_linenumber") * 20).alias("y1"),
    )


BOXES_SQL = """boxes AS (SELECT l_orderkey AS page, l_linenumber AS idx, CASE WHEN l_returnflag = 'N' THEN 'b' ELSE 'a' END AS engine, l_partkey % 400 AS x0, l_suppkey % 300 AS y0,
    l_partkey % 400 + l_quantity::bigint * 6 AS x1, l_suppkey % 300 + 40 + l_linenumber * 20 AS y1 FROM lineitem)"""
ITEMS_SQL = """items AS (SELECT d.doc_id AS job_id, string_split(text, chr(10))[1] AS title, text AS abstract, lang, source AS folder_id, quality AS importance,
    coalesce(toxic, 0) = 1 AS deleted, n_chars FROM documents d LEFT JOIN labels USING (doc_id))"""
BLOCKS_SQL = """blocks AS (SELECT doc_id, (i - 1)::int AS pos, trim(l[i]) AS text, doc_id || '-' || (i - 1) AS block_id
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> '')"""
