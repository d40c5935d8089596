"""Exports of documents that are made again only where something changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import records
from quire.session import shared_path
from quire.sources.exports import Exports
from quire.sources.tables import BLOCKS_SQL, blocks, table

from .book import query


def rendered(rows: DataFrame) -> DataFrame:
    """Markdown of blocks (key, pos, text)."""
    return records.markdown(rows.withColumns({"kind": F.when(F.col("pos") == 0, "heading").otherwise("text"), "level": F.lit(1)}), "key", "pos").withColumnRenamed("markdown", "content")


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, pos, CASE WHEN quality = 1 AND pos = 0 THEN text || ' (reviewed)' ELSE text END AS text FROM blocks LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
    SELECT doc_id::varchar AS key, '<!-- 2 -->' || chr(10) || string_agg(CASE WHEN pos = 0 THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS content FROM b GROUP BY doc_id""")
def exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-22, SNK-05: documents exported once, then again in a newer form after some were reviewed or trashed; unchanged ones are migrated."""
    rows = blocks(spark, sf_dir).select(F.col("doc_id").alias("key"), "pos", "text")
    state = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    live = rows.join(state, "key", "left").filter("coalesce(toxic, 0) = 0")
    reviewed = F.when((F.col("quality") == 1) & (F.col("pos") == 0), F.concat("text", F.lit(" (reviewed)"))).otherwise(F.col("text"))
    path = shared_path(spark, "exports")
    Exports(spark, path).refresh(rows, ["pos", "text"], rendered)

    def headed(content):
        return F.concat(F.lit("<!-- 2 -->\n"), content)

    newer = Exports(spark, path, 2, {1: headed})
    newer.refresh(live.select("key", "pos", reviewed.alias("text")), ["pos", "text"], lambda x: rendered(x).withColumn("content", headed(F.col("content"))))
    return newer.outputs()
