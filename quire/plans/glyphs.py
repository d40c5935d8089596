"""Styles of documents' blocks, from glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import glyphs
from quire.sources.tables import blocks

from .book import query


def with_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the glyphs of their text, of which the source lacks one word in seventeen."""
    own = blocks(spark, sf_dir).select("doc_id", "pos", "text")
    lost = F.filter(F.sequence(F.lit(0), F.size(F.split("text", " ")) - 1), lambda i: F.crc32(F.concat_ws(":", "doc_id", "pos", i).cast("binary")) % 17 == 0)
    return own.withColumn("glyphs", glyphs.glyph_runs(F.col("text"), lost))


@query()
def style_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-13, DOC-04: bold and italic spans of every block, by alignment of its text with its glyphs."""
    found = glyphs.styled(with_glyphs(spark, sf_dir), ["doc_id", "pos"])
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], F.array_join(s["styles"], "+"))), ",")
    return found.select("doc_id", "pos", "matched", "target_chars", "source_chars", "status", told.alias("spans"))
