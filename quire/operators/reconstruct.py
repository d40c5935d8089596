"""Documents from raw layout blocks, and one document from what two engines read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import layout


def from_grid(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes of a 0..1000 grid in points."""
    scale = {"x0": width, "x1": width, "y0": height, "y1": height}
    return blocks.withColumns({k: F.col(k) * v / 1000 for k, v in scale.items()})


def from_bottom_up(blocks: DataFrame, height: float) -> DataFrame:
    """Boxes whose y grows upwards, turned over."""
    return blocks.withColumns({"y0": F.lit(height) - F.col("y1"), "y1": F.lit(height) - F.col("y0")})


def without_furniture(blocks: DataFrame, height: float, least: int = 3, margin: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Blocks that stay, and those at a page's edge whose text other pages of the document repeat."""
    edge = (F.col("y1") <= margin * height) | (F.col("y0") >= (1 - margin) * height)
    key = layout.edge_key(F.col("text"))
    repeats = blocks.filter(edge).select("doc", key.alias("k"), "page").filter("k <> ''").groupBy("doc", "k").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least)
    marked = blocks.withColumn("k", key).withColumn("edge", edge).join(repeats.select("doc", "k", F.lit(True).alias("again")), ["doc", "k"], "left")
    gone = F.col("edge") & F.coalesce("again", F.lit(False))
    return marked.filter(~gone).drop("k", "edge", "again"), marked.filter(gone).drop("k", "edge", "again")


def build(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Elements (doc, element, page, text, parts) of raw blocks (doc, page, idx, x0, y0, x1, y1, text): furniture out, in reading order, continued paragraphs joined."""
    kept, _ = without_furniture(blocks, height)
    ordered = layout.reading_order(kept.withColumn("doc_page", F.concat_ws("/", "doc", "page")).withColumnRenamed("page", "page_no").withColumnRenamed("doc_page", "page"), width)
    placed = ordered.select("doc", F.struct("page_no", "reading_order").alias("place"), "text")
    runs = layout.merged_runs(placed, "doc", "place")
    order = F.row_number().over(Window.partitionBy("doc").orderBy("place"))
    return runs.select("doc", order.alias("element"), F.col("place.page_no").alias("page"), "text", "parts")


def quality(elements: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc, elements, chars, broken, status): FAIL without text, REVIEW with broken characters or few elements for the blocks."""
    counts = elements.groupBy("doc").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("[�\\x00-\\x08]"))).alias("broken"))
    both = raw.groupBy("doc").agg(F.count("*").alias("blocks")).join(counts, "doc", "left")
    status = F.when(F.coalesce("chars", F.lit(0)) == 0, "FAIL").when((F.col("broken") > 0) | (F.col("elements") * 10 < F.col("blocks")), "REVIEW").otherwise("PASS")
    return both.select("doc", F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("broken", F.lit(0)).alias("broken"), status.alias("status"))


def protected(text: Column) -> Column:
    """Letters and digits of a text, in order: what two readings have to agree in."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def fused(one: DataFrame, other: DataFrame, coverage: float = 0.7) -> DataFrame:
    """(page, idx, match, text, decision) of two engines' blocks (page, idx, box, text).

    exact: equal texts · punctuation: equal letters and digits, the longer text is taken · numbers: other
    numbers, the first text stays · words: other words, the first stays · left only, right only.
    """
    best = layout.best_matches(one, other, coverage)
    # A block of the second engine goes to the block that it fits best.
    taken = best.groupBy("page", "match").agg(F.max(F.struct("iou", (-F.col("idx")).alias("i"))).alias("b")).select("page", "match", (-F.col("b.i")).alias("idx"))
    left = one.select("page", "idx", F.col("text").alias("a")).join(taken, ["page", "idx"], "left")
    right = other.select("page", F.col("idx").alias("match"), F.col("text").alias("b"))
    both = left.join(right, ["page", "match"], "full_outer")
    a, b = F.col("a"), F.col("b")
    decision = (
        F.when(b.isNull(), "left only").when(a.isNull(), "right only").when(a == b, "exact").when(protected(a) == protected(b), "punctuation").when(numbers(a) != numbers(b), "numbers").otherwise("words")
    )
    text = F.when((decision == "punctuation") & (F.length(b) > F.length(a)), b).otherwise(F.coalesce(a, b))
    return both.select("page", "idx", "match", text.alias("text"), decision.alias("decision"))


def repaired_hierarchy(folders: DataFrame) -> DataFrame:
    """(folder_id, parent_id): missing parents are added at the top, and a folder on a cycle goes to the top."""
    from quire.operators.library import ancestors

    missing = folders.filter("parent_id is not null").select(F.col("parent_id").alias("folder_id")).distinct().join(folders.select("folder_id"), "folder_id", "left_anti")
    full = folders.select("folder_id", "parent_id").union(missing.select("folder_id", F.lit(None).cast("string")))
    up = full.select(F.col("folder_id").alias("ancestor"), F.col("parent_id").alias("back"))
    looped = ancestors(full).join(up, "ancestor").filter("back = folder_id").select("folder_id").union(full.filter("parent_id = folder_id").select("folder_id")).distinct().withColumn("looped", F.lit(True))
    return full.join(looped, "folder_id", "left").select("folder_id", F.when(F.col("looped"), F.lit(None).cast("string")).otherwise(F.col("parent_id")).alias("parent_id"))
