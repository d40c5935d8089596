"""Small drawings that stand in a line of text for a word, put back where the text lost them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import tone

# Words that a drawing stands before, and captions of figures.
CUES = "indicates|denotes|represents"
CAPTION_CUE = rf"(?i)\b(?:{CUES})\b"
BODY_CUE = rf"(?i)(?:(?<=^)|(?<=[.!?;:]\s)|(?<=\band\s))(?:{CUES})\b"
SPAN_CUE = rf"(?i)^\s*(?:{CUES})\b"
FIGURE = r"(?i)^\s*fig(?:ure)?\s*\.?\s*(\d+)"


def _middle(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def _alike(a: Column, b: Column) -> Column:
    """Colours of which no channel differs by more than twelve hundredths."""
    return reduce(lambda x, y: x & y, [F.abs(F.shiftright(a, s).bitwiseAND(F.lit(255)) - F.shiftright(b, s).bitwiseAND(F.lit(255))) <= 30 for s in (0, 8, 16)])


def owners(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Captions of figures and paragraphs with a cue in their text: `cues` in it, and `anchor`, the height from which their cues can stand.

    A caption's cues stand below the line in which the page names its figure, which is looked for near the caption's lower edge.
    """
    own = blocks.withColumn("number", F.when(F.col("kind") == "caption", F.nullif(F.regexp_extract("text", FIGURE, 1), F.lit(""))))
    cues = F.when(F.col("kind") == "caption", F.regexp_count("text", F.lit(CAPTION_CUE))).when(F.col("kind") == "paragraph", F.regexp_count("text", F.lit(BODY_CUE))).otherwise(0)
    own = own.withColumn("cues", cues).filter((F.col("cues") > 0) & ((F.col("kind") == "paragraph") | F.col("number").isNotNull()))
    named = spans.select("page", F.nullif(F.regexp_extract("text", FIGURE, 1), F.lit("")).alias("number"), _middle("y0", "y1").alias("cy")).filter("number is not null")
    lines = own.select("page", "idx", "number", "y1").join(named, ["page", "number"]).filter((F.col("cy") >= F.col("y1") - 4) & (F.col("cy") <= F.col("y1") + 90)).groupBy("page", "idx").agg(F.min("cy").alias("line"))
    out = own.join(lines, ["page", "idx"], "left").withColumn("anchor", F.when(F.col("kind") == "caption", F.col("line")).otherwise(F.col("y0")))
    return out.filter("anchor is not null").drop("line", "number")


def recovered(blocks: DataFrame, spans: DataFrame, drawings: DataFrame) -> DataFrame:
    """(page, idx, text, markers): blocks whose every cue has a line with a shape on it just before it; the text names them in brackets before the cues.

    blocks: page, idx, kind, text and box; spans: page, text, size and box; drawings: page, n, commands
    (`l` and `c` of each stroke), line and fill (packed colours) and box. A line is short and flat and
    ends where the cue begins; its shape, round or square, has its colour and sits on it. One cue
    without a marker, or cues that the page has and the text has not, and the block stays as it is. Null
    texts have no cues; pages join by number, each side of a join within one page.
    """
    own = owners(blocks, spans)
    box = own.select("page", "idx", "kind", "cues", "anchor", F.col("x0").alias("ox0"), F.col("x1").alias("ox1"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    seen = spans.filter(F.col("text").rlike(SPAN_CUE)).select("page", F.greatest("size", F.lit(6.0)).alias("size"), F.col("x0").alias("cue"), _middle("y0", "y1").alias("cy"))
    below = F.when(F.col("kind") == "caption", 100).otherwise(8)
    near = box.join(seen, "page").filter((F.col("cy") >= F.col("anchor")) & (F.col("cy") <= F.col("oy1") + below) & (F.col("cue") >= F.col("ox0") - 4) & (F.col("cue") <= F.col("ox1") + 8))
    within = Window.partitionBy("page", "idx")
    near = near.withColumns({"k": F.row_number().over(within.orderBy("cy", "cue")) - 1, "n_cues": F.count("*").over(within)}).filter("n_cues = cues")

    high, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    lines = drawings.filter((F.col("commands") == "l") & F.col("line").isNotNull()).select("page", F.col("n").alias("line_n"), F.col("line").alias("rgb"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("y0").alias("ly0"), wide.alias("lw"), high.alias("lh"), _middle("y0", "y1").alias("lcy"))
    shape = F.when(F.col("commands").rlike("^c{3,}$"), "circle").when(F.col("commands").rlike("^l{4,}$"), "square")
    shapes = drawings.withColumn("shape", shape).filter("shape is not null and fill is not null").select("page", F.col("n").alias("shape_n"), "shape", "fill", wide.alias("sw"), high.alias("sh"), _middle("x0", "x1").alias("scx"), _middle("y0", "y1").alias("scy"))
    size = F.col("size")
    placed = F.when(F.col("kind") == "caption", F.col("ly0") > F.col("oy1") + 2).otherwise((F.col("lcy") >= F.col("oy0") - 6) & (F.col("lcy") <= F.col("oy1") + 6))
    gap = F.col("cue") - F.col("lx1")
    flat = (F.col("lw") >= 4) & (F.col("lw") <= F.least(F.lit(20.0), size * 2.2)) & (F.col("lh") <= F.greatest(F.lit(1.5), size * 0.18)) & (F.col("lx0") >= F.col("ox0") - 8) & (F.col("lx1") <= F.col("ox1") + 8)
    met = near.join(lines, "page").filter(flat & placed & (gap >= -0.75) & (gap <= 2.5) & (F.abs(F.col("lcy") - F.col("cy")) <= F.greatest(F.lit(1.5), size * 0.25)))
    most = F.least(F.lit(10.0), size)
    round_ = (F.col("sw") >= 2.5) & (F.col("sh") >= 2.5) & (F.col("sw") <= most) & (F.col("sh") <= most) & (F.col("sw") >= 0.72 * F.col("sh")) & (F.col("sw") <= 1.28 * F.col("sh"))
    on = (F.abs(F.col("scy") - F.col("lcy")) <= 1.5) & (F.col("scx") >= F.col("lx0") - 1) & (F.col("scx") <= F.col("lx1") + 1)
    met = met.join(shapes, "page").filter(round_ & on & (tone(F.col("fill")) == tone(F.col("rgb"))) & _alike(F.col("fill"), F.col("rgb")))
    best = met.groupBy("page", "idx", "k", "cues").agg(F.min_by(F.concat_ws(" ", "shape", tone(F.col("rgb"))), F.struct(F.abs(gap), "line_n", "shape_n")).alias("marker"))
    listed = best.groupBy("page", "idx", "cues").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "marker"))), lambda x: x["marker"]).alias("markers")).filter(F.size("markers") == F.col("cues"))

    def told(pattern: str) -> Column:
        pieces, words = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        marked = F.transform(F.arrays_zip(F.col("markers").alias("m"), words.alias("w"), F.slice(pieces, 2, F.size("markers")).alias("p")), lambda x: F.concat(F.lit("["), x["m"], F.lit("] "), x["w"], x["p"]))
        return F.concat(F.element_at(pieces, 1), F.array_join(marked, ""))

    text = F.when(F.col("kind") == "caption", told(CAPTION_CUE)).otherwise(told(BODY_CUE))
    return own.select("page", "idx", "kind", "text").join(listed.drop("cues"), ["page", "idx"]).select("page", "idx", text.alias("text"), "markers")
