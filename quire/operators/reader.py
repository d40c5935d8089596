"""What a reader needs: paragraphs joined over pages, styled spans cut to a slice, evidence blocks, messages fitted to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Limits of boxes on a page of width and height 1, and patterns of text that joins.
BOTTOM, TOP, SLACK, GAP, SHIFT, RIGHT_SHIFT, WIDTHS = 0.78, 0.20, 0.015, 0.12, 0.035, 0.08, 0.10
TERMINAL = r"[.!?。！？;；:]\s*[\])}\"'’”]*$"
CONTINUES = r"^[\s(\[\"'‘“]*[a-z]"
APART = r"(?i)^(?:(?:fig(?:ure)?|table|tab|scheme|plate|algorithm|references?|bibliography|footnotes?|notes?)\b|(?:\[\d+(?:\s*[,–-]\s*\d+)*\]|\d+[.)]|\([a-z0-9ivx]+\)|[a-z][.)]|[•*†‡])(?:\s|$))"


def _width(box: Column) -> Column:
    return box["x1"] - box["x0"]


def _sound(box: Column) -> Column:
    inside = [F.coalesce(box[x].between(0, 1), F.lit(False)) for x in ("x0", "y0", "x1", "y1")]
    return inside[0] & inside[1] & inside[2] & inside[3] & (box["x0"] < box["x1"]) & (box["y0"] < box["y1"])


def _one_column(a: Column, b: Column) -> Column:
    """Boxes of one column of a page."""
    return (F.least(_width(a), _width(b)) >= 0.20) & (F.abs(a["x0"] - b["x0"]) <= SHIFT) & (F.abs(a["x1"] - b["x1"]) <= RIGHT_SHIFT) & (F.abs(_width(a) - _width(b)) <= WIDTHS)


def _next_column(a: Column, b: Column) -> Column:
    """Boxes of which the second goes on where the first ends: one wide column, or from the right one of two to the left one."""
    wide = (F.least(_width(a), _width(b)) >= 0.55) & (F.abs(a["x0"] - b["x0"]) <= SHIFT) & (F.abs(a["x1"] - b["x1"]) <= RIGHT_SHIFT)
    narrow = (F.least(_width(a), _width(b)) >= 0.20) & (F.greatest(_width(a), _width(b)) <= 0.48) & (F.abs(_width(a) - _width(b)) <= WIDTHS)
    return wide | (narrow & (a["x0"] >= 0.48) & (b["x1"] <= 0.52) & (F.abs(1 - a["x1"] - b["x0"]) <= 0.04))


def _filled(figures: Column, top: Column, bottom: Column, column: Column) -> Column:
    """Whether figures, one below the other, fill a column from top to bottom but for small gaps."""
    edges = F.concat(F.array(top), F.transform(figures, lambda m: m["y1"]))

    def fits(m: Column, i: Column) -> Column:
        above, shared = F.get(edges, i), F.least(column["x1"], m["x1"]) - F.greatest(column["x0"], m["x0"])
        return (shared >= 0.5 * F.least(_width(column), _width(m))) & (m["y0"] >= above - SLACK) & (m["y0"] - above <= GAP)

    last = F.element_at(edges, -1)
    return F.forall(F.transform(figures, fits), lambda ok: ok) & (last <= bottom + SLACK) & (bottom - last <= GAP)


def paragraphs_join(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, figures) with `joins`: whether paragraph b continues a, with nothing but the figures between.

    a and b are structs of page, x0, y0, x1, y1 (parts of the page) and text, figures an array of such boxes with page, in order.
    """
    a, b, figures = F.col("a"), F.col("b"), F.col("figures")
    tail, head = F.filter(figures, lambda m: m["page"] == a["page"]), F.filter(figures, lambda m: m["page"] == b["page"])
    same_page = (a["page"] == b["page"]) & (F.size(figures) > 0) & _one_column(a, b) & (a["y1"] <= b["y0"]) & _filled(figures, a["y1"], b["y0"], a)
    low = F.when(F.size(tail) > 0, (F.element_at(tail, -1)["y1"] >= BOTTOM) & _filled(tail, a["y1"], F.element_at(tail, -1)["y1"], a)).otherwise(a["y1"] >= BOTTOM)
    high = F.when(F.size(head) > 0, (F.get(head, 0)["y0"] <= TOP) & _filled(head, F.get(head, 0)["y0"], b["y0"], b)).otherwise(b["y0"] <= TOP)
    pages = F.transform(figures, lambda m: m["page"])
    ordered = (F.array_sort(pages) == pages) & F.forall(figures, lambda m: _sound(m) & m["page"].between(a["page"], b["page"]))
    left, right = F.trim(a["text"]), F.trim(b["text"])
    says = (left != "") & (right != "") & ~left.rlike(TERMINAL) & right.rlike(CONTINUES) & ~left.rlike(APART) & ~right.rlike(APART)
    placed = same_page | ((b["page"] == a["page"] + 1) & _next_column(a, b) & low & high)
    return pairs.withColumn("joins", F.coalesce(_sound(a) & _sound(b) & ordered & placed & says, F.lit(False)))


def sliced_spans(spans: Column, start: Column, end: Column, tones: list[str]) -> Column:
    """Spans (start, end, style, tone) of bold or of a known colour, as far as they are in a slice of the text, from its start on."""
    known = F.filter(spans, lambda s: (s["style"] == "bold") | ((s["style"] == "color") & s["tone"].isin(tones)))
    cut = F.transform(known, lambda s: F.struct((F.greatest(s["start"], start) - start).alias("start"), (F.least(s["end"], end) - start).alias("end"), s["style"].alias("style"), F.when(s["style"] == "color", s["tone"]).alias("tone")))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def evidence(elements: DataFrame, job: str = "job") -> tuple[DataFrame, DataFrame]:
    """Blocks (job, block_id, page, content) that can be cited, and (job, n_blocks, n_unreadable).

    `elements` (job, page, block_id, text, table_html, tex). A block needs an id that no other element
    of the job has, and text, a table or a formula; all others count as unreadable.
    """
    table = T.clean(F.regexp_replace("table_html", r"<[^>]*>", " "))
    content = F.array_join(F.filter(F.array(F.trim("text"), table, F.trim("tex")), lambda x: x != ""), "\n")
    named = F.coalesce(F.col("block_id"), F.lit("")) != ""
    counted = elements.filter("page >= 1").withColumn("content", content).withColumn("good", named & (F.col("content") != ""))
    per_id = counted.groupBy(job, "block_id").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.max("page").alias("page"), F.max("content").alias("content"))
    single = F.col("good")
    per_id = per_id.withColumn("good", (F.col("n") == 1) & (F.col("n_good") == 1))
    totals = per_id.groupBy(job).agg(F.count_if(single).alias("n_blocks"), F.sum(F.col("n") - F.when(single, 1).otherwise(0)).alias("n_unreadable"))
    return per_id.filter("good").select(job, "block_id", "page", "content"), totals


#: Tokens of a request, and of each message, besides its text.
OVERHEAD = 8


def _sixths(char: Column) -> Column:
    """Six times what token_estimate counts for a character: a third for an ASCII one, a byte by 1.5 for others."""
    return F.when(F.octet_length(char) == 1, 2).otherwise(4 * F.octet_length(char))


def _beginning(text: Column, tokens: Column) -> Column:
    """The longest beginning of a text of so many tokens."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, char: Column) -> Column:
        total = acc["sum"] + _sixths(char)
        return F.struct(total.alias("sum"), (acc["n"] + F.when(total <= 6 * tokens, 1).otherwise(0)).alias("n"))

    return F.substring(text, F.lit(1), F.aggregate(F.split(text, ""), start, step, lambda acc: acc["n"]))


def fitted(messages: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, seq, text, fits): the messages that are left of `messages` (key, seq, text, removable, truncatable) within a limit of tokens.

    removable and truncatable are places in the order of giving way, or null. Messages give way as a
    whole, one after another, while the total is over the limit; then each truncatable one is cut to
    the longest beginning that fits. Empty messages go. `fits` is false for a key that is still over.
    """
    size = T.token_estimate(F.col("text"))
    sized = messages.withColumn("size", size.cast("bigint"))
    total = F.lit(OVERHEAD) + F.sum(F.col("size") + OVERHEAD).over(Window.partitionBy(key))

    def before(order: str) -> Column:
        w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), "seq").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(F.when(F.col(order).isNotNull(), F.col("size")).otherwise(0)).over(w), F.lit(0))

    sized = sized.withColumn("total", total).withColumn("gone", F.col("removable").isNotNull() & (F.col("total") - before("removable") > limit))
    sized = sized.withColumn("size", F.when(F.col("gone"), 0).otherwise(F.col("size"))).withColumn("total", total)
    sized = sized.withColumn("over", F.col("total") - before("truncatable") - limit)
    allowed = F.greatest(F.lit(0), F.col("size") - F.col("over"))
    text = F.when(F.col("gone"), "").when(F.col("truncatable").isNotNull() & (F.col("over") > 0), _beginning(F.col("text"), allowed)).otherwise(F.col("text"))
    kept = sized.select(key, "seq", text.alias("text")).filter("text <> ''")
    left = F.lit(OVERHEAD) + F.sum(T.token_estimate(F.col("text")) + OVERHEAD).over(Window.partitionBy(key))
    return kept.withColumn("fits", left <= limit)
