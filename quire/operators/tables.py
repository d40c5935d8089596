"""Tables that two engines read: heads and group rows that one of them has whole are carried over to the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import vectors
from quire.session import cut

#: Rows that a head has at most, likeness of the other head cells, and least cells of a row that ties two grids together.
HEAD_ROWS, LIKENESS, ANCHOR_CELLS = 6, 0.72, 3


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def _rows(cells: DataFrame) -> DataFrame:
    """(table, row, n, key, digits, label, label_down, label_across, blank, across, spans): what a row of cells says, whether all but its first cell are empty, its width, and whether that can't be told without laying it out."""
    listed = F.array_sort(F.collect_list(F.struct("idx", normal(F.col("text")).alias("t"), "down", "across")))
    rows = cells.groupBy("table", "row").agg(listed.alias("c"))
    first = F.element_at("c", 1)
    return rows.select(
        "table", "row", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: x["t"]), "␟").alias("key"), F.exists("c", lambda x: x["t"].rlike(r"\d")).alias("digits"), first["t"].alias("label"),
        first["down"].alias("label_down"), first["across"].alias("label_across"), F.forall(F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda x: x["t"] == "").alias("blank"),
        F.aggregate("c", F.lit(0), lambda acc, x: (acc + F.coalesce(x["across"], F.lit(1))).cast("int")).alias("across"), F.exists("c", lambda x: (F.coalesce(x["down"], F.lit(1)) > 1) | (F.coalesce(x["across"], F.lit(0)) < 1)).alias("spans"),
    )


def _grids(cells: DataFrame) -> DataFrame:
    """(table, row, idx, down, across, text, col) of `cells`, with the column where each stands, by spans; a table's cells are laid out beside each other."""
    own = cells.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("row", "idx", "down", "across", "text"))).alias("c"))
    laid = own.select("table", F.explode(F.arrays_zip(F.col("c"), vectors.placed_cells(F.transform("c", lambda x: F.struct(x["row"].alias("row"), x["down"].alias("down"), x["across"].alias("across")))).alias("p"))).alias("x"))
    return laid.select("table", "x.c.*", F.col("x.p.col").alias("col"))


def widths(cells: DataFrame) -> DataFrame:
    """(table, width): the width that most rows of two cells or more have; of several the least."""
    return _widths(cells, _rows(cells))


def _widths(cells: DataFrame, said: DataFrame) -> DataFrame:
    """The same, given what the rows say. Where no cell reaches down, a row is as wide as its cells; only other tables are laid out."""
    tall = said.filter("spans").select("table").distinct()
    rows = _grids(cells.join(tall, "table", "left_semi")).groupBy("table", "row").agg(F.max(F.col("col") + F.col("across")).alias("w"), F.count("*").alias("n"))
    flat = said.join(tall, "table", "left_anti").select("table", "row", F.col("across").alias("w"), F.col("n").cast("bigint").alias("n"))
    rows = rows.unionByName(flat).filter("n > 1")
    return rows.groupBy("table", "w").agg(F.count("*").alias("n")).groupBy("table").agg(F.min_by("w", F.struct(-F.col("n"), "w")).alias("width"))


def _anchors(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(table, head, other_head): rows before the first body row that both grids have word for word; a row of a group's name in both ends the head earlier."""
    body = ours.filter(F.col("digits") & (F.col("n") >= ANCHOR_CELLS)).select("table", "key", F.col("row").alias("head"))
    same = body.join(theirs.select("table", "key", F.col("row").alias("other_head")), ["table", "key"])
    first = same.groupBy("table").agg(F.min(F.struct("head", "other_head")).alias("a")).select("table", "a.head", "a.other_head")
    groups = ours.filter((F.col("n") > 1) & (F.col("label") != "") & F.col("blank")).select("table", "label", F.col("row").alias("g"))
    single = theirs.filter("n = 1").select("table", "label", F.col("row").alias("o"))
    met = groups.join(first, "table").filter("g < head").join(single, ["table", "label"]).filter("o < other_head")
    once = met.groupBy("table", "g").agg(F.count("*").alias("n"), F.min("o").alias("o")).filter("n = 1").groupBy("table").agg(F.min(F.struct("g", "o")).alias("m"))
    return first.join(once, "table", "left").select("table", F.coalesce("m.g", "head").alias("head"), F.coalesce("m.o", "other_head").alias("other_head"))


def with_heads(cells: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells (table, row, idx, text, down, across) of one engine with what the other one proves, and the changes made.

    A head's corner cell that one engine left empty takes the other's text and reaches down over the
    head, where that one's reaches over several rows and the rest of both heads is alike; a row whose
    name is followed by empty cells becomes one cell, where the other has it as one of the table's
    width. Rows are joined by what they say. Changes: table, row, operation and text; `unsure`
    where the heads differ too much. Tables without a counterpart stay as they are.
    """
    ours, theirs = cut(_rows(cells)), cut(_rows(other))
    heads = cut(_anchors(ours, theirs).filter((F.col("head") > 0) & (F.col("head") <= HEAD_ROWS) & (F.col("other_head") > 0) & (F.col("other_head") <= HEAD_ROWS)))

    def corner(rows: DataFrame, own: DataFrame, name: str) -> DataFrame:
        text = own.filter("row = 0").groupBy("table").agg(F.min_by("text", "idx").alias(f"{name}_text"))
        return rows.filter("row = 0").select("table", F.col("label").alias(f"{name}_label"), F.col("label_down").alias(f"{name}_down")).join(text, "table")

    empty = ours.join(heads, "table").filter("row < head").groupBy("table").agg(F.every(F.col("label") == "").alias("all_empty"), F.collect_list(F.struct("row", "label")).alias("labels"))

    def words(own: DataFrame, upto: str) -> DataFrame:
        # Where a cell stands hangs on those above it alone.
        above = own.filter(F.col("row") < HEAD_ROWS).join(heads.select("table", upto), "table").filter(F.col("row") < F.col(upto)).drop(upto)
        rest = _grids(above).filter("col > 0")
        return rest.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", normal(F.col("text")).alias("t")))), lambda x: x["t"]), "").alias(f"{upto}_words"))

    asked = heads.join(corner(ours, cells, "own"), "table").join(corner(theirs, other, "other"), "table").filter("own_label = '' and other_label <> '' and other_down > 1")
    asked = asked.join(empty, "table").join(words(cells, "head"), "table").join(words(other, "other_head"), "table")
    named = F.transform(F.filter("labels", lambda x: x["label"] == F.col("other_label")), lambda x: x["row"])
    like = vectors.title_ratio("head_words", "other_head_words") >= LIKENESS
    asked = asked.withColumn("sure", (F.col("all_empty") | (named == F.array(F.lit(1)))) & like)
    given = asked.filter("sure").select("table", F.col("head").alias("__head"), F.col("other_text").alias("__label"))

    width = _widths(cells, ours)
    single = theirs.filter("n = 1").join(width, "table").filter("label_across = width").groupBy("table", "label").agg(F.count("*").alias("m"), F.max("width").alias("width")).filter("m = 1")
    grouped = ours.filter((F.col("n") > 1) & (F.col("label") != "") & F.col("blank")).join(single, ["table", "label"]).select("table", "row", F.col("width").alias("__width"))

    out = cells.join(given, "table", "left").join(grouped, ["table", "row"], "left")
    first = F.col("idx") == 0
    out = out.filter(F.col("__head").isNull() | ~first | (F.col("row") == 0) | (F.col("row") >= F.col("__head"))).filter(F.col("__width").isNull() | first)
    held = first & (F.col("row") == 0) & F.col("__head").isNotNull()
    out = out.select("table", "row", "idx", F.when(held, F.col("__label")).otherwise(F.col("text")).alias("text"), F.when(held, F.col("__head")).otherwise(F.col("down")).cast("int").alias("down"), F.coalesce("__width", "across").cast("int").alias("across"))
    changes = asked.select("table", F.lit(0).alias("row"), F.when(F.col("sure"), "head").otherwise("unsure").alias("operation"), F.col("other_text").alias("text"))
    merged = grouped.join(cells.filter("idx = 0"), ["table", "row"]).select("table", "row", F.lit("group").alias("operation"), "text")
    return out, changes.unionByName(merged)
