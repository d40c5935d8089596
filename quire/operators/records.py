"""Captions, citations, tables, spans and records: operators that walk ordered rows or assemble packages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def captions_after(blocks: DataFrame, key: str, pos: str, kind: str) -> DataFrame:
    """`blocks` with `caption`: for each figure the next caption that no text stands before, or else the last one before it on the same terms.

    A text is a barrier: captions are only looked for between two texts.
    """
    barrier = F.sum(F.when(F.col(kind) == "text", 1).otherwise(0)).over(Window.partitionBy(key).orderBy(pos))
    within = Window.partitionBy(key, "barrier").orderBy(pos)
    caption = F.when(F.col(kind) == "caption", F.col(pos))
    ahead = F.first(caption, ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing))
    back = F.last(caption, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("barrier", barrier).withColumn("caption", F.when(F.col(kind) == "figure", F.coalesce(ahead, back))).drop("barrier")


def resolved(refs: DataFrame, ladders: list[tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """`refs` with `target`: from the first of the given maps (keys, target) that has exactly one for the keys."""
    out, names = refs, []
    for i, (table, on) in enumerate(ladders):
        unique = table.groupBy(*on).agg(F.count("*").alias("n"), F.min("target").alias(f"t{i}")).filter("n = 1").drop("n")
        out = out.join(unique, on, "left")
        names.append(f"t{i}")
    return out.withColumn("target", F.coalesce(*names)).select(key, "target")


def modal_widths(rows: DataFrame, table: str, row: str, width: str) -> DataFrame:
    """(table, width): the most common width of a table's rows of two cells or more; of equal ones that which comes first."""
    counted = rows.filter(F.col(width) > 1).groupBy(table, width).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    return counted.groupBy(table).agg(F.max_by(width, F.struct("n", -F.col("first"))).alias(width))


def expanded_citations(text: Column) -> Column:
    """Numbers that the citations [a, b–c] of a text name, in order; a range of more than a thousand is left out."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*[-–,]\s*\d+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(part, r"\s*[-–]\s*"), lambda x: x.cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when((high >= low) & (high - low <= 1000), F.sequence(low, F.greatest(low, F.least(high, low + 1000)))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, numbers))


def glyph_runs(glyphs: DataFrame, key: list[str], order: str, same: list[str], x0: str, x1: str, gap: float) -> DataFrame:
    """Runs of neighbouring glyphs with equal styles and small gaps: (key, run, text, x0, x1)."""
    w = Window.partitionBy(*key).orderBy(order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    new = F.when(F.lag(x1).over(w).isNull() | differs | (F.col(x0) - F.lag(x1).over(w) > gap), 1).otherwise(0)
    runs = glyphs.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return runs.groupBy(*key, "run").agg(text.alias("text"), F.min(x0).alias(x0), F.max(x1).alias(x1))


def pattern_starts(rows: DataFrame, key: str, order: str, column: str, patterns: list[str]) -> DataFrame:
    """(key, order): where consecutive values match the patterns one by one."""
    w = Window.partitionBy(key).orderBy(order)
    hit = F.col(column).rlike(patterns[0])
    for i, p in enumerate(patterns[1:], 1):
        hit = hit & F.lead(column, i).over(w).rlike(p)
    return rows.withColumn("hit", hit).filter("hit").select(key, order)


def numbered(rows: DataFrame, key: str, order: str, wanted: str) -> DataFrame:
    """(key, order, number): the wanted number where it is free, otherwise the least one not yet used, taken in order.

    Each key's rows pass by in order; what is kept of them are the numbers used. The least free one only rises.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, free = run, set(), 1  # no key is a function
        for frame in frames:
            numbers = []
            for name, asked in zip(frame[key].tolist(), frame[wanted].tolist(), strict=True):
                name = None if name != name else name
                if now is run or name != now:
                    now, used, free = name, set(), 1
                number = None if asked is None or asked != asked else int(asked)
                if number is None or number in used:
                    while free in used:
                        free += 1
                    number = free
                used.add(number)
                numbers.append(number)
            yield frame[[key, order]].assign(number=numbers)

    own = rows.select(key, F.col(order).cast("int").alias(order), F.col(wanted).cast("int").alias(wanted))
    return own.repartition(key).sortWithinPartitions(key, order, wanted).mapInPandas(run, f"{key} {dict(own.dtypes)[key]}, {order} int, number int")


def tone(rgb: Column) -> Column:
    """Name of a packed colour's tone, by hue; grey where saturation is low."""
    r, g, b = (F.shiftrightunsigned(rgb, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(high == r, (g - b) / span * 60).when(high == g, (b - r) / span * 60 + 120).otherwise((r - g) / span * 60 + 240)
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return (
        F.when((high == 0) | (span * 5 < high), "gray").when((hue < 15) | (hue >= 345), "red").when(hue < 70, "orange").when(hue < 170, "green").when(hue < 255, "blue").when(hue < 300, "purple").otherwise("pink")
    )


def rescaled(value: Column, extent: Column, page: Column) -> Column:
    """A coordinate in points: one of a 0..1000 grid, told by its extent of 1.2 times the page or more, is scaled."""
    return F.when(extent > 1.2 * page, value * page / 1000).otherwise(value)


def packages(items: DataFrame, children: DataFrame, collections: DataFrame) -> DataFrame:
    """One row for each item with its notes, attachments and the names of its collections, in order."""
    kids = children.groupBy("parent").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "note", F.col("key")))).alias("notes"), F.array_sort(F.collect_list(F.when(F.col("kind") != "note", F.col("key")))).alias("attachments")
    )
    names = items.select("key", F.explode("collections").alias("c")).join(collections.select(F.col("key").alias("c"), "name"), "c").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"))
    none = F.array().cast("array<string>")
    both = items.join(kids, items["key"] == kids["parent"], "left").drop("parent").join(names, "key", "left")
    return both.select("key", *[F.coalesce(x, none).alias(x) for x in ("notes", "attachments", "names")])


def crossref_fields(payload: Column) -> Column:
    """The common bibliographic fields of a Crossref message as JSON text."""
    m = F.from_json(payload, "struct<message:struct<title:array<string>,DOI:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>>")["message"]
    names = F.transform(m["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.struct(F.get(m["title"], 0).alias("title"), F.lower(m["DOI"]).alias("doi"), F.get(m["container-title"], 0).alias("venue"), names.alias("authors"), F.get(F.get(m["issued"]["date-parts"], 0), 0).alias("year"))


def progress(lines: DataFrame, job: str, order: str, line: str) -> DataFrame:
    """(job, stage, done, total): the last progress that a job's output lines tell."""
    hit = lines.select(job, order, F.regexp_extract(line, r"^(\w[\w ]*?):", 1).alias("stage"), F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", 1).alias("d"), F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", 2).alias("t")).filter("d <> ''")
    last = hit.groupBy(job).agg(F.max_by(F.struct("stage", F.col("d").cast("int").alias("done"), F.col("t").cast("int").alias("total")), order).alias("p"))
    return last.select(job, "p.*")


def frozen_upsert(events: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, text, evidence): the last text; evidence only from events that save it."""
    saved = F.when(F.col("saves"), F.col("evidence"))
    return events.groupBy(key).agg(F.max_by("text", order).alias("text"), F.max_by(saved, F.when(saved.isNotNull(), order)).alias("evidence"))


def markdown(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, markdown) of ordered blocks (kind, level, text)."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))
