"""Layout reconstruction: boxes, columns, reading order, continuations, sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import edge_key, join_hyphenated


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share; columns a.x0 ... b.y1."""
    wide = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    high = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def area(a: str) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))


def best_matches(blocks: DataFrame, candidates: DataFrame, coverage: float = 0.7) -> DataFrame:
    """(page, idx, match, iou): for each block the candidate of its page that covers it enough, by the greatest intersection over union; ties go to the first."""
    a, b = blocks.alias("a"), candidates.alias("b")
    pairs = a.join(b, F.col("a.page") == F.col("b.page")).select(F.col("a.page").alias("page"), F.col("a.idx").alias("idx"), F.col("b.idx").alias("match"), overlap("a", "b").alias("o"), area("a").alias("sa"), area("b").alias("sb"))
    fit = pairs.filter((F.col("sa") > 0) & (F.col("o") >= coverage * F.least("sa", "sb")) & (F.col("o") > 0)).withColumn("iou", F.round(F.col("o") / (F.col("sa") + F.col("sb") - F.col("o")), 6))
    best = fit.groupBy("page", "idx").agg(F.max(F.struct("iou", (-F.col("match")).alias("m"))).alias("b"))
    return best.select("page", "idx", (-F.col("b.m")).alias("match"), F.col("b.iou").alias("iou"))


def union_box(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def repeated_edges(lines: DataFrame, least: int = 2) -> DataFrame:
    """(key, pages, first_text): texts at page edges on several pages, numbers aside."""
    keyed = lines.withColumn("key", edge_key(F.col("text"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.count_distinct("page").alias("pages"), F.min_by("text", F.struct("page", "pos")).alias("first_text")).filter(F.col("pages") >= least)


def columns_of(blocks: DataFrame, width: int, chars: int = 80) -> DataFrame:
    """(page, two_columns): two or more blocks and enough characters wholly on either side of the middle."""
    left, right = F.col("x1") <= width / 2, F.col("x0") >= width / 2

    def enough(side: Column) -> Column:
        return (F.count_if(side) >= 2) & (F.sum(F.when(side, F.col("chars")).otherwise(0)) >= chars)

    return blocks.groupBy("page").agg((enough(left) & enough(right)).alias("two_columns"))


def reading_order(blocks: DataFrame, width: int) -> DataFrame:
    """`blocks` with `reading_order` 1..n per page: wide blocks cut the page into segments, in which the left column comes first."""
    wide = (F.col("x1") - F.col("x0")) >= 0.6 * width
    by_height = Window.partitionBy("page").orderBy("y0", "x0", "idx")
    segment = F.sum(F.when(wide, 1).otherwise(0)).over(by_height.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.when(wide, 1).otherwise(0)
    column = F.when(wide, 0).otherwise(F.when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1))
    ordered = blocks.withColumn("segment", segment).withColumn("column", column)
    order = Window.partitionBy("page").orderBy("segment", "column", ((F.col("y0") + F.col("y1")) / 2), "x0", "idx")
    return ordered.withColumn("reading_order", F.row_number().over(order))


def continues(text: Column, following: Column) -> Column:
    """Whether a paragraph goes on in the next one: no end of sentence or a hyphen, then a small letter."""
    return ~F.trim(text).rlike(r"[.!?:;。！？]$") & following.rlike(r"^\p{Ll}")


def merged_runs(lines: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of lines that continue each other, as one text: hyphens at breaks go. (key, first pos, text, parts)."""
    w = Window.partitionBy(key).orderBy(pos)
    start = F.when(continues(F.lag("text").over(w), F.col("text")), 0).otherwise(1)
    island = lines.withColumn("start", start).withColumn("island", F.sum("start").over(w))
    parts = F.array_sort(F.collect_list(F.struct(pos, "text")))
    text = F.aggregate(F.slice(F.col("parts"), 2, 1 << 30), F.element_at("parts", 1)["text"], lambda acc, x: join_hyphenated(acc, x["text"]))
    grouped = island.groupBy(key, "island").agg(F.min(pos).alias(pos), parts.alias("parts"))
    return grouped.select(key, pos, text.alias("text"), F.size("parts").alias("parts"))


def carried_sections(blocks: DataFrame, key: str, pos: str, heading: Column) -> DataFrame:
    """`blocks` with `section`: the last heading at or before each block."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def merged_intervals(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching intervals [start, end) of each key as one; unknown starts and ends come last, and one that can't be compared goes with what is before it."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("island", F.when(F.col("start") > before, 1).otherwise(0))
    return marked.withColumn("island", F.sum("island").over(w)).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def band_join(points: DataFrame, bands: DataFrame, height: int = 64) -> DataFrame:
    """Points (page, y, ...) in bands (page, top, bottom, ...), by equal page and height bucket; a band is in each bucket that it reaches."""
    p = points.withColumn("bucket", F.floor(F.col("y") / height))
    b = bands.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("top") / height), F.floor(F.col("bottom") / height))))
    return p.join(b, ["page", "bucket"]).filter((F.col("y") >= F.col("top")) & (F.col("y") <= F.col("bottom"))).drop("bucket")


def nearest(refs: DataFrame, targets: DataFrame, on: list[str], keep: Column | None = None) -> DataFrame:
    """(ref, target): the target of equal keys, for which `keep` holds, with the least distance in page, then in order, then the first."""
    both = refs.join(targets, on)
    both = both if keep is None else both.filter(keep)
    rank = F.struct(F.abs(F.col("t_page") - F.col("r_page")).alias("a"), F.abs(F.col("t_ord") - F.col("r_ord")).alias("b"), F.col("target").alias("c"))
    return both.groupBy("ref").agg(F.min_by("target", rank).alias("target"))


def grid_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """(table, row, col, left_text, right_text, verdict) of two engines' cells."""
    a, b = one.withColumnRenamed("text", "left_text"), other.withColumnRenamed("text", "right_text")
    both = a.join(b, ["table", "row", "col"], "full_outer")
    verdict = F.when(F.col("left_text").isNull(), "right only").when(F.col("right_text").isNull(), "left only").when(F.col("left_text") == F.col("right_text"), "same").otherwise("different")
    return both.withColumn("verdict", verdict)


def _labels(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> np.ndarray:
    """For each box the first one that it reaches over gaps of at most `gap`.

    A line sweeps from left to right. For each height at which a box begins or ends it keeps the box
    that reaches furthest there, and that one's group: a new box joins the groups within the gap above,
    below and behind it, and takes their places. So memory is that of the boxes alone.
    """
    heights = np.unique(np.concatenate((y0, y1)))
    reach, owner = np.full(len(heights), -np.inf), np.zeros(len(heights), np.int64)
    group = np.arange(len(x0))

    def head(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    low, high = np.searchsorted(heights, y0 - gap), np.searchsorted(heights, y1 + gap, side="right")
    first, last = np.searchsorted(heights, y0), np.searchsorted(heights, y1, side="right")
    for i in np.argsort(x0, kind="stable").tolist():
        near = slice(low[i], high[i])
        own = i
        for other in np.unique(owner[near][reach[near] + gap >= x0[i]]).tolist():
            a, b = head(own), head(other)
            group[max(a, b)] = min(a, b)
            own = min(a, b)
        held = slice(first[i], last[i])
        reach[held] = np.maximum(np.where(reach[held] + gap >= x0[i], reach[held], -np.inf), x1[i])
        owner[held] = own
    return np.array([head(i) for i in range(len(x0))], np.int64)


def box_groups(boxes: DataFrame, gap: float) -> DataFrame:
    """(page, idx, group): boxes of a page that are no more than `gap` apart in both directions, and what they reach; a group has the name of its first box. Boxes without a page are left out."""
    columns = ["page", "idx", "x0", "y0", "x1", "y1"]

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        page, idx = rows["page"].to_numpy(), rows["idx"].to_numpy()
        box = [rows[c].to_numpy(dtype="float64") for c in columns[2:]]
        cuts = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1], [True]))).tolist()
        out = [idx[a:b][_labels(*(x[a:b] for x in box), gap)] if b - a > 1 else idx[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return rows[["page", "idx"]].assign(group=np.concatenate(out))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The last page of a batch may go on in the next one.
        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            page = frame["page"].to_numpy()
            last = int(np.searchsorted(page, page[-1]))
            if last or (held and held[-1]["page"].iloc[0] != page[0]):
                yield grouped(pd.concat([*held, frame.iloc[:last]], ignore_index=True))
                held.clear()
            held.append(frame.iloc[last:])
        if held:
            yield grouped(pd.concat(held, ignore_index=True))

    own = boxes.select(*columns).filter("page is not null")
    return own.repartition("page").sortWithinPartitions("page", "idx").mapInPandas(run, "page bigint, idx int, group int")
