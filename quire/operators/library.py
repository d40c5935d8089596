"""The library: live items, saved views, folders, facets, pages."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

OPERATORS = {
    "equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v,
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())), "in": lambda c, v: c.isin(v), "empty": lambda c, v: c.isNull() | (c.cast("string") == ""),
}


def compile_filters(filters: list[dict]) -> Column:
    """One predicate of a view's filters; a pushed-down `and` of comparisons."""
    return reduce(and_, [OPERATORS[f["operator"]](F.col(f["field"]), f.get("value")) for f in filters], F.lit(True))


def view(items: DataFrame, filters: list[dict], sort_by: str, direction: str, key: str) -> DataFrame:
    """A saved view: filtered and sorted, with the key as the last tiebreak."""
    order = F.col(sort_by).desc_nulls_last() if direction == "desc" else F.col(sort_by).asc_nulls_last()
    return items.filter(compile_filters(filters)).orderBy(order, key)


def live(items: DataFrame, tombstones: DataFrame | None = None, key: str = "job_id") -> DataFrame:
    rows = items.filter(~F.col("deleted"))
    return rows.join(tombstones, key, "left_anti") if tombstones is not None else rows


def folder_counts(items: DataFrame, folders: DataFrame, include_trash: bool = False) -> DataFrame:
    """(folder_id, n): members of each folder, zeros kept, folders that only items name added; then all, unfiled and trash.

    `items` has folder_ids array<string> and `deleted`.
    """
    seen = items if include_trash else items.filter(~F.col("deleted"))
    members = seen.select(F.explode("folder_ids").alias("folder_id")).groupBy("folder_id").agg(F.count("*").alias("n"))
    named = folders.select("folder_id").join(members, "folder_id", "full_outer").select("folder_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    totals = items.agg(
        F.count_if(F.lit(include_trash) | ~F.col("deleted")).alias("system-all"),
        F.count_if(~F.col("deleted") & (F.coalesce(F.size("folder_ids"), F.lit(0)) <= 0)).alias("system-unfiled"), F.count_if("deleted").alias("system-trash"),
    )
    return named.unionByName(totals.unpivot([], ["system-all", "system-unfiled", "system-trash"], "folder_id", "n"))


def ancestors(folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor, distance) along parent_id, at any distance; a walk ends where it meets a folder again. A folder that is its own parent is its ancestor.

    Distances are doubled: each step adds to the ancestors up to 2^k away those of the one that is
    2^k away, until no new ones come.
    """
    near = cut(folders.filter("parent_id is not null and parent_id <> folder_id").select("folder_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    reach, n = 1, near.count()
    while True:
        ends = near.filter(F.col("distance") == reach).select("folder_id", F.col("ancestor").alias("middle"))
        further = ends.join(near.select(F.col("folder_id").alias("middle"), "ancestor", (F.col("distance") + reach).alias("distance")), "middle").select("folder_id", "ancestor", "distance")
        near = cut(near.unionByName(further.filter("ancestor <> folder_id")).groupBy("folder_id", "ancestor").agg(F.min("distance").alias("distance")))
        before, n = n, near.count()
        if n == before:
            return near.unionByName(folders.filter("parent_id = folder_id").select("folder_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")).distinct())
        reach *= 2


def reparent(folders: DataFrame, gone: Column) -> DataFrame:
    """Folders without those that `gone` holds for; their children go to the nearest ancestor that stays."""
    removed = folders.filter(gone).select(F.col("folder_id").alias("r_id"), F.col("parent_id").alias("r_parent"))
    kept = folders.filter(~gone)
    return kept.join(removed, kept["parent_id"] == removed["r_id"], "left").select("folder_id", F.when(F.col("r_id").isNull(), F.col("parent_id")).otherwise(F.col("r_parent")).alias("parent_id"))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 12) -> DataFrame:
    """Page `page` of `rows`, clamped to the pages that there are."""
    total = F.broadcast(rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("pages")))
    ranked = rows.orderBy(*order).limit(max(1, page) * size).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    chosen = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages"))
    return ranked.join(total, F.lit(True)).filter((F.col("rn") > (chosen - 1) * size) & (F.col("rn") <= chosen * size)).drop("rn", "pages")


def vocabulary_filter(entries: DataFrame, text: str, status: str, tag: str) -> DataFrame:
    """Entries whose text holds `text`, of a status (all, unfiled, learning: not mastered, mastered) and with a tag if one is given."""
    low = F.lower(F.concat_ws(" ", "term", "meaning", "note"))
    keep = F.contains(low, F.lit(text.strip().lower()))
    if status == "unfiled":
        keep &= F.size("tags") <= 0
    elif status in ("learning", "mastered"):
        keep &= (F.col("status") == "mastered") if status == "mastered" else (F.col("status") != "mastered")
    return entries.filter(keep & (F.array_contains("tags", tag) if tag else F.lit(True)))
