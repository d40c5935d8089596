"""Updates of the library as tables: item operations, snapshots that are due, and assets by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated_items(ops: DataFrame, dropped: DataFrame) -> DataFrame:
    """(job, folders, deleted, purged, values) after `ops` (job, seq, op, name, value).

    Operations: `add` and `remove` a folder by name, `set` a property to a value (null clears it),
    `trash`, `restore`, `purge`. The last word on each folder, property and state counts; after a purge
    an item takes no operation and has nothing left. `dropped` (name) are deleted properties.
    """
    purge = ops.groupBy("job").agg(F.min(F.when(F.col("op") == "purge", F.col("seq"))).alias("purged_at"))
    live = ops.join(purge, "job").filter("purged_at is null or seq < purged_at")
    last = live.groupBy("job", F.when(F.col("op").isin("add", "remove"), "folder").when(F.col("op") == "set", "value").otherwise("state").alias("part"), F.when(F.col("op").isin("trash", "restore"), "").otherwise(F.col("name")).alias("name")).agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    last = last.join(F.broadcast(dropped.select("name").distinct().withColumn("part", F.lit("value"))), ["part", "name"], "left_anti")
    folder, value = (F.col("part") == "folder") & (F.col("x.op") == "add"), (F.col("part") == "value") & F.col("x.value").isNotNull()
    state = last.groupBy("job").agg(
        F.array_sort(F.collect_list(F.when(folder, F.col("name")))).alias("folders"), F.array_sort(F.collect_list(F.when(value, F.struct("name", "x.value")))).alias("values"),
        F.coalesce(F.max(F.when(F.col("part") == "state", F.col("x.op") == "trash")), F.lit(False)).alias("deleted"),
    )
    out = purge.join(state, "job", "left").withColumn("purged", F.col("purged_at").isNotNull())
    none, empty = F.array().cast("array<string>"), F.array().cast("array<struct<name:string,value:string>>")
    return out.select("job", F.when(~F.col("purged"), F.coalesce("folders", none)).otherwise(none).alias("folders"), (~F.col("purged") & F.coalesce("deleted", F.lit(False))).alias("deleted"), "purged", F.when(~F.col("purged"), F.coalesce("values", empty)).otherwise(empty).alias("values"))


def due_snapshots(docs: DataFrame, written: DataFrame) -> DataFrame:
    """The rows of `docs` (job, size, mtime, status, enabled) whose snapshot is to be written: valid, enabled, and not the ones `written` (job, size, mtime)."""
    wanted = docs.filter((F.coalesce("status", F.lit("")) != "FAIL") & F.coalesce("enabled", F.lit(True)))
    return wanted.join(written.select("job", "size", "mtime").distinct(), ["job", "size", "mtime"], "left_anti")


# How files of each type begin.
MAGIC = (("png", b"\x89PNG\r\n\x1a\n"), ("jpg", b"\xff\xd8\xff"), ("gif", b"GIF87a"), ("gif", b"GIF89a"))
LARGEST = 5 << 20


def asset_type(content: Column) -> Column:
    """png, jpg, gif or webp by how the bytes begin; null for others."""
    out = F.when((F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP")), "webp")
    for name, front in MAGIC:
        out = out.when(F.substring(content, 1, len(front)) == F.lit(front), name)
    return out


def stored_assets(files: DataFrame) -> DataFrame:
    """(ref, type, size, n): each different image of `files` (content) once, named by its SHA-256; empty, too large and other files are refused."""
    good = files.withColumn("type", asset_type(F.col("content"))).withColumn("size", F.octet_length("content").cast("bigint")).filter(F.col("type").isNotNull() & F.col("size").between(1, LARGEST))
    named = good.select(F.concat(F.lit("assets/"), F.sha2("content", 256), F.lit("."), F.col("type")).alias("ref"), "type", "size")
    return named.groupBy("ref", "type", "size").agg(F.count("*").alias("n"))
