"""Keyed state and incremental updates as batch plans; quire.streaming runs the same logic on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Status after an event, by status before.
TRANSITIONS = {
    ("unparsed", "queue"): "queued", ("failed", "queue"): "queued", ("queued", "start"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed",
    ("running", "cancel"): "cancelling", ("cancelling", "stopped"): "cancelled", ("queued", "cancel"): "cancelled", ("cancelled", "queue"): "queued", ("completed", "queue"): "queued",
}


def index_changes(old: DataFrame, new: DataFrame, key: str = "key", mark: str = "fingerprint") -> DataFrame:
    """(key, change): insert, update, delete or keep, by comparing fingerprints."""
    a, b = old.select(key, F.col(mark).alias("f1")), new.select(key, F.col(mark).alias("f2"))
    change = F.when(F.col("f1").isNull(), "insert").when(F.col("f2").isNull(), "delete").when(F.col("f1") != F.col("f2"), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(target: DataFrame, rows: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """`target` with `rows` in place of those of equal key, and without the keys of `gone`."""
    kept = target.join(rows.select(key).distinct(), key, "left_anti")
    kept = kept.join(gone.select(key), key, "left_anti") if gone is not None else kept
    return kept.unionByName(rows)


def current_only(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of the latest generation of their key; late ones are dropped."""
    newest = results.groupBy(key).agg(F.max(generation).alias("newest"))
    return results.join(newest, key).filter(F.col(generation) == F.col("newest")).drop("newest")


def deltas(snapshots: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """What each snapshot adds to the one before; all of it if that isn't its beginning."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(seq))
    added = F.when(F.col(text).startswith(before), F.substring(F.col(text), F.length(before) + 1, F.length(text))).otherwise(F.col(text))
    return snapshots.select(key, seq, added.alias("delta"))


def reviews(events: DataFrame, key: str, order: Column, status: str, at: str) -> DataFrame:
    """(key, reviews, status, last): a counter, the last status and its time."""
    return events.groupBy(key).agg(F.count("*").alias("reviews"), F.max_by(status, order).alias("status"), F.max(at).alias("last"))


def stage_times(events: DataFrame, key: str, at: str, seq: str, stage: str) -> DataFrame:
    """(key, stage, seconds): time from each event to the next, summed by stage."""
    until = F.lead(at).over(Window.partitionBy(key).orderBy(at, seq))
    return events.withColumn("s", F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))).groupBy(key, stage).agg(F.round(F.sum("s") / 1e6, 3).alias("seconds"))


def with_cache(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, asked, hit): each key once, however often it was asked, and whether the cache has it."""
    once = requests.groupBy(key).agg(F.count("*").alias("asked"))
    return once.join(cache.select(key, F.lit(True).alias("hit")).distinct(), key, "left").select(key, "asked", F.coalesce("hit", F.lit(False)).alias("hit"))


def compare_and_set(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """(key, value, outcome): of the writes that expect the current revision the first wins; all others conflict."""
    revision = F.sha2(F.col("value").cast("binary"), 256)
    asked = writes.join(current.select(key, revision.alias("revision")), key, "left")
    fits = F.coalesce(F.col("expected") == F.col("revision"), F.lit(False))
    first = asked.filter(fits).groupBy(key).agg(F.min("seq").alias("winner"))
    return asked.join(first, key, "left").select(key, "seq", F.when(fits & (F.col("seq") == F.col("winner")), "updated").otherwise("conflict").alias("outcome"))


def replay(events: DataFrame, key: str, order: list[str], event: str, start: str = "unparsed", block: int = 1024) -> DataFrame:
    """(key, status, applied): the state machine run over each key's events in order; events that don't fit change nothing.

    What a run of events does to each of the few statuses is a small table, and tables of runs that
    follow each other combine: so a key's history is folded in blocks, and then their tables.
    """
    names = sorted({start, *(a for a, _ in TRANSITIONS), *TRANSITIONS.values()})
    table = F.create_map(*[F.lit(x) for (a, b), c in TRANSITIONS.items() for x in (f"{a}>{b}", c)])
    numbered = events.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / block))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, event))), lambda x: x[event])

    def step(acc: Column, e: Column) -> Column:
        after = F.try_element_at(table, F.concat_ws(">", acc["status"], e))
        return F.struct(F.coalesce(after, acc["status"]).alias("status"), (acc["applied"] + F.when(after.isNotNull(), 1).otherwise(0)).alias("applied"))

    def from_status(name: str) -> Column:
        return F.aggregate(ordered, F.struct(F.lit(name).alias("status"), F.lit(0).alias("applied")), step)

    runs = numbered.groupBy(key, "block").agg(F.create_map(*[x for n in names for x in (F.lit(n), from_status(n))]).alias("run"))

    def follow(acc: Column, run: Column) -> Column:
        after = F.element_at(run, acc["status"])
        return F.struct(after["status"].alias("status"), (acc["applied"] + after["applied"]).alias("applied"))

    tables = F.transform(F.array_sort(F.collect_list(F.struct("block", F.map_entries("run").alias("run")))), lambda x: F.map_from_entries(x["run"]))
    state = F.aggregate(tables, F.struct(F.lit(start).alias("status"), F.lit(0).alias("applied")), follow)
    return runs.groupBy(key).agg(state.alias("s")).select(key, "s.status", "s.applied")


def latest_revision(history: DataFrame, key: str, revision: str, value: str) -> DataFrame:
    return history.groupBy(key).agg(F.max(revision).alias(revision), F.max_by(value, revision).alias(value))


def vocabulary(entries: DataFrame) -> DataFrame:
    """One entry for each language and term key: the first's id, all sources once, the last time."""
    term = T.canonical(F.col("term"))
    return entries.groupBy("language", term.alias("term_key")).agg(F.min_by("id", F.struct("at", "id")).alias("id"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("at").alias("updated"))


def propagated(rows: DataFrame, changes: DataFrame, on: str, column: str) -> DataFrame:
    """`rows` with the changed style of their action, where they aren't a suggestion."""
    new = changes.select(on, F.col(column).alias("new"))
    both = rows.join(new, on, "left")
    return both.withColumn(column, F.when(F.col("source") != "ai", F.coalesce("new", column)).otherwise(F.col(column))).drop("new")


def reconciled(suggested: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """(keys, action): suggestions against what there is: add, keep, ignored stays ignored, and what isn't suggested any more goes."""
    a, b = suggested.select(*on, F.lit(True).alias("s")), existing.select(*on, "state")
    both = a.distinct().join(b, on, "full_outer")
    return both.select(*on, F.when(F.col("state") == "ignored", "ignored").when(F.col("state").isNull(), "add").when(F.col("s").isNull(), "drop").otherwise("keep").alias("action"))
