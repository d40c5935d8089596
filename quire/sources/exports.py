"""Outputs of documents, kept by the fingerprint of what they were made from: only what changed is made again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut, exists, names, remove

#: From the stored content of one version to that of the next: a Column function of the content.
Migration = Callable[[Column], Column]
_STATE = "key string, mark bigint, version int, run string"


class Exports:
    """The outputs (key, content) of one stage under a path that all executors share.

    `state` names for each document the run that holds its output, the fingerprint of its input and the
    version of the output's form; a run holds what was written at once. A refresh compares
    fingerprints, makes and writes the outputs of changed documents alone, and brings those of an older
    version up by the migrations, one after the other, without their inputs. State is
    written last, under a number that only one writer can take, so that readers see whole refreshes;
    runs that nothing names any more go.
    """

    def __init__(self, spark: SparkSession, path: str, version: int = 1, migrations: dict[int, Migration] | None = None) -> None:
        self.spark, self.path, self.version, self.migrations = spark, path.rstrip("/"), version, migrations or {}

    def _numbers(self) -> list[int]:
        at = f"{self.path}/state"
        return sorted(int(n) for n in names(self.spark, at) if exists(self.spark, f"{at}/{n}/_SUCCESS"))

    def state(self) -> DataFrame:
        """(key, mark, version, run) of every document that has an output."""
        numbers = self._numbers()
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/state/{numbers[-1]}") if numbers else self.spark.createDataFrame([], _STATE)

    def outputs(self) -> DataFrame:
        """(key, content) of all documents, each from the run that its state names."""
        state = self.state()
        runs = [r["run"] for r in state.select("run").distinct().collect()]  # runs, not documents
        if not runs:
            return self.spark.createDataFrame([], "key string, content string")
        rows = self.spark.read.parquet(*[f"{self.path}/runs/{r}" for r in runs])
        return rows.join(state.select("key", "run"), ["key", "run"], "left_semi").select("key", "content")

    def _migrated(self, content: Column, version: Column) -> Column:
        for v in range(1, self.version):
            if v in self.migrations:
                content = F.when(version <= v, self.migrations[v](content)).otherwise(content)
        return content

    def refresh(self, inputs: DataFrame, parts: list[str], render: Callable[[DataFrame], DataFrame], most_runs: int = 8) -> dict[str, int]:
        """Brings the outputs to `inputs` (key and other columns; `parts` make up the fingerprint) and counts what was made, migrated, kept and dropped.

        `render` gives (key, content) from the inputs of changed documents. An output of a version
        from which no chain of migrations leads here is made again. Rows of one document count as a
        set; those with a null key are left out. Above `most_runs` runs all outputs are written as one.
        """
        inputs = inputs.filter("key is not null").withColumn("key", F.col("key").cast("string"))
        marks = [F.sum(F.xxhash64(F.lit(k), *parts).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
        new = inputs.groupBy("key").agg(F.count("*").alias("n"), *marks).select("key", F.xxhash64("n", "s0", "s1").alias("mark"))
        reachable = [v for v in range(1, self.version) if all(w in self.migrations for w in range(v, self.version))]
        old = self.state().withColumnsRenamed({"mark": "old", "version": "was"})
        both = cut(new.join(old, "key", "full_outer"))
        what = F.when(F.col("mark").isNull(), "drop").when(~F.col("mark").eqNullSafe(F.col("old")), "make").when(F.col("was") == self.version, "keep").when(F.col("was").isin(reachable), "migrate").otherwise("make")
        both = both.withColumn("what", what)
        counts = dict.fromkeys(("make", "migrate", "keep", "drop"), 0) | {r["what"]: r["n"] for r in both.groupBy("what").agg(F.count("*").alias("n")).collect()}  # four rows
        runs = [r["run"] for r in both.filter("what in ('keep', 'migrate')").select("run").distinct().collect()]
        if not counts["make"] + counts["migrate"] + counts["drop"]:
            return counts
        name, written = uuid.uuid4().hex, []
        if counts["make"]:
            changed = inputs.join(both.filter("what = 'make'").select("key"), "key", "left_semi")
            written.append(render(changed).select(F.col("key").cast("string").alias("key"), "content"))
        whole = len(runs) + 1 > most_runs
        moved = "what in ('keep', 'migrate')" if whole else "what = 'migrate'"
        if runs and (counts["migrate"] or whole):
            stored = self.spark.read.parquet(*[f"{self.path}/runs/{r}" for r in runs]).join(both.filter(moved).select("key", "run", "was"), ["key", "run"])
            written.append(stored.select("key", self._migrated(F.col("content"), F.col("was")).alias("content")))
        if written:
            reduce(DataFrame.unionByName, written).withColumn("run", F.lit(name)).write.parquet(f"{self.path}/runs/{name}")
        stays = (F.col("what") == "keep") & F.lit(not whole)
        state = both.filter("what <> 'drop'").select("key", F.coalesce("mark", "old").alias("mark"), F.lit(self.version).alias("version"), F.when(stays, F.col("run")).otherwise(F.lit(name)).alias("run"))
        number = (self._numbers() or [0])[-1] + 1
        state.write.parquet(f"{self.path}/state/{number}")  # fails if another writer took the number
        for n in self._numbers()[:-2]:
            remove(self.spark, f"{self.path}/state/{n}")
        named = {name, *(r["run"] for n in self._numbers() for r in self.spark.read.parquet(f"{self.path}/state/{n}").select("run").distinct().collect())}
        for run in names(self.spark, f"{self.path}/runs"):
            if run not in named:
                remove(self.spark, f"{self.path}/runs/{run}")
        return counts
