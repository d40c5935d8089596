"""The keyed state of quire.operators.state on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.state import TRANSITIONS


def landing(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Files as they land in a folder, `files` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed them."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, key: str, size: str, slide: str, delay: str) -> DataFrame:
    """Events by key and sliding window; late ones count until the watermark has passed their window."""
    windows = events.withWatermark(at, delay).groupBy(F.window(at, size, slide), key).agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def job_states(events: DataFrame, key: str, event: str, order: str) -> DataFrame:
    """(key, status, applied) after each micro-batch: the job state machine as a stateful operator, a small state for each key."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, applied = state.get if state.exists else ("unparsed", 0)
        for rows in [pd.concat(batches).sort_values(order)]:
            for e in rows[event]:
                after = TRANSITIONS.get((status, e))
                if after is not None:
                    status, applied = after, applied + 1
        state.update((status, applied))
        yield pd.DataFrame({key: [name[0]], "status": [status], "applied": [applied]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, applied int", "status string, applied int", "update", GroupStateTimeout.NoTimeout)


def refresh(source: DataFrame, target: str, checkpoint: str, key: str, mark: str) -> StreamingQuery:
    """Keeps a Parquet index of the newest row of each key, version by version: a batch writes its rows beside the older ones, and `current` picks the newest."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.col(mark)).alias("r")).select("r.*")
        newest.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest version of each key in an index that `refresh` keeps."""
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col("epoch")).alias("r")).select("r.*").drop("batch", "epoch")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives, as a table in memory; for tests and small replays."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


Sink = Callable[[DataFrame, int], None]
