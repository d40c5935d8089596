"""A paginated source: ranges of a remote list as partitions, with checks that the list held still."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(start, limit) -> (version of the list, total, rows as dicts)
Fetch = Callable[[int, int], tuple[str, int, list[dict]]]


class _Range(InputPartition):
    def __init__(self, start: int, limit: int, version: str, total: int) -> None:
        self.start, self.limit, self.version, self.total = start, limit, version, total


def paged_source(name: str, fetch: Fetch, schema: str, fields: list[str], page: int = 100, most: int = 1_000_000) -> type[DataSource]:
    """A DataSource class to register: one partition for each page; a list that changes while it is read, or is too long, is an error."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            version, total, _ = fetch(0, 1)
            if total > most:
                raise ValueError(f"{name}: {total} rows; at most {most} are read")
            return [_Range(i, page, version, total) for i in range(0, total, page)] or [_Range(0, 0, version, 0)]

        def read(self, partition: _Range) -> Iterator[tuple]:
            if not partition.limit:
                return
            version, total, rows = fetch(partition.start, partition.limit)
            if (version, total) != (partition.version, partition.total):
                raise RuntimeError(f"{name}: the list changed while it was read")
            for row in rows:
                yield tuple(row.get(f) for f in fields)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    return Source


def read_paged(spark: SparkSession, source: type[DataSource], key: str) -> DataFrame:
    """The rows of a paged source; a key that occurs twice is an error when they are read."""
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).load()
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"{source.name()}: {key} is not unique")
    return rows
