"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut as materialise
from quire.session import shared_dir, shared_path

__all__ = ["materialise", "shared_dir", "shared_path"]

#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: A benchmark is broadcast in blocks of at most this many shingles.
BROADCAST_ROWS = 200_000
#: A table of at most this many bytes, by its counted rows, may be broadcast; a larger one is shuffled.
BROADCAST_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Equi-join that broadcasts `small`, a table of numbers, only if its counted rows have at most BROADCAST_BYTES."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n * (16 + 8 * len(small.columns)) <= BROADCAST_BYTES else small.hint("merge"), on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """array<bigint>: the sum of the elements up to and with each one; blocks keep the work far below the square of the length."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def within(blocks: Column) -> Column:
        return let(
            F.transform(blocks, total),
            lambda totals: F.flatten(
                F.transform(
                    blocks,
                    lambda block, b: let(
                        total(F.slice(totals, 1, b)),
                        lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, 1, i + 1))),
                    ),
                )
            ),
        )

    def split(array: Column) -> Column:
        starts = F.sequence(F.lit(0), (F.size(array) - 1).cast("int"), F.lit(_BLOCK))
        return let(F.transform(starts, lambda s: F.slice(array, s + 1, _BLOCK)), within)

    return let(numbers, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(split(a)))


MATCH = "array<struct<start:bigint,end:bigint,text:string>>"


def matches(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None, word: str | None = None) -> Column:
    """Leftmost non-overlapping matches of `pattern` that `valid` accepts, with code-point offsets (end exclusive).

    `pattern` must not match the empty string. The lengths between the matches come from splitting
    the text at the same matches, so that every offset is a running sum. `word`: text without this
    string can't match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(MATCH)

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g")), lambda z: (F.length(z["g"]) + F.length(z["h"])).cast("bigint"))
        ends = running_sums(steps)
        rows = F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text"))).cast(MATCH)
        return F.filter(rows, lambda r: valid(r["text"])) if valid else rows

    wanted = (lambda h: F.exists(h, valid)) if valid else (lambda h: F.size(h) > 0)
    out = let(found, lambda h: F.when(wanted(h), placed(h)).otherwise(none))
    return F.when(F.contains(text, F.lit(word)), out).otherwise(none) if word else out


SPAN = "array<struct<start:bigint,k:int,end:bigint,kind:string,text:string>>"


def as_spans(found: Column, k: int, kind: str) -> Column:
    return F.transform(
        found, lambda r: F.struct(r["start"].alias("start"), F.lit(k).alias("k"), r["end"].alias("end"), F.lit(kind).alias("kind"), r["text"].alias("text"))
    ).cast(SPAN)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then by the order of kinds."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """`text` with each span, or run of overlapping spans, replaced by [KIND] of its first."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(
        F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    )


#: Rows of an Arrow batch, unless the session sets another number than Spark's own: texts are long, and workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)
_BATCHES, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, for which Arrow batches have at most BATCH_ROWS rows and BATCH_BYTES bytes."""
    conf = df.sparkSession.conf
    if conf.get(_BATCHES) == "10000":
        conf.set(_BATCHES, BATCH_ROWS)
        conf.set(_BYTES, BATCH_BYTES)
    return df


def map_rows(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = one(batch)
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)

    return small_batches(df).mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes, null as empty; none of them is copied into a second array."""
    for x in column.cast(pa.large_binary()) if column.type not in (pa.binary(), pa.large_binary()) else column:
        yield x.as_py() or b""


_digest = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n hashes; n must not be over len(words)."""
    if n == 1:
        return mix(words)
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * _M1 + words[i : len(words) - n + 1 + i])
    return out


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n, in about 2 log2(n) passes: runs of powers of two are put together from halves."""
    m = len(words) - n + 1
    if m <= 0:
        return words[:0]
    part, size, out, done = mix(words), 1, None, 0
    while size <= n:
        if n & size:
            out = part[:m].copy() if out is None else mix(out * _M1 + part[done : done + m])
            done += size
        if size * 2 <= n:
            part = mix(part[:-size] * _M1 + part[size:] + np.uint64(size))
        size *= 2
    return mix(out + np.uint64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
