"""A kept search index in segments: postings with places by token, refreshed by fingerprint, merged by size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut, exists, names, remove, shared_path

from . import search

KEY = ["job_id", "kind", "source_id"]
#: Rows of tombstones that are broadcast; more are shuffled.
_FEW = 10_000
#: Sources whose tokens are grouped at once.
_ROWS = 500
_MANIFEST = "generation bigint, version string, place int, id string, n bigint, gone bigint, live bigint, sized bigint, total bigint"


@dataclass(frozen=True)
class Segment:
    """Sources that were written at once. `place`: a tombstone hides the sources of lower places; n: sources in it, gone: tombstones in it."""

    place: int
    id: str
    n: int
    gone: int


@dataclass(frozen=True)
class Manifest:
    """The segments of a generation, oldest first, and statistics of the sources that no tombstone hides: their number, the number of those with a text and of their tokens."""

    generation: int
    version: str | None
    segments: tuple[Segment, ...]
    live: int
    sized: int
    total: int


def to_merge(sizes: list[int], fan: int) -> int:
    """How many of the newest segments are to be made one, so that no `fan` of one tier (power of `fan`) stand at the end, but for smaller ones between them; what they make counts in its own tier."""

    def tier(n: int) -> int:
        return int(math.log(max(n, 1), fan) + 1e-9)

    taken = 0
    while True:
        merged = [sum(sizes[len(sizes) - taken :])] if taken else []
        rest = [*sizes[: len(sizes) - taken], *merged]
        for t in sorted({tier(n) for n in rest}):
            k = next((k for k, n in enumerate(reversed(rest)) if tier(n) > t), len(rest))
            if sum(tier(n) == t for n in rest[len(rest) - k :]) >= fan:
                taken = k - len(merged) + taken
                break
        else:
            return taken


def _postings_of(sources: DataFrame) -> DataFrame:
    """(token, key, size, places) of sources with their tokens. Each source is grouped where it lies, so that occurrences are never shuffled."""

    def grouped(rows: pa.RecordBatch) -> pa.RecordBatch:
        tokens = rows["tokens"]
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(tokens.flatten())
        row = np.repeat(np.arange(rows.num_rows), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        token = coded.dictionary.take(coded.indices.take(pa.array(order[first])))
        of = pa.array(row[order[first]])
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place[order], pa.int32()))
        return pa.RecordBatch.from_arrays([token, *(rows[k].take(of) for k in (*KEY, "size")), places], names=["token", *KEY, "size", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (grouped(batch.slice(at, _ROWS)) for at in range(0, batch.num_rows, _ROWS))

    kinds = dict(sources.dtypes)
    return sources.mapInArrow(run, f"token string, {', '.join(f'{k} {kinds[k]}' for k in KEY)}, size int, places array<int>")


class SearchIndex:
    """The index of one set of sources (job_id, kind, source_id, text) under a path that all executors share.

    A refresh writes what is new as one segment and leaves the others alone. A segment has
    `documents` (each source with its size and fingerprint), `postings` (token, key, size, places;
    ranged by token and source, so that a frequent token's postings are spread over files, with the
    tokens that each file holds in `ranges`), and `gone`: the keys that it replaces or deletes in older
    segments. Segments of like size are merged when `fan` of them have come together, and all of
    them when half of the sources are hidden, so that their number grows with the logarithm of the
    sources. A generation is a small table that names its segments; it is written last, under a name
    that only one writer can take: a reader sees the old or the new one. Folders that the last two
    generations don't name are removed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = 4) -> None:
        self.spark, self.path, self.fan = spark, path or shared_path(spark, "index"), fan
        self._seen: Manifest | None = None

    def current(self) -> Manifest | None:
        """The newest generation; None before the first refresh."""
        at = f"{self.path}/manifest"
        found = max((int(g) for g in names(self.spark, at) if exists(self.spark, f"{at}/{g}/_SUCCESS")), default=None)
        if found is None:
            return None
        if self._seen is None or self._seen.generation != found:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{at}/{found}").orderBy("place").collect()  # a row for each segment
            own = tuple(Segment(r["place"], r["id"], r["n"], r["gone"]) for r in rows if r["id"])
            self._seen = Manifest(found, rows[0]["version"], own, rows[0]["live"], rows[0]["sized"], rows[0]["total"])
        return self._seen

    # --- tables of a generation ---

    def _part(self, segment: Segment, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.id}/{table}").withColumn("place", F.lit(segment.place))

    def _all(self, segments: tuple[Segment, ...], table: str, columns: list[str]) -> DataFrame | None:
        parts = [self._part(s, table).select(*columns, "place") for s in segments if (s.gone if table == "gone" else s.n)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _seen_of(self, rows: DataFrame, segments: tuple[Segment, ...], own: str = "place") -> DataFrame:
        """`rows` that no tombstone of a later segment hides."""
        gone = self._all(segments, "gone", KEY)
        if gone is None:
            return rows
        last = gone.groupBy(*KEY).agg(F.max("place").alias("hidden"))
        hidden = F.broadcast(last) if sum(s.gone for s in segments) <= _FEW else last
        on = reduce(and_, [rows[k].eqNullSafe(hidden[k]) for k in KEY]) & (hidden["hidden"] > rows[own])
        return rows.join(hidden, on, "left_anti")

    def documents(self) -> DataFrame:
        """(job_id, kind, source_id, text, mark, size) of all sources."""
        now = self.current()
        columns = [*KEY, "text", "mark", "size"]
        rows = self._all(now.segments, "documents", columns)
        if rows is None:
            return self.spark.createDataFrame([], "job_id string, kind string, source_id string, text string, mark bigint, size int")
        return self._seen_of(rows, now.segments).select(*columns)

    def _postings(self, tokens: list[str]) -> DataFrame | None:
        """Postings of these tokens, from the files that can hold them."""
        now, parts = self.current(), []
        for segment in now.segments:
            if not segment.n:
                continue
            ranges = self.spark.read.parquet(f"{self.path}/segments/{segment.id}/ranges")
            holds = reduce(lambda a, b: a | b, [(F.col("low") <= t) & (F.col("high") >= t) for t in tokens])
            files = [r["file"] for r in ranges.filter(holds).select("file").collect()]  # names of the files that are read next
            if files:
                at = f"{self.path}/segments/{segment.id}/postings"
                rows = self.spark.read.parquet(*[f"{at}/{f}" for f in files]).filter(F.col("token").isin(tokens))
                parts.append(rows.withColumn("at", F.lit(segment.place)))
        return self._seen_of(reduce(DataFrame.unionByName, parts), now.segments, "at").drop("at") if parts else None

    # --- refresh ---

    def refresh(self, sources: DataFrame, version: str | None = None) -> dict[str, int]:
        """Brings the index to `sources` and counts what was inserted, updated, deleted and kept.

        Only new texts are tokenised and written, and nothing is if nothing changed. `version`: a
        name of the state of `sources`; where the index has it already, they aren't read.
        """
        now = self.current()
        counts = {"insert": 0, "update": 0, "delete": 0, "keep": 0}
        if now and version is not None and now.version == version:
            return counts | {"keep": now.live}
        new = sources.select(*KEY, "text", F.xxhash64("text").alias("mark"))
        if now and now.segments:
            old = self.documents().select(*KEY, F.col("mark").alias("old"), F.col("size").alias("old_size"), F.lit(True).alias("there"))
            here = new.select(*KEY, "mark", F.lit(True).alias("here")).alias("n")
            on = reduce(and_, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY])
            both = here.join(old.alias("o"), on, "full_outer")
            change = F.when(F.col("there").isNull(), "insert").when(F.col("here").isNull(), "delete").when(~F.col("mark").eqNullSafe(F.col("old")), "update").otherwise("keep")
            key = [F.when(F.col("here"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in KEY]
            both = both.select(*key, change.alias("change"), "old_size")
        else:
            both = new.select(*KEY, F.lit("insert").alias("change"), F.lit(None).cast("int").alias("old_size"))
        told = cut(both.filter("change <> 'keep'"))
        tally = told.groupBy("change").agg(F.count("*").alias("n"), F.count("old_size").alias("sized"), F.coalesce(F.sum("old_size"), F.lit(0)).alias("total")).collect()  # three rows at most
        counts |= {r["change"]: r["n"] for r in tally}
        counts["keep"] = (now.live if now else 0) - counts["update"] - counts["delete"]
        lost_sized, lost_total = sum(r["sized"] for r in tally), sum(r["total"] for r in tally)
        if now and not tally:
            if version is not None:
                self._publish(Manifest(now.generation + 1, version, now.segments, now.live, now.sized, now.total))
            return counts
        place = now.segments[-1].place + 1 if now and now.segments else 1
        fresh = told.filter("change in ('insert', 'update')").select(*KEY)
        on = reduce(and_, [new[k].eqNullSafe(fresh[k]) for k in KEY])
        added = new.join(fresh, on, "left_semi") if now and now.segments else new
        segment, sized, total = self._written(added, told.filter("change in ('update', 'delete')").select(*KEY), place)
        segments = (*(now.segments if now else ()), segment)
        before = (now.live, now.sized, now.total) if now else (0, 0, 0)
        live = before[0] + counts["insert"] - counts["delete"]
        self._publish(Manifest(now.generation + 1 if now else 1, version, self._merged(segments, live), live, before[1] + sized - lost_sized, before[2] + total - lost_total))
        return counts

    def _written(self, added: DataFrame, gone: DataFrame, place: int) -> tuple[Segment, int, int]:
        """A segment of sources; with the number of those with a text and of their tokens."""
        return self._stored(added.select(*KEY, "text", "mark"), None, gone, place)

    def _stored(self, documents: DataFrame, postings: DataFrame | None, gone: DataFrame, place: int) -> tuple[Segment, int, int]:
        """A segment of these tables; where documents have no sizes yet and there are no postings, both are made of the texts, the postings from the documents as they are written."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        dealt = documents.repartitionByRange("source_id").sortWithinPartitions("source_id")
        if postings is None:
            dealt = dealt.withColumn("size", F.size(T.lexical_tokens(F.col("text"))))
        dealt.write.parquet(f"{at}/documents")
        if postings is None:
            postings = _postings_of(self.spark.read.parquet(f"{at}/documents").select(*KEY, "size", T.lexical_tokens(F.col("text")).alias("tokens")))
        postings.select("token", *KEY, "size", "places").repartitionByRange("token", "source_id").sortWithinPartitions("token", "source_id").write.parquet(f"{at}/postings")
        held = self.spark.read.parquet(f"{at}/postings").select("token", F.col("_metadata.file_name").alias("file"))
        held.groupBy("file").agg(F.min("token").alias("low"), F.max("token").alias("high")).coalesce(1).write.parquet(f"{at}/ranges")
        gone.coalesce(1).write.parquet(f"{at}/gone")
        kept = self.spark.read.parquet(f"{at}/documents").agg(F.count("*").alias("n"), F.count("size").alias("sized"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
        stats = kept.join(F.broadcast(self.spark.read.parquet(f"{at}/gone").agg(F.count("*").alias("gone"))), F.lit(True)).first()
        return Segment(place, name, stats["n"], stats["gone"]), stats["sized"], stats["total"]

    def _merged(self, segments: tuple[Segment, ...], live: int) -> tuple[Segment, ...]:
        """`segments` after the merge that their sizes ask for, if any."""
        k = to_merge([s.n + s.gone for s in segments], self.fan)
        if len(segments) > 1 and 2 * live < sum(s.n for s in segments):
            k = len(segments)
        if k < 2:
            return segments
        older, newest = segments[: len(segments) - k], segments[len(segments) - k :]
        documents = self._seen_of(self._all(newest, "documents", [*KEY, "text", "mark", "size"]), newest).drop("place")
        postings = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/segments/{s.id}/postings").withColumn("at", F.lit(s.place)) for s in newest if s.n])
        postings = self._seen_of(postings, newest, "at").drop("at")
        gone = self._all(newest, "gone", KEY)
        # Tombstones are kept for as long as there are older segments that they can hide something in.
        gone = gone.select(*KEY).distinct() if older and gone is not None else documents.select(*KEY).limit(0)
        made, _, _ = self._stored(documents, postings, gone, newest[-1].place)
        return (*older, made)

    def _publish(self, made: Manifest) -> None:
        last = self.current()
        rows = [(made.generation, made.version, s.place, s.id, s.n, s.gone, made.live, made.sized, made.total) for s in made.segments]
        rows = rows or [(made.generation, made.version, 0, None, 0, 0, made.live, made.sized, made.total)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{made.generation}")  # fails if another writer took the generation
        kept = {s.id for m in (made, last) if m for s in m.segments}
        for name in names(self.spark, f"{self.path}/segments"):
            if name not in kept:
                remove(self.spark, f"{self.path}/segments/{name}")
        for old in names(self.spark, f"{self.path}/manifest"):
            if int(old) < made.generation - 1:
                remove(self.spark, f"{self.path}/manifest/{old}")

    # --- search ---

    def _hits(self, wanted: list[list[str]]) -> DataFrame | None:
        """(key, size, tf0, tf1, ...) of the sources that hold a token of the query."""
        tokens = sorted({t for p in wanted for t in p})
        rows = self._postings(tokens)
        if rows is None:
            return None
        name = {t: f"p{i}" for i, t in enumerate(tokens)}
        by_source = rows.groupBy(*KEY).agg(F.first("size").alias("size"), *[F.first(F.when(F.col("token") == t, F.col("places")), ignorenulls=True).alias(name[t]) for t in tokens])

        def count(phrase: list[str]) -> Column:
            def begins(k: int) -> Column:
                return F.transform(name[phrase[k]], lambda place: place - k)

            starts = [begins(k) for k in range(len(phrase))]
            return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0))

        return by_source.select(*KEY, "size", *[F.greatest(count(p), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(wanted)])

    def search(self, query: str = "", limit: int = 30, offset: int = 0, kinds: list[str] | None = None, folder_items: DataFrame | None = None) -> DataFrame:
        """The page of hits that `search.search` gives of the same sources. Statistics and keys of the page (100 at most) are found at once; only its texts are read later."""
        search.checked(limit, offset, kinds)
        wanted = search.phrases(query)
        hits = self._hits(wanted) if wanted else None
        if hits is None:
            all_of = self.documents().select(*KEY, "text")
            return search.search(all_of if not wanted else all_of.limit(0), query, limit, offset, kinds, folder_items)
        now = self.current()
        hits = cut(hits)
        df = hits.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
        found = hits.filter(reduce(and_, [F.col(f"tf{i}") > 0 for i in range(len(wanted))]))
        if kinds is not None:
            found = found.filter(F.col("kind").isin(kinds))
        if folder_items is not None:
            found = found.join(folder_items.select("job_id").distinct(), "job_id", "left_semi")
        known = {"n": F.lit(now.live), "mean": F.lit(now.total / now.sized if now.sized else 0.0)} | {f"df{i}": F.lit(df[i]) for i in range(len(wanted))}
        scored = found.withColumns(known).withColumn("score", search.bm25(len(wanted))).select(*KEY, "score")
        page = scored.orderBy("score", "job_id", "source_id").offset(offset).limit(limit)
        rows = page.crossJoin(F.broadcast(scored.agg(F.count("*").alias("total")))).collect()  # a page has at most 100 rows
        hit = self.spark.createDataFrame([tuple(r) for r in rows], scored.withColumn("total", F.lit(0).cast("bigint")).schema)
        texts = self.documents().filter(F.col("source_id").isin([r["source_id"] for r in rows])).select(*KEY, "text")
        return texts.join(F.broadcast(hit), KEY).orderBy("score", "job_id", "source_id").select(*KEY, F.round("score", 6).alias("score"), T.snippet(F.col("text"), query).alias("snippet"), "total")
