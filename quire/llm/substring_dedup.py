"""Substring dedup: removes spans that an earlier document already has, found by suffix automata of reference shards.

Every window of `length` words is assigned to one shard by its minimiser, the least hash of the
runs of `seed` words inside it: equal windows have equal minimisers wherever they stand, so a shard
holds all occurrences of its windows and no other shard needs to be read. Consecutive windows with
one minimiser form a passage. Only shards that passages of two documents or more reach are kept.
For each shard a suffix automaton over words is built from its distinct passages, where every state
knows the least document id among its occurrences; each passage is then streamed through it, and the
matching statistic at each word - the state of the longest suffix of at least `length` words - tells
the earliest document with that window. The reference is the whole corpus and grows with it, so
shards are dealt out by minimiser where a fixed reference would be broadcast shard by shard. A shard
of more than `most` distinct passages (a phrase that very many documents share) isn't put together in
one task: its windows are counted one by one by the hash of their words, which gives the same result.

A window is judged on the input: it goes if its words also start in a document of smaller id. A
document is left without the words that such windows cover. Null or empty texts have no words, an
empty table gives an empty result, extra columns are left out, and ids must be unique (rows with one
id are never held against each other; each loses what windows of either cover).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Windows of one passage; longer runs of one minimiser are cut.
_LONGEST = 1024

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def passages(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Minimiser, body hash, first word and number of windows of each passage of a document."""
    m = len(words) - length + 1
    if m <= 0:
        return None
    low = c.rolling_hashes(words, seed)
    width, size = length - seed + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:m], low[width - size : width - size + m])
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    n = np.diff(np.append(start, m))
    if n.max() > _LONGEST:
        start = np.concatenate([np.arange(s, s + k, _LONGEST) for s, k in zip(start.tolist(), n.tolist(), strict=True)])
        n = np.diff(np.append(start, m))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(c.mix(words) * _powers(_ODD, len(words)), out=total[1:])
    body = c.mix((total[start + n + length - 1] - total[start]) * _powers(_INVERSE, len(words))[start] + n.astype(np.uint64))
    return low[start], body, start, n


def _passages(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), c.texts_of(batch.column(1)), strict=True):
            if doc_id is None or (got := passages(c.word_hashes(text.split()), length, seed)) is None:
                continue
            found.append(got)
            ids.append(np.full(len(got[0]), doc_id))
            size += len(got[0])
            if size > 500_000:
                yield pack(found, ids)
                found, ids, size = [], [], 0
        if found:
            yield pack(found, ids)

    def pack(found: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        mini, body, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c.signed(mini)), pa.array(c.signed(body)), pa.array(np.concatenate(ids)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["mini", "body", "doc_id", "at", "n"]
        )

    return c.map_rows(docs, run, "mini bigint, body bigint, doc_id bigint, at int, n int")


class Automaton:
    """Suffix automaton of several word sequences; `first` of a state is the least id of a sequence that has its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.long, self.first = [-1], [0], [None]
        self.last = 0

    def _state(self, long: int, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.long.append(long)
        self.first.append(self.first[copy] if copy is not None else None)
        return len(self.long) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.long[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc_id: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.long[q] == self.long[last] + 1 else self._split(last, word, q)
            else:
                p, new = last, self._state(self.long[last] + 1)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.long[q] == self.long[p] + 1 else self._split(p, word, q)
                last = new
            if self.first[last] is None or doc_id < self.first[last]:
                self.first[last] = doc_id

    def settle(self) -> None:
        """Hands each state's least id to its suffixes."""
        for v in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and (self.first[up] is None or self.first[v] < self.first[up]):
                self.first[up] = self.first[v]

    def earliest(self, words: list[bytes], length: int) -> list[int | None]:
        """For each window of `length` words of `words`: the least id of a sequence that has it."""
        out, v, matched = [], 0, 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.long[v]
            if word in self.next[v]:
                v = self.next[v][word]
                matched += 1
            while v and self.long[self.link[v]] >= length:
                v = self.link[v]
                matched = self.long[v]
            if i >= length - 1:
                out.append(self.first[v] if matched >= length else None)
        return out


def _spans(first: list[int | None]) -> list[dict]:
    """Runs of windows with one earliest document."""
    out: list[dict] = []
    for i, x in enumerate(first):
        if x is None:
            continue
        if out and out[-1]["first"] == x and out[-1]["end"] == i:
            out[-1]["end"] = i + 1
        else:
            out.append({"first": x, "start": i, "end": i + 1})
    return out


def _match(shards: DataFrame, length: int) -> DataFrame:
    """(mini, body, n, spans) of each distinct passage: its windows by earliest document. The rows come ordered by shard, and one shard is held at a time."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            automaton = Automaton()
            texts = [text.split() for *_, text in group]
            for (_, _, _, doc_id, _), words in zip(group, texts, strict=True):
                automaton.add(words, doc_id)
            automaton.settle()
            done.extend((*row[:3], _spans(automaton.earliest(words, length))) for row, words in zip(group, texts, strict=True))
            group.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), kind), strict=True)], ["mini", "body", "n", "spans"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                    if len(done) > 20_000:
                        yield flush()
                group.append(row)
        if group:
            close()
        if done:
            yield flush()

    rows = c.small_batches(shards).repartition("mini").sortWithinPartitions("mini", "doc_id")
    return rows.mapInArrow(run, "mini bigint, body bigint, n int, spans array<struct<first:bigint,start:int,end:int>>")


def _contents(docs: DataFrame, bodies: DataFrame, length: int) -> DataFrame:
    """(mini, body, n, doc_id, text) of each distinct passage, read from the first document that has it."""
    owned = bodies.groupBy("doc_id").agg(F.collect_list(F.struct("mini", "body", "n", "at")).alias("own"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc_id, text, own in zip(batch.column(0).to_pylist(), c.texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            out.extend((p["mini"], p["body"], p["n"], doc_id, b" ".join(words[p["at"] : p["at"] + p["n"] + length - 1])) for p in own)
        columns = list(zip(*out, strict=True))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["mini", "body", "n", "doc_id", "text"])

    return c.map_rows(docs.join(owned.hint("merge"), "doc_id"), run, "mini bigint, body bigint, n int, doc_id bigint, text binary")


def _match_large(shards: DataFrame, length: int) -> DataFrame:
    """What _match gives, for shards of many passages: the least document id of each window by aggregation over all tasks."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for mini, body, n, doc_id, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            hashes = c.signed(c.mix(c.rolling_hashes(c.word_hashes(text.split()), length) + np.uint64(mini & (1 << 64) - 1)))
            same = [pa.array(np.full(len(hashes), x, t)) for x, t in ((mini, np.int64), (body, np.int64), (n, np.int32), (doc_id, np.int64))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(hashes), dtype=np.int32)), pa.array(hashes)], ["mini", "body", "n", "doc_id", "start", "window"])

    windows = c.materialise(c.map_rows(shards, run, "mini bigint, body bigint, n int, doc_id bigint, start int, window bigint"))
    first = c.materialise(windows.groupBy("window").agg(F.min("doc_id").alias("first")))
    span = F.struct("first", "start", (F.col("start") + 1).alias("end"))
    return windows.join(first, "window").groupBy("mini", "body", "n").agg(F.collect_list(span).alias("spans"))  # of one passage, so at most _LONGEST


def covered(docs: DataFrame, length: int = 50, seed: int = 20, most: int = 500) -> DataFrame:
    """(doc_id, start, end): runs of words of `docs` (doc_id, text) that windows of an earlier document cover; runs may overlap.

    Both sides of each join are tables, so that adaptive execution can split what a passage of very many documents puts on one key.
    """
    every = c.materialise(_passages(docs, length, seed))
    shared = c.materialise(every.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mini"))
    some = c.materialise(every.join(shared, "mini", "left_semi"))
    bodies = some.groupBy("mini", "body", "n").agg(F.min(F.struct("doc_id", "at")).alias("own")).select("mini", "body", "n", "own.*")
    bodies = c.materialise(bodies)
    large = c.materialise(bodies.groupBy("mini").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("mini"))
    contents = c.materialise(_contents(docs, bodies, length))
    few, many = c.join_small(contents, large, ["mini"], "left_anti"), c.materialise(c.join_small(contents, large, ["mini"], "left_semi"))
    found = c.materialise(_match(few, length).union(_match_large(many, length)))
    hits = some.join(found, ["mini", "body", "n"]).select("doc_id", "at", F.explode("spans").alias("s")).filter("s.first < doc_id")
    return hits.select("doc_id", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end") + length - 1).alias("end"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, seed: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256) of every row; `text` is the kept words joined by one space."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    runs = c.materialise(covered(docs, length, seed))
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, removed, texts, digests = [], [], [], []
        for text, gone in zip(c.texts_of(batch.column(1)), batch.column(2), strict=True):
            words = text.split()
            n = len(words)
            if gone.is_valid:
                mask = bytearray(b"\x01" * n)
                for s in gone.as_py():
                    mask[s["start"] : min(n, s["end"])] = bytes(max(0, min(n, s["end"]) - s["start"]))
                words = [w for w, keep in zip(words, mask, strict=True) if keep]
            kept = b" ".join(words)
            n_words.append(n)
            removed.append(n - len(words))
            texts.append(kept)
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "text", "kept_sha256"]
        )

    joined = docs.join(per_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone")
    return c.map_rows(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, text string, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
r AS (SELECT p.doc_id, list(DISTINCT x) AS gone FROM (SELECT p.doc_id, unnest(range(p.i, p.i + 50)) AS x FROM p JOIN f USING (h) WHERE f.first < p.doc_id) p GROUP BY p.doc_id),
k AS (SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
    CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END AS t FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": _SQL}
