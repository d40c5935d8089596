"""Join of documents whose sets of word n-grams overlap, by T-occurrence search with DivideSkip.

A document x of n shingles and similarity p percent need at least T = ceil(p n / 100) common
shingles, so all but n - T + k of its inverted lists may be skipped and only probed: every partner
occurs in k or more of the lists of its rarest n - T + k shingles (k = 3, or T if that is less). The
lists are ordered by length. Lengths come
from a summary over all documents: each batch of some million shingles reports those that three or
more of its documents hold, so a shingle that none reports is in at most two documents of each; the
summed reports give the lengths of the longest lists, at most 2^20 of them, and everything else
counts as short. A pair is found from its smaller set, whose short lists are fewer still, as it needs
2 p / (100 + p) of its own shingles; and what comes before the first common shingle can't be shared.

1. Documents with equal sets become one class; copies are never joined with each other.
2. Each class enters its short lists (token, class). The members of a list are searched first
   against the member with the fewest shingles of its own: in a group of near copies that is the one
   nearest to what they have in common, and links nearly all.
3. Members of k common lists that aren't yet linked with one and the same class are searched against
   each other, unless the parities of their shingles in 256 buckets already differ in more places than the
   two sets may have shingles of their own. Lists that are very long by the summary are dealt out over
   several tasks, each part with a pivot of its own.
   No pair that could link is left out; two classes that link with the same one need no further link.
4. A search takes one class and its candidates (in blocks), puts the inverted lists of its shingles
   over them, merges the short lists with a heap, and looks each document that they give up in the long
   ones by binary search, until the overlap is reached or out of reach.

`near_duplicates` gives classes and components, `links` every link between two classes: in a group of
near copies these grow with its square, which components don't need.

Null or empty texts have an empty set and link with nothing. Each row is judged by its own text, so
rows that repeat an id with other texts can be in different components; `representatives` keeps the
rows of an id only if each is the least of its component. Extra columns are left out. An empty table
gives an empty result. Sets are compared by 64-bit hashes of shingles, classes by a 64-bit hash of
the set and its size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .graph import components

LONG_LISTS = 1 << 20
OCCUR = 3
_BLOCK = 256
#: Shingles that a task sorts at once for its report, and entries that it hands on at once: 32 and 7 MB.
_HELD = 4_000_000
_FLUSH = 250_000
#: A list of more entries than this, by the summary, is dealt out over several tasks.
_LIST = 100_000


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles of the lower-cased text; of the whole if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(c.gram_hashes(c.word_hashes(words), min(size, len(words))))


MARKS = ("m0", "m1", "m2", "m3")


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether the number of tokens in each of 256 buckets is odd, as four 64-bit numbers: they differ in no more places than the sets do in tokens."""
    return np.packbits(np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def _class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def occurrences(n: int, percent: int) -> int:
    """How many of the short lists of a set of n a partner occurs in at least."""
    return min(OCCUR, need(n, percent))


def overlap(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m that link: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of `sets` link with `query`: short inverted lists merged by a heap, long ones probed."""
    near = [i for i, s in enumerate(sets) if len(s) and percent * max(len(s), len(query)) <= 100 * min(len(s), len(query))]
    if not near:
        return []
    least = min(overlap(len(query), len(sets[i]), percent) for i in near)
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for i in near:
        where = np.searchsorted(query, sets[i])
        where[where == len(query)] = 0
        for t in where[query[where] == sets[i]].tolist():
            lists[t].append(i)
    order = sorted((t for t in range(len(query)) if lists[t]), key=lambda t: len(lists[t]))
    skip = min(least - 1, len(order))
    short, long = order[: len(order) - skip], order[len(order) - skip :]
    found = []
    for i, same in groupby(heapq.merge(*(lists[t] for t in short))):
        count = sum(1 for _ in same)
        wanted, left = overlap(len(query), len(sets[i]), percent), len(long)
        for t in long:
            if count >= wanted or count + left < wanted:
                break
            left -= 1
            where = bisect_left(lists[t], i)
            count += where < len(lists[t]) and lists[t][where] == i
        if count >= wanted:
            found.append(i)
    return found


def _survey(docs: DataFrame, size: int) -> DataFrame:
    """Kind 0: (id, set size, class); kind 1: (token, documents) of the shingles that a batch has in three documents or more."""

    names = ["kind", "a", "b", "c", *MARKS]

    def report(every: np.ndarray) -> Iterator[pa.RecordBatch]:
        every.sort()
        third = every[:-2] == every[2:]
        third[1:] &= every[1:-2] != every[:-3]  # the first of three or more
        if n := int(third.sum()):
            tokens = every[:-2][third]
            count = np.searchsorted(every, tokens, "right") - np.searchsorted(every, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(c.signed(tokens)), pa.array(count), *[pa.array(np.zeros(n, np.int64))] * (1 + len(MARKS))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty(_HELD, np.uint64)
        seen: set[int] = set()
        held = 0
        for batch in batches:
            sizes, classes, marks = [], [], []
            for text in c.texts_of(batch.column(1)):
                tokens = shingle_set(text, size)
                sizes.append(len(tokens))
                classes.append(cls := _class_of(tokens))
                marks.append(parities(tokens))
                if cls in seen:
                    continue
                if held and held + len(tokens) > _HELD:
                    yield from report(kept[:held])
                    seen.clear()
                    held = 0
                seen.add(cls)
                if len(tokens) > _HELD:
                    continue  # no shingle of one document alone is in three
                kept[held : held + len(tokens)] = tokens
                held += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *[pa.array(np.array(x)) for x in zip(*marks, strict=True)]], names)
        yield from report(kept[:held])

    return c.small_batches(docs).mapInArrow(run, "kind int, a bigint, b bigint, c bigint, " + ", ".join(f"{m} bigint" for m in MARKS))


def _long_lists(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the longest reported lists, sorted, and their lengths: those of a least length for which there are at most LONG_LISTS."""
    reported = c.materialise(survey.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")))
    by_power = sorted(reported.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True)  # at most 64 rows
    least, rows = 64, 0
    for power, n in by_power:
        if (rows := rows + n) > LONG_LISTS:
            break
        least = power
    heavy = reported.filter(F.col("n") >= F.lit(float(2**least))).toArrow()
    tokens, n = heavy["a"].to_numpy().view(np.uint64), heavy["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _entries(docs: DataFrame, size: int, percent: int, heavy: tuple[np.ndarray, np.ndarray], most: int) -> DataFrame:
    """(token, salt, cls, n, at, own) for the rarest n - T + k shingles of each class.

    `at` is the place in the order by list length, and `own` counts the shingles in no reported list.
    `salt` is -1, but for lists of more than `most` entries by the summary: there it deals the classes
    out over parts of about `most`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    names = ["token", "salt", "cls", "n", "at", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        long, length = shared.value
        held: list[tuple] = []
        count = 0

        def pack() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.signed(columns[0])), *map(pa.array, columns[1:])], names)

        for batch in batches:
            for text in c.texts_of(batch.column(0)):
                own = shingle_set(text, size)
                n = rare = len(own)
                if not n or (cls := _class_of(own)) in seen:
                    continue
                if len(seen) > _FLUSH:
                    seen.clear()
                seen.add(cls)
                first = n - need(n, percent) + occurrences(n, percent)
                salt = np.full(first, -1, np.int32)
                if len(long):
                    at = np.searchsorted(long, own)
                    at[at == len(long)] = 0
                    freq = np.where(long[at] == own, length[at], 0)
                    if freq.any():
                        order = np.argsort(freq, kind="stable")
                        own, rare, freq = own[order], int((freq == 0).sum()), freq[order][:first]
                        salt = np.where(freq > most, cls % np.maximum(1, -(-freq // most)), -1).astype(np.int32)
                held.append((own[:first], salt, np.full(first, cls), np.full(first, n, np.int32), np.arange(first, dtype=np.int32), np.full(first, rare, np.int32)))
                count += first
                if count > _FLUSH:
                    yield pack()
                    count = 0
        if held:
            yield pack()

    return c.small_batches(docs).select("text").mapInArrow(run, "token bigint, salt int, cls bigint, n int, at int, own int")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, tokens) of the classes in `wanted` (doc_id, cls), from the text of one document each; a row of that id with another set is left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [(cls, own.tobytes()) for cls, t in zip(batch.column(0).to_pylist(), c.texts_of(batch.column(1)), strict=True) if _class_of(own := shingle_set(t, size)) == cls]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), pa.array([t for _, t in sets], pa.binary())], ["cls", "tokens"])

    texts = c.join_small(docs, wanted.select("doc_id", "cls"), ["doc_id"], "inner").select("cls", "text")
    return c.materialise(c.map_rows(texts, run, "cls bigint, tokens binary"))


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _inner(n: Column, at: Column, percent: int) -> Column:
    """Whether a place is in the short lists that the smaller set of a pair needs."""
    return at < n - _need(n, n, percent) + F.least(F.lit(OCCUR), F.ceil(percent * n / 100))


def _often(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of sizes nx <= ny that meet in as many lists as partners have to, and not too late: ax, ay are places."""
    enough = F.least(F.lit(OCCUR), F.ceil(percent * F.col("nx") / 100))
    met = pairs.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("k"), F.min("ax").alias("ax"), F.min("ay").alias("ay"))
    reach = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    return met.filter((F.col("k") >= enough) & (reach >= _need(F.col("nx"), F.col("ny"), percent))).select("x", "y")


def _search(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) among the candidate pairs (x, y) of classes."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct().join(classes, "cls").select("cls", F.col("class_id").alias("doc_id"))
    sets = _sets(docs, c.materialise(wanted), size)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x = key[0].as_py()
        ids = rows["y"].to_pylist()
        own = [np.frombuffer(t.as_py(), np.uint64) for t in rows["tokens"]]
        query = own[ids.index(x)]
        others = [i for i, y in enumerate(ids) if y != x]
        found = divide_skip(query, [own[i] for i in others], percent)
        return pa.table({"u": pa.array([x] * len(found), pa.int64()), "v": pa.array([ids[others[i]] for i in found], pa.int64())})

    degrees = pairs.groupBy("x").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    blocks = pairs.join(degrees, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("blocks")).alias("block"))
    asked = blocks.union(blocks.select("x", F.col("x").alias("y"), "block").distinct())
    return asked.join(sets, asked["y"] == sets["cls"]).select("x", "block", "y", "tokens").groupBy("x", "block").applyInArrow(run, "u bigint, v bigint")


def _lists(docs: DataFrame, survey: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """(token, salt, cls, n, at, inner, p) of the short inverted lists in which a pair can meet; p is the pivot of the list, or of its part."""
    lists = _entries(docs, size, percent, _long_lists(survey), most).repartition("token", "salt").dropDuplicates(["token", "salt", "cls", "n"])
    part = Window.partitionBy("token", "salt").orderBy("own", "n", "cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = lists.withColumn("inner", _inner(F.col("n"), F.col("at"), percent))
    lists = lists.select("*", F.count("*").over(part).alias("m"), F.max("inner").over(part).alias("some"), F.first(F.struct("n", "cls", "at", "inner")).over(part).alias("p"))
    lists = c.materialise(lists.filter("salt >= 0 or m > 1 and some").select("token", "salt", "cls", "n", "at", "inner", "p"))
    # A dealt list counts as a whole: without an inner member in any part none of its members can meet here.
    whole = lists.filter("salt < 0")
    dealt = lists.filter("salt >= 0")
    alive = dealt.groupBy("token").agg(F.max("inner").alias("some")).filter("some").select("token")
    return c.materialise(whole.unionByName(dealt.join(alive, "token", "left_semi"))) if not dealt.isEmpty() else lists


def _ordered(met: DataFrame, percent: int) -> DataFrame:
    """(x, y, nx, ny, ax, ay) of (a, b), two sides of one list each, the smaller set first; pairs of sizes that can't link go."""
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a.inner") & (F.col("a.cls") != F.col("b.cls")) & (percent * F.col("b.n") <= 100 * F.col("a.n")))
    return met.select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny"), F.col("a.at").alias("ax"), F.col("b.at").alias("ay"))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y): each class with the pivot of its list, and the pivots of the parts of a list with the first of them."""
    side = F.struct("n", "cls", "at", "inner")
    pivots = lists.filter("salt >= 0").select("token", "p").distinct()
    tops = pivots.groupBy("token").agg(F.min("p").alias("top"))
    met = lists.select(side.alias("a"), F.col("p").alias("b")).union(pivots.join(tops, "token").select(F.col("p").alias("a"), F.col("top").alias("b")))
    return c.materialise(_often(_ordered(met, percent), percent))


def _across(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y) of different parts: the columns of `lists` and `part`, which no two classes that are to meet share.

    The parts of a list are paired first, if their sizes, places and (of single classes) parities let
    some members link; then each member is held against what is known of the other part, and only
    those that may link meet its members. Members of one part are never paired.
    """
    left = c.materialise(lists.join(classes.select("cls", *MARKS), "cls"))
    ranges = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("reach"), F.count("*").alias("cnt"), *[F.first(m).alias(m) for m in MARKS]]
    parts = left.groupBy("token", "part").agg(F.max("inner").alias("some"), *ranges)

    def apart(g: str, h: str) -> Column:
        return reduce(add, [F.bit_count(F.col(f"{g}.{m}").bitwiseXOR(F.col(f"{h}.{m}"))) for m in MARKS])

    least = _need(F.col("g.lo"), F.col("h.lo"), percent)
    sizes = (percent * F.col("g.lo") <= 100 * F.col("h.hi")) & (percent * F.col("h.lo") <= 100 * F.col("g.hi")) & (F.least("g.reach", "h.reach") + OCCUR > least)
    single = (F.col("g.cnt") > 1) | (F.col("h.cnt") > 1) | (apart("g", "h") <= F.col("g.lo") + F.col("h.lo") - 2 * least)
    both = parts.alias("g").join(parts.alias("h"), (F.col("g.token") == F.col("h.token")) & (F.col("g.part") < F.col("h.part")) & (F.col("g.some") | F.col("h.some")) & sizes & single)
    both = both.select(F.col("g.token").alias("token"), F.col("g.part").alias("part"), F.col("h.part").alias("other"), F.struct(*[F.col(f"h.{x}").alias(x) for x in ("lo", "hi", "reach", "cnt", *MARKS)]).alias("r"))
    side = F.struct("n", "cls", "at", "inner", *MARKS)
    a = left.select(F.col("token").alias("s"), F.col("part").alias("p"), side.alias("a"))
    low = _need(F.col("a.n"), F.col("r.lo"), percent)  # what a member needs at least with any of the other part
    may = (percent * F.col("a.n") <= 100 * F.col("r.hi")) & (percent * F.col("r.lo") <= 100 * F.col("a.n")) & (F.least(F.col("a.n") - F.col("a.at"), F.col("r.reach")) + OCCUR > low)
    may = may & ((F.col("r.cnt") > 1) | (apart("a", "r") <= F.col("a.n") + F.col("r.lo") - 2 * low))
    b = left.select(F.col("token").alias("t"), F.col("part").alias("o"), side.alias("b"))
    need = _need(F.col("a.n"), F.col("b.n"), percent)
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + OCCUR  # a later common shingle only counts beside an earlier one
    fits = (percent * F.greatest("a.n", "b.n") <= 100 * F.least("a.n", "b.n")) & (reach > need) & (apart("a", "b") <= F.col("a.n") + F.col("b.n") - 2 * need)
    met = both.join(a, (F.col("token") == F.col("s")) & (F.col("part") == F.col("p")) & may).join(b, (F.col("token") == F.col("t")) & (F.col("other") == F.col("o")) & fits)
    plain = [F.struct(*[F.col(f"{x}.{f}").alias(f) for f in ("n", "cls", "at", "inner")]).alias(x) for x in ("a", "b")]
    return _often(_ordered(met.select(*plain), percent), percent)


def _prepared(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    survey = c.materialise(_survey(docs, size))
    members = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("cls"), *MARKS)
    classes = members.filter("n_shingles > 0").groupBy("cls", "n_shingles").agg(F.min("doc_id").alias("class_id"), *[F.first(m).alias(m) for m in MARKS])
    return docs, members.drop(*MARKS), classes, _lists(docs, survey, size, percent, most)


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    ids = classes.select("cls", "class_id")
    return links.join(ids.withColumnsRenamed({"cls": "u", "class_id": "a"}), "u").join(ids.withColumnsRenamed({"cls": "v", "class_id": "b"}), "v").select("a", "b")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, most: int = _LIST) -> DataFrame:
    """(a, b, a < b): every link between two classes, by their class ids; as many rows as there are links between different sets."""
    docs, _, classes, lists = _prepared(docs, id_col, text_col, size, percent, most)
    pairs = c.materialise(_across(lists.withColumn("part", F.col("cls")), classes, percent))
    return _named(_search(docs, classes, pairs, size, percent), classes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, most: int = _LIST) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row: class_id is the least id with the same set, component_id the least id that links reach."""
    docs, members, classes, lists = _prepared(docs, id_col, text_col, size, percent, most)
    pairs = _stars(lists, percent)
    found = c.materialise(_search(docs, classes, pairs, size, percent))
    linked = c.materialise(components(found)).withColumnsRenamed({"node": "cls", "component": "part"})
    left = lists.join(linked, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    mixed = left.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("token")
    rest = c.materialise(_across(left.join(mixed, "token", "left_semi"), classes, percent).join(pairs, ["x", "y"], "left_anti"))
    if not rest.isEmpty():
        more = linked.select(F.col("cls").alias("u"), F.col("part").alias("v")).union(_search(docs, classes, rest, size, percent))
        linked = c.materialise(components(more)).withColumnsRenamed({"node": "cls", "component": "part"})
    least = classes.join(linked, "cls").groupBy("part").agg(F.min("class_id").alias("reached"))
    reached = linked.join(least, "part").select("cls", "reached")
    by_class = classes.join(reached, "cls", "left").select("cls", "n_shingles", "class_id", F.coalesce("reached", "class_id").alias("component_id"))
    full = members.join(by_class, ["cls", "n_shingles"], "left")
    return full.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose id is the least of its component, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, size, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col].cast("bigint") == gone["__gone"], "left_anti")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d
), k AS (SELECT g, min(doc_id) AS class_id FROM (SELECT doc_id, list_sort(g) AS g FROM s) GROUP BY g),
m AS (SELECT s.doc_id, len(s.g)::bigint AS n, coalesce(k.class_id, s.doc_id) AS class_id FROM s LEFT JOIN k ON list_sort(s.g) = k.g AND len(s.g) > 0),
t AS (SELECT class_id, len(g) AS n, unnest(g) AS x FROM k WHERE len(g) > 0),
e AS (
    SELECT a.class_id AS u, b.class_id AS v FROM t a JOIN t b ON a.x = b.x AND a.class_id <> b.class_id
    GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT DISTINCT u AS node, u AS seen FROM e UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT m.doc_id, m.n AS n_shingles, coalesce(c.component_id, m.class_id) AS component_id, m.class_id FROM m LEFT JOIN c ON c.node = m.class_id
"""

QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLES = {"op2_jaccard_join": _SQL}
