"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index blocks, exact verification.

Words are runs of letters and digits of the lower-cased text; a shingle is five words. A window of n
consecutive shingles, for each size n that an item has, may begin at every place of a document; at
its ends it is cut off, and a shorter document is one window. The similarity is that of multisets:
weighted Jaccard, each shingle weighing its multiplicity, whatever the order.

1. A window can only reach the similarity t with some item of its size if t n of its shingles are
   shingles of the benchmark. So the places of a document whose shingle is one are counted, and every
   window with enough of them is laid, wherever it begins and whichever items they are from.
2. A window's 64-bit SimHash holds the majority of its shingles' bits. Fingerprints are cut into blocks,
   so many that two within `radius` bits differ by at most radius // blocks bits in one of them; the
   index has every value at that distance for each block of each item, which guarantees all items of
   that size within the radius.
3. Candidates are verified exactly.

The first step loses nothing. The radius is what the method itself can lose: of windows of 0.8 to 0.85
about one in eight thousand differs in more than 20 bits (README has figures).

Null texts and texts or items under five words have no shingle and match nothing. Rows that repeat
an id give one result, with the windows of all their texts. Extra columns are left out by `leaks` and
stay with `clean`. An empty table on either side gives no leak.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SIZE = 5
BITS = 64
BLOCKS = 7


def _shingles(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    none = F.array().cast("array<bigint>")
    return c.let(
        words, lambda w: F.when(F.size(w) >= SIZE, F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SIZE)]))).otherwise(none)
    )


def _lanes(longest: int) -> tuple[int, list[Column]]:
    """Bits between two counters, and the columns to be summed over shingles x: each holds several of x's bits, far enough apart to count `longest`."""
    gap = 16 if longest < 1 << 14 else 32
    ones = sum(1 << at for at in range(0, BITS, gap))
    return gap, [F.shiftrightunsigned("x", k).bitwiseAND(F.lit(ones).cast("bigint")) for k in range(gap)]


def fingerprints(shingles: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, mark): the SimHash of the shingles x of each key, of which there are at most `longest`; a repeated one counts as often as it occurs."""
    gap, lanes = _lanes(longest)
    ones = sum(1 << at for at in range(0, BITS, gap))
    sums = shingles.groupBy(*keys).agg(F.count("x").alias("__n"), *[F.sum(x).alias(f"__{k}") for k, x in enumerate(lanes)])
    bias = ((1 << (gap - 2)) - 1 - F.shiftright(F.col("__n"), 1)) * F.lit(ones).cast("bigint")  # a counter over half of n reaches bit gap - 2 of its lane

    def majority(k: int) -> Column:
        return F.shiftleft(F.shiftrightunsigned(F.col(f"__{k}") + bias, gap - 2).bitwiseAND(F.lit(ones).cast("bigint")), k)

    return sums.select(*keys, reduce(Column.bitwiseOR, [majority(k) for k in range(gap)]).alias("mark"))


def _widths() -> list[int]:
    return [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]


def _blocks(mark: Column) -> list[tuple[int, Column]]:
    out, at = [], 0
    for i, width in enumerate(_widths()):
        out.append((i, F.shiftrightunsigned(mark, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))))
        at += width
    return out


def _index_keys(mark: Column, radius: int) -> Column:
    """Every (block, value) within radius // BLOCKS bits of the fingerprint's own."""

    def close(i: int, value: Column, width: int) -> Column:
        masks = sorted(sum(1 << b for b in bits) for d in range(radius // BLOCKS + 1) for bits in combinations(range(width), d))
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[close(i, value, width) for (i, value), width in zip(_blocks(mark), _widths(), strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingle hashes."""
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return c.let(common, lambda o: o / (F.size(a) + F.size(b) - o))


def _starts(places: Column, n: Column, least: Column) -> Column:
    """Where windows of n begin that hold `least` of the ascending places."""
    last = F.size(places) - least
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(places, i + least - 1).alias("hi"), F.get(places, i).alias("lo")))
    laid = F.transform(F.filter(runs, lambda r: r["hi"] - r["lo"] < n), lambda r: F.sequence(r["hi"] - n + 1, r["lo"]))
    return F.when(last >= 0, F.array_distinct(F.flatten(laid))).otherwise(F.array().cast("array<int>"))


def _cut(shingles: Column, start: Column, n: Column) -> Column:
    """The window's shingles, without what is beyond the document."""
    begin = F.greatest(start, F.lit(0))
    return F.slice(shingles, begin + 1, F.least(start + n, F.size(shingles)) - begin)


def windows(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, copy, ws array<struct<n,start>>) of the documents (doc_id, copy, text): all windows that can reach the threshold with some of `items` (s, n), which fit a broadcast."""
    known = items.select(F.explode("s").alias("x")).distinct()
    rows = docs.select("doc_id", "copy", F.posexplode(_shingles(F.col("text"))).alias("at", "x"))
    places = rows.join(F.broadcast(known), "x").groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("at")).alias("places"))
    sizes = [r["n"] for r in items.select("n").distinct().collect()]  # lengths of items: one number each
    laid = [F.struct(F.lit(n).alias("n"), F.lit(max(1, math.ceil(threshold * n - 1e-9))).alias("least")) for n in sorted(sizes)]
    if not laid:
        return places.select("doc_id", "copy", F.array().cast("array<struct<n:int,start:int>>").alias("ws")).limit(0)
    each = F.transform(F.array(*laid), lambda z: F.transform(_starts(F.col("places"), z["n"], z["least"]), lambda s: F.struct(z["n"].alias("n"), s.alias("start"))))
    return places.select("doc_id", "copy", F.flatten(each).alias("ws")).filter(F.size("ws") > 0)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows): items that a document has a window of, the best similarity and the windows that reach the threshold."""
    spark = docs.sparkSession
    own = c.materialise(items.select(F.col(item_col).alias("item_id"), _shingles(F.col(item_text)).alias("s")).withColumn("n", F.size("s")).filter("n > 0").withColumn("version", F.monotonically_increasing_id()))
    size, longest = own.agg(F.sum("n"), F.max("n")).first()
    rounds = max(1, -(-(size or 0) // c.BROADCAST_ROWS))  # a larger benchmark is taken in blocks, each small enough to broadcast
    marks = fingerprints(own.select("version", F.explode("s").alias("x")), ["version"], longest or 1)
    own = c.materialise(own.join(marks, "version"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    for i in range(rounds):
        some = own.filter(F.pmod(F.xxhash64("version"), F.lit(rounds)) == i)
        laid = c.materialise(windows(texts, some, threshold))

        # Only documents with windows are dealt out, so that a window's shingles are summed where they are.
        ids = c.materialise(c.join_small(texts, laid.select("doc_id", "copy"), ["doc_id", "copy"], "inner").dropDuplicates(["doc_id", "copy"]).select("doc_id", "copy", _shingles(F.col("text")).alias("h")))
        near_text = ids.join(laid, ["doc_id", "copy"]).repartition(tasks, "doc_id", "copy")
        slices = near_text.select("doc_id", "copy", F.explode(F.transform("ws", lambda w: F.struct(w["n"].alias("n"), w["start"].alias("start"), _cut(F.col("h"), w["start"], w["n"]).alias("w")))).alias("w"))
        marked = fingerprints(slices.select("doc_id", "copy", "w.n", "w.start", F.explode("w.w").alias("x")), ["doc_id", "copy", "n", "start"], longest or 1)
        probes = marked.withColumn("key", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in _blocks(F.col("mark"))])))
        index = some.select("version", "n", F.col("mark").alias("item_mark"), F.explode(_index_keys(F.col("mark"), radius)).alias("key"))
        near = probes.join(index, ["n", "key"]).filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius)
        near = near.groupBy("doc_id", "copy", "version", "n", "start").agg(F.lit(1)).groupBy("doc_id", "copy", "version", "n").agg(F.collect_list("start").alias("starts"))
        pairs = near.join(ids, ["doc_id", "copy"]).join(F.broadcast(some.select("version", "item_id", "s")), "version")
        reached = F.transform("starts", lambda at: F.struct(similarity(_cut(F.col("h"), at, F.col("n")), F.col("s")).alias("similarity"), F.struct("copy", at.alias("start")).alias("window")))
        parts.append(pairs.select("doc_id", "item_id", F.explode(reached).alias("r")).select("doc_id", "item_id", "r.*").filter(F.col("similarity") >= threshold))
    found = reduce(DataFrame.union, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("window").alias("n_windows"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of `docs` without a leak, with all their columns."""
    bad = leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("__leaky")).distinct()
    return docs.join(bad, docs[id_col] == bad["__leaky"], "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("bigint"), F.col("item_id").cast("bigint"), F.round("similarity", 9).alias("similarity"), F.col("n_windows").cast("bigint"))


_SQL = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
    UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT k, id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM w WHERE len(w) >= 5),
d AS (SELECT id AS doc_id, s FROM s WHERE k = 'd'), i AS (SELECT id AS item_id, s FROM s WHERE k = 'i'),
dx AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM d), ix AS (SELECT item_id, len(s) AS n, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM i),
a AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(p - n + 1, p + 1)) AS start FROM dx JOIN ix USING (x)),
v AS (SELECT a.doc_id, a.item_id, start, greatest(start, 1) - 1 AS b, least(start - 1 + a.n, len(d.s)) AS e, d.s AS ds, i.s AS s FROM a JOIN d USING (doc_id) JOIN i USING (item_id)),
c AS (SELECT doc_id, item_id, start, ds[b + 1:e] AS win, s FROM v),
o AS (SELECT *, list_sum(list_transform(list_distinct(s), lambda x: least(len(list_filter(s, lambda y: y = x)), len(list_filter(win, lambda y: y = x))))) AS o FROM c)
SELECT doc_id, item_id, round(max(o / (len(win) + len(s) - o)), 9) AS similarity, count(DISTINCT start) AS n_windows FROM o WHERE o / (len(win) + len(s) - o) >= 0.8 GROUP BY ALL
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": _SQL}
