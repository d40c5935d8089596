"""Periodic runs: stretches of words that repeat themselves, found by the linear method for tandem repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(`least`, `times` * q) that no neighbouring word extends with that period.
The documents of an Arrow batch are laid one behind the other with an end mark of its own behind
each, and their suffix tree is held as suffix array, common prefix lengths and rank tables of
substrings (a pair of ranks names a place in the tree). Then, as Gusfield and Stoye do it:

1. Lempel-Ziv blocks; at each start of a block, for each period up to the lengths of the blocks
   beside it, common extensions to both sides give the squares there. They cover the leftmost
   occurrence of every square.
2. Suffix links, which lead from each such square to the one a word further on for as long as the
   period holds, complete the vocabulary of squares; equal ones meet at one place of the tree.
3. The leaves below that place are all occurrences; those of one period that follow each other
   merge into runs, and a run that two periods describe keeps the smaller one.

Only documents in which 16 words in a row occur twice take part: every run of at least 24 words and
three periods has that, so nothing is lost, and most documents are done after hashing.

Null and empty texts have no words and no run; a null id stays null; repeated rows are judged each by
itself; extra columns are left out; an empty table gives an empty result; a text of any length is
taken whole (memory grows with its words, by about 300 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Pairs of places that are extended at once.
_PAIRS = 1 << 19


class SuffixTree:
    """Suffix array, prefix lengths and substring ranks of a text of numbers whose last one occurs once."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank.astype(np.int32)]
        size = 1
        while rank.max() + 1 < self.n:
            key = (rank + 1) * (self.n + 1)
            key[: self.n - size] += rank[size:] + 1
            rank = np.unique(key, return_inverse=True)[1]
            self.ranks.append(rank.astype(np.int32))
            size *= 2
        self.place = self.ranks[-1]
        self.array = np.empty(self.n, np.int64)
        self.array[self.place] = np.arange(self.n)
        self.common = self.forward(self.array[:-1], self.array[1:])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j."""
        out = np.zeros(len(i), np.int64)
        last = self.n - 1
        for m in range(len(self.ranks) - 1, -1, -1):
            a, b = i + out, j + out
            same = (self.ranks[m][np.minimum(a, last)] == self.ranks[m][np.minimum(b, last)]) & (a <= last) & (b <= last)
            out[same] += 1 << m
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end with i and j."""
        out = np.zeros(len(i), np.int64)
        for m in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << m) + 1, j - out - (1 << m) + 1
            same = (self.ranks[m][np.maximum(a, 0)] == self.ranks[m][np.maximum(b, 0)]) & (a >= 0) & (b >= 0)
            out[same] += 1 << m
        return out

    def locus(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that, with the length, name the place of each substring in the tree."""
        level = np.frexp(length.astype(np.float64))[1] - 1
        first, second = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for m in np.unique(level):
            at = np.flatnonzero(level == m)
            table = self.ranks[min(int(m), len(self.ranks) - 1)]
            first[at], second[at] = table[i[at]], table[i[at] + length[at] - (1 << min(int(m), len(self.ranks) - 1))]
        return first, second

    def leaves(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index in the suffix array below the place of each substring."""
        low, high = self.place[i].astype(np.int64), self.place[i].astype(np.int64)
        tables, size = [self.common], 1
        while size * 2 < self.n:
            tables.append(np.minimum(tables[-1][:-size], tables[-1][size:]))
            size *= 2
        for m in range(len(tables) - 1, -1, -1):
            least, step = tables[m], 1 << m
            up = (high + step <= self.n - 1) & (least[np.minimum(high, len(least) - 1)] >= length)
            high[up] += step
            down = (low >= step) & (least[np.maximum(low - step, 0)] >= length)
            low[down] -= step
        return low, high

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the end of the text."""
        before, after = [-1] * self.n, [-1] * self.n
        order = self.array.tolist()
        for a, b in zip(order[:-1], order[1:], strict=True):
            after[a], before[b] = b, a
        # Suffixes leave the order from the last to the first; the neighbours that are left start earlier.
        for i in range(self.n - 1, -1, -1):
            a, b = before[i], after[i]
            if a >= 0:
                after[a] = b
            if b >= 0:
                before[b] = a
        here, longest = np.arange(self.n), np.zeros(self.n, np.int64)
        for near in (np.array(before), np.array(after)):
            at = near >= 0
            longest[at] = np.maximum(longest[at], self.forward(here[at], near[at]))
        steps, i, out = np.maximum(longest, 1).tolist(), 0, []
        while i < self.n:
            out.append(i)
            i += steps[i]
        return np.array([*out, self.n])


def _flat(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, index in it) of all members of groups of these sizes, at most `most` at a time."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, most):
        at = np.arange(a, min(a + most, total))
        group = np.searchsorted(ends, at, side="right")
        yield group, at - (ends[group] - counts[group])


def _unique(*columns: np.ndarray) -> np.ndarray:
    """Indices of the first of all rows that agree in all but the last column, by which they are ordered."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in columns[:-1]:
        new[1:] |= x[order][1:] != x[order][:-1]
    return order[new]


def _leftmost(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches at block starts that hold a square; they cover the leftmost squares."""
    starts = tree.blocks()
    sizes = np.diff(starts)
    at = starts[1:-1]
    left, right = sizes[:-1], sizes[1:] + np.append(sizes[2:], 0)
    found = []
    for counts, side in ((left, -1), (right, 0)):
        for group, k in _flat(counts, _PAIRS):
            period = k + 1
            i = at[group] + side * period
            j = i + period
            inside = j < tree.n
            i, j, period = i[inside], j[inside], period[inside]
            ahead, behind = tree.forward(i, j), tree.backward(i - 1, j - 1)
            square = ahead + behind >= period
            found.append(np.stack([(i - behind)[square], (j + ahead)[square], period[square]]))
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    first = _unique(start, end, period)
    return start[first], end[first], period[first]


def runs_of(text: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) of all runs of a text of numbers whose last one occurs once, by start and period."""
    tree = SuffixTree(text)
    start, end, period = _leftmost(tree)
    # Suffix links: from each square to the next ones of its stretch, one for each rotation.
    links = [(start[g] + k, period[g]) for g, k in _flat(np.minimum(end - start - 2 * period + 1, period), _PAIRS)]
    if not links:
        return np.zeros((0, 3), np.int64)
    at, period = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
    first = _unique(period, *tree.locus(at, 2 * period), at)
    at, period = at[first], period[first]
    low, high = tree.leaves(at, 2 * period)
    placed = np.concatenate([period[g] * tree.n + tree.array[low[g] + k] for g, k in _flat(high - low + 1, _PAIRS)])
    placed.sort()
    new = np.concatenate([[True], np.diff(placed) != 1])
    begin, last = placed[new], placed[np.append(np.flatnonzero(new)[1:] - 1, len(placed) - 1)]
    period = begin // tree.n
    begin, stop = begin % tree.n, last % tree.n + 2 * period
    one = _unique(begin, stop, period)
    begin, stop, period = begin[one], stop[one], period[one]
    long = stop - begin >= np.maximum(least, times * period)
    out = np.stack([begin, stop - begin, period], axis=1)[long]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


#: Words that every run has twice, for the least length of 24 and three periods: a run of at most 8 words a period has 24 - 8 pairs of equal words in a row, a longer one twice its period.
_TWICE = 16


def _suspects(texts: list[list[bytes]], twice: int) -> list[int]:
    """Numbers of the texts in which `twice` words in a row occur twice."""
    long = [d for d, words in enumerate(texts) if len(words) > twice]
    if not long:
        return []
    sizes = np.array([len(texts[d]) for d in long])
    grams = c.rolling_hashes(c.word_hashes([w for d in long for w in texts[d]]), twice)
    inside = np.concatenate([np.arange(e - n, e - twice + 1) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(long)), sizes - twice + 1)
    order = np.lexsort((grams[inside], owner))
    grams, owner = grams[inside][order], owner[order]
    return [long[d] for d in np.unique(owner[1:][(grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])]).tolist()]


def batch_runs(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    twice = min(_TWICE, max(1, (least * (times - 1)) // times))
    taken = _suspects(texts, twice)
    if not taken:
        return out
    number: dict[bytes, int] = {}
    parts = []
    for k, d in enumerate(taken):
        parts.append(np.array([number.setdefault(w, len(number)) for w in texts[d]] + [-1 - k], np.int64))
    ends = np.cumsum([len(p) for p in parts])
    found = runs_of(np.concatenate(parts), least, times)
    owner = np.searchsorted(ends, found[:, 0], side="right")
    for k, (start, length, period) in zip(owner.tolist(), found.tolist(), strict=True):
        out[taken[k]].append((start - int(ends[k]) + len(parts[k]), length, period))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    left = np.cumsum(gone[:-1]) == 0
    return [w for w, keep in zip(words, left.tolist(), strict=True) if keep]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, text): the runs of each text by start and period, and the text without the words that only repeat."""
    if least < times * 2 or times < 2:
        raise ValueError("runs have at least two periods, and two words a period")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.split() for t in c.texts_of(batch.column(1))]  # bytes split at the six ASCII white-space characters
        found = batch_runs(texts, least, times)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        listed = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
        left = [b" ".join(collapse(w, f)).decode("utf-8") for w, f in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(listed, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "text"])

    return c.map_rows(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id bigint, n_words bigint, runs {RUNS}, text string")


def strongest(found: DataFrame) -> DataFrame:
    """`found` with start, length and period of each document's run of most periods; ties by least start, then period."""

    def better(a, b):
        gain = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when((gain > 0) | ((gain == 0) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    first = F.element_at(F.col("runs"), 1)
    best = F.when(F.size("runs") > 0, F.aggregate(F.col("runs"), first, better))
    return found.withColumn("best", best).select("*", "best.start", "best.length", "best.period").drop("best")


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by their ids, run in a loop from some word on, as language models' output can do."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", c.SPACES, -1), lambda w: w != "")

    def loop(ws):
        n, g = F.size(ws), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        turned = F.transform(ws, lambda w, i: F.when(i >= a, F.element_at(ws, (a + (i - a) % p + 1).cast("int"))).otherwise(w))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), c.let(words, loop)).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the runs of every document, a tenth of which is made to loop."""
    found = strongest(runs(looped(c.table(spark, sf_dir, "documents"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit(""))), "")
    lines = F.regexp_replace(listed, "([0-9]+,[0-9]+,[0-9]+),", "$1\n")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period",
        F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Windows of the SQL: a run of period q is a stretch of places whose window of the first size of at least q comes again q words on, and no sooner. Texts of up to three times the last size.
_SIZES = [16 << k for k in range(14)]


def _levels() -> str:
    out = ["g16 AS (SELECT rid, n, i, hash(" + ", ".join(f"lead(w, {k}) OVER d" if k else "w" for k in range(16)) + ") AS g FROM w WINDOW d AS (PARTITION BY rid ORDER BY i))"]
    for a, b in zip(_SIZES[:-1], _SIZES[1:], strict=True):
        out.append(f"g{b} AS (SELECT rid, n, i, hash(g, lead(g, {a}) OVER (PARTITION BY rid ORDER BY i)) AS g FROM g{a} WHERE 2 * n >= 3 * {b})")
    pairs = [f"SELECT rid, i, lead(i) OVER (PARTITION BY rid, g ORDER BY i) - i AS q, {s} AS z FROM g{s} WHERE i + {s} <= n" for s in _SIZES]
    return ",\n".join([*out, "p AS (" + " UNION ALL ".join(pairs) + ")"])


_SQL = rf"""
WITH t AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS v FROM range(256) r(b))),
s AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws) AS n, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda x, y: xor(x >> 8, t.t[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM s, t),
a AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
w AS (SELECT rid, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM a WHERE n > 0)),
{_levels()},
e AS (SELECT rid, q, z, i, i - row_number() OVER (PARTITION BY rid, z, q ORDER BY i) AS island FROM p WHERE q <= z AND (z = 16 OR 2 * q > z)),
r AS (SELECT rid, min(i) AS start, max(i) + z + q - min(i) AS length, q AS period FROM e GROUP BY rid, q, z, island),
k AS (SELECT * FROM r WHERE length >= greatest(24, 3 * period)),
b AS (SELECT rid, count(*) AS n_runs, list({{'start': start, 'length': length, 'period': period}} ORDER BY start, period) AS rs FROM k GROUP BY rid),
o AS (SELECT w.rid, string_agg(w, ' ' ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.rid = w.rid AND i >= start + period AND i < start + length)) AS c FROM w GROUP BY w.rid),
x AS (SELECT rid, start, length, period FROM k QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::bigint AS start, length::bigint AS length, period::bigint AS period, (1000 * length) // period AS exponent_milli,
    sha256(coalesce(array_to_string(list_transform(rs, lambda r: r.start || ',' || r.length || ',' || r.period || chr(10)), ''), '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM h LEFT JOIN b USING (rid) LEFT JOIN o USING (rid) LEFT JOIN x USING (rid)
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {"op11_periodic_runs": _SQL}
