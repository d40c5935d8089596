"""Line dedup by deletion neighbourhoods: of lines within one edit of each other the earliest stays.

A line is compared without outer white space. Every line with a character takes part; one of at least
`least` characters meets lines within one edit (substitution, insertion or deletion of a character),
shorter ones only equal lines. Two lines are within one edit just when one of these keys is equal:
(variant, place) with both lines less the character at that place, or one line less a character and
the whole other line. Lines of equal variant and place are all within the bound of each other, so each
is joined with the earliest alone; a whole line is joined with each line that becomes it by one
deletion. Only so many different lines can have one variant as there are characters and places, so a
key is never hot. The edit distance is verified on the texts. A line goes if an equal line, or one
within one edit, occurs earlier: at a smaller (document id, line number). This is judged on the input,
not on what is left.

Variants are as many as characters, so two lossless tests come first. Of two lines within one edit,
the shorter of n characters, the first or the last (n - 1) // 2 characters agree; and if the line is
cut in sixteen parts, all before and all after one of them agree. Only lines that share these with a
different line emit variants.

Null texts stay null and have no lines; ids must be unique (rows with one id count as one text's
lines, and lose the same line numbers; null comes before all ids); extra columns stay with
`deduplicated`, which refuses a column of the name that it adds; an empty table gives an empty result.
A document of which every line went has an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .substring_dedup import _INVERSE, _ODD, _powers

_BLANK = " \t\r\v\f"
_ROWS = 400_000


def deletion_variants(line: str) -> tuple[np.ndarray, int]:
    """Hashes of the line less each of its characters, and of the whole line; equal strings of one length have equal hashes."""
    chars = c.mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(chars)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(chars * _powers(_ODD, n), out=total[1:])
    less = total[:-1] + (total[-1] - total[1:]) * np.uint64(_INVERSE)
    return c.mix(less + np.uint64(n - 1)), int(c.mix(total[-1:] + np.uint64(n))[0])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no, line) of the lines that aren't blank."""
    split = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return split.select("doc_id", "no", F.btrim("line", F.lit(_BLANK)).alias("line")).filter("line <> ''")


#: A place is a number: the document id times 2^31, and the line number. It is a fixed-width key, which is aggregated by hash.
_NULL = -(1 << 63) - 1


def _place() -> Column:
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(_NULL)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(11,0)") + F.col("no").cast("decimal(10,0)")


def _id_and_number(place: Column) -> list[Column]:
    no = F.pmod(place, F.lit(1 << 31).cast("decimal(11,0)"))
    doc = ((place - no) / F.lit(1 << 31).cast("decimal(11,0)")).cast("decimal(20,0)")
    return [F.when(doc > F.lit(str(_NULL)).cast("decimal(20,0)"), doc.cast("bigint")).alias("doc_id"), no.cast("int").alias("no")]


_HALVES = ("k0", "k1", "k2", "k3")


def _halves(line: Column) -> list[Column]:
    """Keys of the first and the last half, and of those that a line of one character less has; null where two are equal."""
    n = F.length(line)

    def both(p: Column) -> tuple[Column, Column]:
        return F.xxhash64(F.lit("first"), p, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit("last"), p, F.substring(line, n - p + 1, p))

    one, other = F.shiftright(n - 1, 1), F.shiftright(n - 2, 1)
    keys = [*both(one), *(F.when(other < one, x) for x in both(other))]
    return [x.alias(name) for x, name in zip(keys, _HALVES, strict=True)]


def _all_but_one(line: Column, parts: int = 16) -> Column:
    """For each of `parts` parts of the line, and for a line of one character less: what comes before and after the part."""
    n = F.length(line)

    def key(size: Column, j: int) -> Column:
        begin, end = F.floor(size * j / parts).cast("int"), F.floor(size * (j + 1) / parts).cast("int")
        after = (size - end).cast("int")
        return F.xxhash64(F.lit(j), size, F.substring(line, F.lit(1), begin), F.substring(line, n - after + 1, after))

    return F.array(*[key(n - less, j) for less in (0, 1) for j in range(parts)])


def _sharing(lines: DataFrame, keys: Column) -> DataFrame:
    """(h, g) of the rows with a key that a different line has too."""
    each = lines.select("h", "g", F.explode(keys).alias("key"))
    shared = c.materialise(each.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key"))
    return c.join_small(each, shared, ["key"], "left_semi").select("h", "g").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, rank) of (line, rank): a row for each character left out, and one of place -1 for the whole line."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def pack() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held]).view(np.int64)
            places = np.concatenate([np.arange(-1, len(k) - 1, dtype=np.int32) for k, _ in held])
            ranks = np.repeat(np.array([r for _, r in held], np.int64), [len(k) for k, _ in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places), pa.array(ranks)], ["key", "place", "rank"])

        for line, rank in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            less, whole = deletion_variants(line.as_py())
            held.append((np.concatenate((np.array([whole], np.uint64), less)), rank))
            size += len(less) + 1
            if size > _ROWS:
                yield pack()
                size = 0
        if held:
            yield pack()

    return c.map_rows(lines.select("line", "rank"), run, "key bigint, place int, rank bigint")


def _near(lines: DataFrame) -> DataFrame:
    """(h, g) of the lines (h, g, rank, line) that have a different line within one edit of a smaller rank."""
    keyed = _variants(lines)
    keyed = keyed.repartition("key")
    first = Window.partitionBy("key", "place").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("key").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = keyed.withColumn("first", F.first("rank").over(first)).withColumn("whole", F.min(F.when(F.col("place") < 0, F.col("rank"))).over(every))
    alike = F.when((F.col("place") >= 0) & (F.col("first") < F.col("rank")), F.struct(F.col("rank").alias("late"), F.col("first").alias("early")))
    meets = F.when((F.col("place") >= 0) & (F.col("whole") != F.col("rank")), F.struct(F.greatest("rank", "whole").alias("late"), F.least("rank", "whole").alias("early")))
    pairs = met.filter(alike.isNotNull() | meets.isNotNull()).select(F.explode(F.array_compact(F.array(alike, meets))).alias("p")).select("p.late", "p.early").distinct()
    text = lines.select("rank", "line")
    both = pairs.join(lines.withColumnRenamed("rank", "late"), "late").join(text.withColumnsRenamed({"rank": "early", "line": "other"}), "early")
    return both.filter(F.levenshtein("line", "other", 1) >= 0).select("h", "g").distinct()


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, no) of the lines of `docs` (doc_id, text) that go."""
    line = F.col("line")
    hashed = _lines(docs).select("doc_id", "no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.length("line").alias("n"), *_halves(line))
    hashed = c.materialise(hashed.select("doc_id", "no", "h", "g", *[F.when(F.col("n") >= least, F.col(k)).alias(k) for k in _HALVES]))
    distinct = hashed.groupBy("h", "g").agg(F.min(_place()).alias("at"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in _HALVES])
    distinct = c.materialise(distinct.select("h", "g", *_id_and_number(F.col("at")), "n", *_HALVES))
    likely = _sharing(distinct.filter("k0 is not null"), F.array_compact(F.array(*_HALVES)))
    likely = c.materialise(distinct.select("h", "g", "doc_id", "no").join(likely, ["h", "g"], "left_semi"))
    # Shuffled at any size, so that what it takes grows with the table; only lines that can be likely are.
    long = _lines(docs).filter(F.length("line") >= least)
    texts = c.materialise(long.hint("merge").join(likely, ["doc_id", "no"]).dropDuplicates(["h", "g"]).select("h", "g", "doc_id", "no", "line"))
    some = texts.join(_sharing(texts, _all_but_one(line)), ["h", "g"], "left_semi")
    ranked = c.materialise(some.orderBy("doc_id", "no").select("h", "g", F.monotonically_increasing_id().alias("rank"), "line"))
    near = c.materialise(_near(ranked))
    gone = distinct.select("h", "g", "doc_id", "no", "n").join(near.withColumn("near", F.lit(True)), ["h", "g"], "left")
    several = c.materialise(gone.filter("n > 1 or near").select("h", "g", F.col("doc_id").alias("d0"), F.col("no").alias("n0"), F.coalesce("near", F.lit(False)).alias("near")))
    hits = c.join_small(hashed.select("doc_id", "no", "h", "g"), several, ["h", "g"], "inner")
    return hits.filter("near or not (doc_id <=> d0 and no = n0)").select("doc_id", "no")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, count_col: str = "n_removed") -> DataFrame:
    """`docs` with the repeated lines taken out of `text_col`, and the number taken, `count_col`, which must not be a column of `docs`; all other columns stay."""
    if count_col in docs.columns:
        raise ValueError(f"docs has a column {count_col}: give another count_col")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_lines(own, least)
    per_doc = gone.groupBy("doc_id").agg(F.collect_set("no").alias("__gone")).withColumnRenamed("doc_id", "__id")
    joined = c.small_batches(docs).withColumn("__id", F.col(id_col).cast("bigint"))
    joined = joined.join(per_doc.hint("merge"), "__id", "left")

    def cut(texts: "pa.Array", gone: "pa.Array") -> pa.Array:
        out = []
        for text, numbers in zip(texts, gone, strict=True):
            drop = set(numbers.as_py() or ())
            out.append("\n".join(x for i, x in enumerate(text.as_py().split("\n")) if i not in drop) if drop and text.is_valid else text.as_py())
        return pa.array(out, pa.string())

    cut_udf = F.arrow_udf(cut, "string")
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cut_udf(F.col(text_col), F.col("__gone")))
    return joined.withColumn(text_col, kept).withColumn(count_col, F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")).drop("__gone", "__id").select(*docs.columns, count_col)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    return deduplicated(docs).select(F.col("doc_id").cast("bigint"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM d),
o AS (SELECT doc_id, i, trim(l[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM x),
q AS (SELECT * FROM o WHERE s <> ''),
u AS (SELECT s, length(s) AS n, min((doc_id, i)) AS f FROM q GROUP BY s),
a AS (SELECT *, (n - 1) // 2 AS p FROM u WHERE n >= 10 UNION SELECT *, (n - 2) // 2 AS p FROM u WHERE n >= 10),
j AS (SELECT a.s AS s1, a.f AS f1, b.s AS s2, b.f AS f2 FROM a JOIN a b ON a.p = b.p AND left(a.s, a.p) = left(b.s, b.p)
    UNION SELECT a.s, a.f, b.s, b.f FROM a JOIN a b ON a.p = b.p AND right(a.s, a.p) = right(b.s, b.p)),
g AS (SELECT DISTINCT s1 AS s FROM j WHERE s1 <> s2 AND f2 < f1 AND abs(length(s1) - length(s2)) <= 1 AND levenshtein(s1, s2) <= 1),
r AS (SELECT q.doc_id, list(q.i) AS gone FROM q JOIN u USING (s) LEFT JOIN g USING (s) WHERE g.s IS NOT NULL OR (q.doc_id, q.i) <> u.f GROUP BY q.doc_id)
SELECT d.doc_id, len(l)::bigint AS n_lines, coalesce(len(gone), 0)::bigint AS n_removed,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(l, chr(10)) ELSE coalesce(array_to_string(list_filter(l, lambda y, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": _SQL}
