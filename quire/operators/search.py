"""Phrase search with BM25 ranking over sources of several kinds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

KINDS = ("metadata", "notes", "annotations", "content")
K1, B = 1.2, 0.75


def phrases(query: str) -> list[list[str]]:
    """Each word of a query is a phrase of lexical tokens; no query syntax is read."""
    import re

    def tokens(word: str) -> list[str]:
        apart = re.sub(r"([㐀-鿿])", r" \1 ", word).lower()
        runs = ("".join(x if x.isalnum() else " " for x in apart)).split()
        return [r.translate(T.PLAIN) for r in runs]

    if len(query) > 500:
        raise ValueError("a query has at most 500 characters")
    return [t for word in query.split() if (t := tokens(word))]


def bm25(n: int) -> Column:
    """The score of n phrases, of which columns tf, df, size, n and mean tell; a lower one is better."""

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean")))

    return -reduce(lambda a, b: a + b, [part(i) for i in range(n)])


def matching(sources: DataFrame, query: str) -> DataFrame:
    """`sources` (job_id, kind, source_id, text) with `score`, for rows that hold every phrase; a lower score is better.

    Statistics cover all rows of `sources`; filter by kind or folder afterwards. Two passes: one
    aggregate of a single row, then scores without a shuffle.
    """
    wanted = phrases(query)
    if not wanted:
        return sources.withColumn("score", F.lit(0.0))

    def counts(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("size"), *[T.phrase_count(tokens, p).alias(f"tf{i}") for i, p in enumerate(wanted)])

    # Within a transform the tokens are a variable: each text is split once, however many phrases there are.
    counted = sources.withColumn("counts", F.element_at(F.transform(F.array(T.lexical_tokens(F.col("text"))), counts), 1)).select(*sources.columns, "counts.*")
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])

    hit = reduce(and_, [F.col(f"tf{i}") > 0 for i in range(len(wanted))])
    score = bm25(len(wanted))
    one_row = F.broadcast(stats)
    return counted.filter(hit).join(one_row, F.lit(True)).withColumn("score", score).select(*sources.columns, "score")


def checked(limit: int, offset: int, kinds: list[str] | None) -> None:
    """Raises for a page or kinds that can't be."""
    if isinstance(limit, bool) or not 1 <= limit <= 100 or isinstance(offset, bool) or offset < 0:
        raise ValueError("limit is 1 to 100, offset not negative")
    if kinds is not None and not set(kinds) <= set(KINDS):
        raise ValueError(f"kinds are of {KINDS}")


def search(sources: DataFrame, query: str = "", limit: int = 30, offset: int = 0, kinds: list[str] | None = None, folder_items: DataFrame | None = None) -> DataFrame:
    """A page of hits: job_id, kind, source_id, score, snippet and the total before paging."""
    checked(limit, offset, kinds)
    found = matching(sources, query)
    if kinds is not None:
        found = found.filter(F.col("kind").isin(kinds))
    if folder_items is not None:
        found = found.join(folder_items.select("job_id").distinct(), "job_id", "left_semi")
    total = F.broadcast(found.agg(F.count("*").alias("total")))
    order = ["score", "job_id", "source_id"] if phrases(query) else ["job_id", "kind", "source_id"]
    page = found.orderBy(*order).offset(offset).limit(limit)
    return page.join(total, F.lit(True)).select("job_id", "kind", "source_id", F.round("score", 6).alias("score"), T.snippet(F.col("text"), query).alias("snippet"), "total")


def allowed_kinds(scopes: list[str], asked: list[str] | None) -> list[str]:
    """Kinds that scopes grant; asking for another one is an error."""
    granted = [k for k in KINDS if f"read:{k}" in scopes]
    if asked is None:
        return granted
    if set(asked) - set(granted):
        raise PermissionError(f"not granted: {sorted(set(asked) - set(granted))}")
    return asked
