"""Duplicate groups and merges of their records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, content: Column, quality: list[Column], key: str) -> DataFrame:
    """(sha, members, canonical): groups of two or more with equal content; canonical is the key of best quality, by aggregation."""
    best = F.max(F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)], F.col(key).alias("key")))
    out = rows.groupBy(F.sha2(content.cast("binary"), 256).alias("sha")).agg(F.count("*").alias("members"), best.alias("best"))
    return out.filter("members >= 2").select("sha", "members", F.col("best.key").alias("canonical"))


def latest(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """One row for each key: the latest value (ties: the later in `order`), its variants and the number of conflicts."""
    pos = F.struct(*order)
    return rows.groupBy(*key).agg(F.max_by(value, pos).alias(value), F.array_sort(F.collect_set(value)).alias("variants"), (F.count_distinct(value) - 1).alias("conflicts"))


def annotation_winners(rows: DataFrame, signature: list[str]) -> DataFrame:
    """One annotation for each signature: manual before suggested, with a note before without, then the earliest; all distinct notes joined."""
    rank = F.struct((F.col("source") != "manual").alias("a"), (F.coalesce("note", F.lit("")) == "").alias("b"), F.col("created").alias("c"), F.col("id").alias("d"))
    notes = F.filter(F.array_sort(F.collect_set(F.struct("created", "note"))), lambda x: F.coalesce(x["note"], F.lit("")) != "")
    joined = F.array_join(F.array_distinct(F.transform(notes, lambda x: x["note"])), "\n\n")
    return rows.groupBy(*signature).agg(F.min_by("id", rank).alias("id"), F.min_by("source", rank).alias("source"), joined.alias("note"), F.bool_or(F.col("source") == "ai").alias("merged_ai"))


def field_winners(candidates: DataFrame) -> DataFrame:
    """(record, field, value, provider): the most confident candidate; of equal ones the later."""
    order = F.struct("confidence", "seq")
    return candidates.groupBy("record", "field").agg(F.max_by("value", order).alias("value"), F.max_by("provider", order).alias("provider"))


def merged_fields(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current fields replaced by incoming ones that are as confident, unless locked; empty values never replace."""
    b = incoming.withColumnsRenamed({"value": "new_value", "confidence": "new_confidence"})
    both = current.join(b, ["record", "field"], "full_outer")
    take = F.col("value").isNull() | (~F.coalesce("locked", F.lit(False)) & (F.col("new_confidence") >= F.col("confidence")))
    take = take & (F.coalesce("new_value", F.lit("")) != "")
    return both.select("record", "field", F.when(take, F.col("new_value")).otherwise(F.col("value")).alias("value"), F.when(take, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def anchored(quotes: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """(quote_id, n, place): how many texts hold each quote, and the only one that does.

    The inner words of a quote stand between white space in every text that holds it, wherever the
    quote begins; so places and quotes are joined by a hash of up to `words` of them. A quote of less
    than three words has none: it is joined by its characters, at every place. Texts themselves are
    only brought to the pairs that such a key finds, and `contains` verifies.
    """
    w = F.split(F.trim("quote"), r"\s+")
    inner = F.greatest(F.lit(0), F.least(F.lit(words), F.size(w) - 2))
    asked = quotes.filter("trim(quote) <> ''").select("quote_id", "quote", inner.alias("n"), F.when(inner > 0, 0).otherwise(F.length("quote")).alias("chars"), F.when(inner > 0, F.array_join(F.slice(w, F.lit(2), inner), " ")).otherwise(F.col("quote")).alias("k"))
    keys = asked.select("quote_id", "n", "chars", F.xxhash64("k").alias("k"))
    sizes = [(r["n"], r["chars"]) for r in keys.select("n", "chars").distinct().collect()]  # at most `words`, and the lengths of short quotes
    if not sizes:
        return quotes.select("quote_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(texts.schema["place"].dataType).alias("place"))

    def places(n: int, chars: int) -> Column:
        if n:
            found = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, n), " ")))
            found = F.when(F.size("w") >= n, found)
        else:
            found = F.when(F.length("text") >= chars, F.transform(F.sequence(F.lit(1), F.length("text") - chars + 1), lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(chars)))))
        return F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>")))

    split = texts.select("place", "text", F.split("text", r"\s+").alias("w"))
    each = reduce(DataFrame.union, [split.select("place", F.lit(n).alias("n"), F.lit(chars).alias("chars"), F.explode(places(n, chars)).alias("k")) for n, chars in sizes])
    small = keys.count() * 40 <= 1 << 20
    pairs = each.join(F.broadcast(keys) if small else keys.hint("merge"), ["n", "chars", "k"]).select("quote_id", "place").distinct()
    exact = pairs.join(asked.select("quote_id", "quote"), "quote_id").join(texts.select("place", "text"), "place").filter(F.contains("text", "quote")).select("quote_id", "place").distinct()
    found = exact.groupBy("quote_id").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    return quotes.join(found, "quote_id", "left").select("quote_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("place")).alias("place"))
