"""Layout sidecars: JSON of pages, of elements, of nested values, read under ceilings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut


@dataclass(frozen=True)
class Ceilings:
    """What a sidecar may have at most: bytes of JSON, pages, elements, values of any kind, characters of strings and keys, and levels below the whole."""

    size: int = 16 << 20
    pages: int = 512
    elements: int = 100_000
    nodes: int = 1_000_000
    chars: int = 8_000_000
    depth: int = 64


def scan(rows: DataFrame, key: list[str], text: str = "json", ceilings: Ceilings = Ceilings()) -> tuple[DataFrame, DataFrame]:
    """What each sidecar holds, and the elements of those that are within the ceilings.

    The first has the key, a status (`ok`, `too large`, `no json`, `no pages`, or `too many` pages,
    elements, nodes or chars, or `too deep`: the first that holds, in this order), and the counts as
    far as they were made. The second has page, element, type and text (the strings below it but its
    types, in order). Values are VARIANT and are walked level by level: each level is one step over
    all sidecars, which leave the walk when they pass a ceiling, so that no value is ever taken
    apart in one piece. Keys have to be unique; null texts are `no json`; an empty table gives two.
    """
    c = ceilings
    v = F.when(F.octet_length(F.col(text)) <= c.size, F.try_parse_json(F.col(text)))
    own = cut(rows.select(*key, F.octet_length(F.col(text)).alias("size"), v.alias("v")))
    listed = "try_variant_get(v, '$', 'array<variant>')"
    own = own.withColumn("pages", F.expr(f"size({listed})"))
    own = own.withColumn("elements", F.expr(f"aggregate(coalesce({listed}, array()), 0L, (n, p) -> n + coalesce(size(try_variant_get(p, '$', 'array<variant>')), 0))"))
    all_lists = F.expr(f"size({listed}) > 0 AND forall({listed}, p -> startswith(schema_of_variant(p), 'ARRAY'))")
    early = F.when(F.col("size") > c.size, "too large").when(F.col("v").isNull(), "no json").when(~F.coalesce(all_lists, F.lit(False)), "no pages").when(F.col("pages") > c.pages, "too many pages").when(F.col("elements") > c.elements, "too many elements")
    own = cut(own.withColumn("early", early))

    level = own.filter("early is null").select(*key, F.col("v").alias("value"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("element"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"))
    told, strings, totals, depth = [], [], None, 0
    while True:
        kind = F.expr("schema_of_variant(value)")
        string = F.when(kind == "STRING", F.expr("variant_get(value, '$', 'string')"))
        level = cut(level.withColumn("kind", kind).withColumn("string", string))
        count = level.groupBy(*key).agg(F.count("*").alias("nodes"), F.sum(F.coalesce(F.length("string"), F.lit(0)) + F.coalesce(F.length("name"), F.lit(0))).alias("chars"), F.lit(depth).alias("depth"))
        told.append(cut(count))
        strings.append(level.filter("element is not null and string is not null").select(*key, "page", "element", "path", "name", "string"))
        totals = reduce(DataFrame.unionByName, told).groupBy(*key).agg(F.sum("nodes").alias("nodes"), F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
        below = level.filter(F.col("kind").startswith("ARRAY") | F.col("kind").startswith("OBJECT"))
        if depth > c.depth or below.isEmpty():
            break
        passed = totals.filter((F.col("nodes") > c.nodes) | (F.col("chars") > c.chars))
        kids = below.join(passed.select(*key), key, "left_anti").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("at", "sub", "child"))
        first = [F.col("at") if depth == 0 else F.col("page"), F.col("at") if depth == 1 else F.col("element")]
        level = kids.select(*key, F.col("child").alias("value"), first[0].alias("page"), first[1].alias("element"), F.array_append("path", F.col("at")).alias("path"), F.col("sub").alias("name"))
        depth += 1

    both = own.select(*key, "early", "pages", "elements").join(totals, key, "left")
    status = F.coalesce("early", F.when(F.col("depth") > c.depth, "too deep").when(F.col("nodes") > c.nodes, "too many nodes").when(F.col("chars") > c.chars, "too many chars").otherwise("ok"))
    found = cut(both.select(*key, status.alias("status"), "pages", "elements", "nodes", "depth", "chars"))
    held = reduce(DataFrame.unionByName, strings).join(found.filter("status = 'ok'").select(*key), key, "left_semi")
    words = F.array_sort(F.collect_list(F.when(F.col("name").isNull() | (F.col("name") != "type"), F.struct("path", "string"))))
    elements = held.groupBy(*key, "page", "element").agg(F.max(F.when((F.col("name") == "type") & (F.size("path") == 3), F.col("string"))).alias("type"), F.array_join(F.transform(words, lambda x: x["string"]), " ").alias("text"))
    return found, elements
