"""Markdown, JSON, contents pages, hierarchies and repeated references over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import reconstruct
from quire.sources.tables import table

from .book import query

_MARKDOWN = "concat('**', p_name, '** & *', p_brand, '* `x<', p_size, '` [', p_type, '](https://h.org/', p_partkey, ') [no](ftp://x) <b>')"


@query(rf"""WITH t AS (SELECT p_partkey, replace(replace(replace({_MARKDOWN}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '`([^`]+)`', '<code>\1</code>', 'g'), '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '\*([^*]+)\*', '<em>\1</em>', 'g'), '\[([^\]]+)\]\((https?://[^\s)"]+)\)', '<a href="\2">\1</a>', 'g') AS html FROM t""")
def inline_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-22: inline Markdown as safe HTML."""
    return table(spark, sf_dir, "part").select("p_partkey", markup.inline_html(F.expr(_MARKDOWN)).alias("html"))


_JSON = """concat('{"z": "', p_name, '", "a": ["', p_brand, '", {"c": " ', p_type, ' ", "b": ""}], "n": ', p_size, '}')"""


@query("""SELECT p_partkey, concat('{"a":["', p_brand, '",{"b":"","c":" ', p_type, ' "}],"n":', p_size, ',"z":"', p_name, '"}') AS canonical, concat(p_name, ' ', p_brand, ' ', p_type) AS text FROM part""")
def json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-45, FUN-49: all strings of JSON, and JSON in one form."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_JSON).alias("j"))
    return t.select("p_partkey", markup.json_canonical("j").alias("canonical"), markup.json_text("j").alias("text"))


@query("""SELECT p_partkey, unnest([{'id': '1', 'text': p_name, 'depth': 0}, {'id': '1.1', 'text': 'x', 'depth': 1}, {'id': '1.2', 'text': p_brand, 'depth': 1}, {'id': '1.2.1', 'text': p_size::varchar, 'depth': 2}, {'id': '2', 'text': p_type, 'depth': 0}], recursive := true) FROM part""")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-46: items of nested lists with ids of their places."""
    j = """concat('[{"text": "', p_name, '", "items": ["x", {"text": "', p_brand, '", "items": ["', p_size, '"]}]}, "', p_type, '"]')"""
    t = table(spark, sf_dir, "part").select("p_partkey", F.explode(markup.nested_items(F.expr(j))).alias("x"))
    return t.select("p_partkey", "x.id", "x.text", "x.depth")


_LINE = "CASE s % 6 WHEN 0 THEN 'Contents' WHEN 1 THEN 'plain text' ELSE concat('Part ', s) END"


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS pos, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), o AS (SELECT doc, page, {_LINE} AS t, row_number() OVER (PARTITION BY doc ORDER BY page, pos) AS i FROM b),
    r AS (SELECT DISTINCT doc, 0::bigint AS i, NULL::int AS opn, 0 AS page, false AS hit FROM o UNION ALL SELECT o.doc, o.i, CASE WHEN t = 'Contents' OR (opn IS NOT NULL AND o.page - opn <= 1 AND regexp_matches(t, '[0-9]$')) THEN o.page END::int, o.page::int, t = 'Contents' OR (opn IS NOT NULL AND o.page - opn <= 1 AND regexp_matches(t, '[0-9]$')) FROM r JOIN o ON o.doc = r.doc AND o.i = r.i + 1)
    SELECT DISTINCT doc, page::bigint AS page FROM r WHERE hit""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: pages of a table of contents."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("pos")).agg(F.min("l_suppkey").alias("s"))
    return markup.contents_pages(b.select("doc", "page", "pos", F.expr(_LINE).alias("text")))


@query("""WITH RECURSIVE f AS (SELECT 'f' || s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN 'f' || (s_suppkey * 3 % 17) WHEN s_suppkey % 10 = 0 THEN 'lost' || s_suppkey END AS up FROM supplier),
    a AS (SELECT id, up FROM f UNION ALL SELECT DISTINCT up, NULL FROM f WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM f)), r AS (SELECT id, up AS b FROM a WHERE up IS NOT NULL UNION SELECT r.id, a.up FROM r JOIN a ON a.id = r.b WHERE a.up IS NOT NULL)
    SELECT id AS folder_id, CASE WHEN id NOT IN (SELECT id FROM r WHERE id = b) THEN up END AS parent_id FROM a""")
def hierarchy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06: missing parents are added, cycles broken at the top."""
    key = F.col("s_suppkey")
    up = F.when(key % 5 > 0, F.concat(F.lit("f"), key * 3 % 17)).when(key % 10 == 0, F.concat(F.lit("lost"), key))
    return reconstruct.repaired_hierarchy(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), key).alias("folder_id"), up.alias("parent_id")))


_WORDS = "CASE WHEN idx = 1 THEN 'w2 w3 w4' WHEN idx = 2 THEN 'W2 w3' ELSE concat('w', idx) END"


@query(f"""WITH b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS idx FROM lineitem), t AS (SELECT *, CASE WHEN idx = 1 THEN 0 ELSE idx * 10 END AS x0, CASE WHEN idx = 1 THEN 100 ELSE idx * 10 + 5 END AS x1, string_split(lower({_WORDS}), ' ') AS w FROM b),
    p AS (SELECT o.page, o.idx, count(*) AS n, any_value(o.w) AS w, flatten(list(i.w)) AS have FROM t o JOIN t i ON o.page = i.page AND o.idx <> i.idx AND i.x0 >= o.x0 AND i.x1 <= o.x1 GROUP BY o.page, o.idx),
    g AS (SELECT page, idx FROM p WHERE n > 1 AND len(list_filter(w, lambda x: list_contains(have, x))) >= 0.97 * len(w)) SELECT page, idx FROM t WHERE (page, idx) NOT IN (SELECT (page, idx) FROM g)""")
def reference_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: blocks that only repeat what stands in them go."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx")).distinct()
    x0, x1 = F.when(F.col("idx") == 1, 0).otherwise(F.col("idx") * 10), F.when(F.col("idx") == 1, 100).otherwise(F.col("idx") * 10 + 5)
    boxes = b.select("page", "idx", x0.alias("x0"), x1.alias("x1"), x0.alias("y0"), x1.alias("y1"), F.expr(_WORDS).alias("text"))
    return markup.without_aggregates(boxes).select("page", "idx")
