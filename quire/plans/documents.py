"""Layout, HTML and text checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout
from quire.sources.tables import BLOCKS_SQL, BOXES_SQL, blocks, boxes, table

from .book import query

_OVERLAP = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"""WITH {BOXES_SQL}, p AS (SELECT a.page, a.idx, b.idx AS m, {_OVERLAP} AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM boxes a JOIN boxes b ON a.page = b.page AND a.engine = 'a' AND b.engine = 'b'),
    f AS (SELECT *, round(o / (sa + sb - o), 6) AS iou FROM p WHERE sa > 0 AND o > 0 AND o >= 0.7 * least(sa, sb)) SELECT page, idx, arg_max(m, (iou, -m)) AS "match", max(iou) AS iou FROM f GROUP BY page, idx""")
def box_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05, FUN-32, SRC-09: boxes of one engine matched with the other's."""
    b = boxes(spark, sf_dir)
    return layout.best_matches(b.filter("engine = 'a'"), b.filter("engine = 'b'"))


@query(f"WITH {BOXES_SQL} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY page")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: the box around all boxes of a page."""
    return layout.union_box(boxes(spark, sf_dir), "page")


@query(f"""WITH RECURSIVE {BOXES_SQL}, n AS (SELECT *, row_number() OVER () AS k FROM boxes), e AS (SELECT a.k AS u, b.k AS v, b.idx FROM n a JOIN n b ON a.page = b.page AND greatest(0, a.x0 - b.x1, b.x0 - a.x1) <= 16 AND greatest(0, a.y0 - b.y1, b.y0 - a.y1) <= 16),
    r AS (SELECT u, v, idx FROM e UNION SELECT r.u, e.v, e.idx FROM r JOIN e ON e.u = r.v), g AS (SELECT u, min(idx) AS m FROM r GROUP BY u) SELECT page, idx, m::int AS "group" FROM n JOIN g ON g.u = k""")
def box_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-05, JOIN-06: groups of boxes that are near each other."""
    return layout.box_groups(boxes(spark, sf_dir), 16.0)


@query(f"WITH {BOXES_SQL} SELECT page, count(*) FILTER (x1 <= 350) >= 2 AND count(*) FILTER (x0 >= 350) >= 2 AND coalesce(sum(idx * 20) FILTER (x1 <= 350), 0) >= 80 AND coalesce(sum(idx * 20) FILTER (x0 >= 350), 0) >= 80 AS two_columns FROM boxes GROUP BY page")
def columns_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-03: pages of two columns."""
    return layout.columns_of(boxes(spark, sf_dir).withColumn("chars", F.col("idx") * 20), 700)


@query(f"""WITH {BOXES_SQL}, s AS (SELECT *, x1 - x0 >= 0.6 * 700 AS wide FROM boxes), g AS (SELECT *, sum(wide::int) OVER (PARTITION BY page ORDER BY y0, x0, idx ROWS UNBOUNDED PRECEDING) * 2 - wide::int AS segment, CASE WHEN wide OR (x0 + x1) / 2 < 350 THEN 0 ELSE 1 END AS col FROM s)
    SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY segment, col, (y0 + y1) / 2, x0, idx)::int AS reading_order FROM g""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: order of a page's blocks."""
    return layout.reading_order(boxes(spark, sf_dir), 700).select("page", "idx", "reading_order")


@query(rf"""WITH {BLOCKS_SQL}, k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '\d+', '#', 'g')) AS key FROM blocks)
    SELECT key, count(DISTINCT doc_id) AS pages, arg_min(text, (doc_id, pos)) AS first_text FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3""")
def edge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, FLT-13, FUN-07: texts that several pages repeat."""
    return layout.repeated_edges(blocks(spark, sf_dir).withColumnRenamed("doc_id", "page"), 3)


@query(rf"""WITH {BLOCKS_SQL} SELECT doc_id, pos FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM blocks) WHERE NOT regexp_matches(trim(text), '[.!?:;。！？]$') AND regexp_matches(following, '^\p{{Ll}}')""")
def continuation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: paragraphs that go on in the next."""
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))
    return blocks(spark, sf_dir).withColumn("following", following).filter(layout.continues(F.col("text"), F.col("following"))).select("doc_id", "pos")


@query(rf"""WITH {BLOCKS_SQL}, s AS (SELECT *, NOT coalesce(NOT regexp_matches(trim(lag(text) OVER w), '[.!?:;。！？]$') AND regexp_matches(text, '^\p{{Ll}}'), false) AS start FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    i AS (SELECT *, sum(start::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT doc_id, min(pos) AS pos, regexp_replace(string_agg(text, chr(1) ORDER BY pos), '-' || chr(1) || '|' || chr(1), lambda_gap, 'g') AS text, count(*)::int AS parts FROM i, (SELECT ' ' AS lambda_gap) GROUP BY doc_id, island, lambda_gap""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, FUN-13: runs of paragraphs that continue each other."""
    return layout.merged_runs(blocks(spark, sf_dir), "doc_id", "pos")


@query(f"WITH {BLOCKS_SQL} SELECT block_id, last_value(CASE WHEN length(text) < 25 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM blocks")
def section_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: each block's section, carried on from headings."""
    heading = F.when(F.length("text") < 25, F.col("text"))
    return layout.carried_sections(blocks(spark, sf_dir), "doc_id", "pos", heading).select("block_id", "section")


@query("""WITH s AS (SELECT l_orderkey AS page, l_partkey % 200 AS "start", l_partkey % 200 + l_quantity::bigint AS "end" FROM lineitem),
    m AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY page ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM s),
    i AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT page, min("start") AS "start", max("end") AS "end" FROM i GROUP BY page, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: overlapping ranges as one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_quantity").cast("bigint")).alias("end"))
    return layout.merged_intervals(rows, "page")


@query(f"""WITH {BOXES_SQL} SELECT p.page, p.idx, f.idx AS figure FROM boxes p JOIN boxes f ON p.page = f.page WHERE p.engine = 'a' AND f.engine = 'b' AND (p.y0 + p.y1) // 2 BETWEEN f.y0 - 36 AND f.y1 + 90""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: spans whose middle is in the band of a figure."""
    b = boxes(spark, sf_dir)
    points = b.filter("engine = 'a'").select("page", "idx", F.expr("(y0 + y1) div 2").alias("y"))
    return layout.band_join(points, b.filter("engine = 'b'").select("page", F.col("idx").alias("figure"), (F.col("y0") - 36).alias("top"), (F.col("y1") + 90).alias("bottom"))).select("page", "idx", "figure")


@query("""SELECT a.l_orderkey * 10 + a.l_linenumber AS ref, arg_min(b.l_orderkey * 10 + b.l_linenumber, (abs(b.l_orderkey - a.l_orderkey), abs(b.l_linenumber - a.l_linenumber), b.l_orderkey * 10 + b.l_linenumber)) AS target
    FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_orderkey, a.l_linenumber""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10, SRT-08: the nearest group with the same number."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    refs = li.select(key.alias("ref"), "l_partkey", F.col("l_suppkey").alias("s1"), F.col("l_orderkey").alias("r_page"), F.col("l_linenumber").alias("r_ord"))
    targets = li.select(key.alias("target"), "l_partkey", F.col("l_suppkey").alias("s2"), F.col("l_orderkey").alias("t_page"), F.col("l_linenumber").alias("t_ord"))
    return layout.nearest(refs, targets, ["l_partkey"], F.col("s1") != F.col("s2"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL),
    g AS (SELECT l_orderkey AS t, l_linenumber AS r, l_returnflag AS a, CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 40 THEN 'x' ELSE l_returnflag END AS b FROM u)
    SELECT t AS "table", r AS row, 0 AS col, a AS left_text, b AS right_text, CASE WHEN b IS NULL THEN 'left only' WHEN a = b THEN 'same' ELSE 'different' END AS verdict FROM g""")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08, JOIN-09: cells of one table as two engines read it."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row"))
    li = cells.agg(F.lit(0).alias("col"), F.min("l_returnflag").alias("text"), F.max("l_quantity").alias("l_quantity"))
    other = li.filter("l_quantity <= 45").withColumn("text", F.when(F.col("l_quantity") > 40, "x").otherwise(F.col("text")))
    return layout.grid_difference(li.drop("l_quantity"), other.drop("l_quantity"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem")
def duplicate_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08, WIN-12: the k-th of equal boxes."""
    w = Window.partitionBy("l_returnflag", "l_linestatus", "l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '(?i)<a ')) AS n_links, len(regexp_extract_all(html, '(?i)<img')) AS n_images, len(regexp_extract_all(html, '(?i)<table')) AS n_tables,
    len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS n_headings, CASE WHEN len(regexp_extract_all(html, '(?i)<p[ >]')) = 0 THEN 'FAIL' WHEN len(regexp_extract_all(html, '(?i)<p[ >]')) < 4 THEN 'REVIEW' ELSE 'PASS' END AS status FROM pages""")
def html_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, AGG-12, AGG-22: structure counts of pages and a verdict."""
    counts = {"n_paragraphs": "(?i)<p[ >]", "n_links": "(?i)<a ", "n_images": "(?i)<img", "n_tables": "(?i)<table", "n_headings": "(?i)<h[1-6][ >]"}
    rows = table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).cast("bigint").alias(n) for n, p in counts.items()])
    return rows.withColumn("status", F.when(F.col("n_paragraphs") == 0, "FAIL").when(F.col("n_paragraphs") < 4, "REVIEW").otherwise("PASS"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-09: text of pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, FUN-16: links of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 3.0 + (octet_length(encode(text)) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 1.5)::bigint AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-31: tokens of each document, roughly."""
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query(r"""SELECT conv_id, max(turn) AS last_turn, count(*) AS n, list_sort(list(DISTINCT x)) AS marks FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+\.')) AS x FROM conversations) GROUP BY conv_id""")
def placeholder_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, FUN-26: tokens of each conversation that have to stay."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+\."), F.lit(0))).alias("x"))
    return rows.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.array_sort(F.collect_set("x")).alias("marks"))


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, pos, text, len(string_split(lower(text), 'license')) - 1 + len(string_split(lower(text), 'secret')) - 1 + len(string_split(lower(text), 'the')) - 1 AS score FROM blocks)
    SELECT doc_id, max(score) AS score, arg_max(pos, (score, -pos)) AS pos FROM s GROUP BY doc_id""")
def marker_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, SRT-07: the block that scores most for a category of markers."""
    scored = blocks(spark, sf_dir).withColumn("score", T.marker_score(F.col("text"), ["license", "secret", "the"]))
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"))


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '(\d)\D', '\1  ', 'g'), '\d{4,}'), lambda y: CASE WHEN length(y) = 4 THEN y::int END), lambda y: y BETWEEN 1800 AND 2028)[1] AS year FROM documents""")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-39: the first year of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", T.year(F.col("text"), 2026).alias("year"))


@query(r"SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' (' || p_size || ')', '\s*\(\d+\)\s*$', '')), '[^\p{L}\p{N}]+', '', 'g') AS key, trim(regexp_replace(regexp_replace(lower(p_type || '-' || p_partkey), '[^\p{L}\p{N}_]+', ' ', 'g'), '\d+', '#', 'g')) AS edge FROM part")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-06, FUN-07, JOIN-16: keys under which names and edge lines are equal."""
    return table(spark, sf_dir, "part").select("p_partkey", T.title_key(F.concat("p_name", F.lit(" ("), "p_size", F.lit(")"))).alias("key"), T.edge_key(F.concat_ws("-", "p_type", "p_partkey")).alias("edge"))
