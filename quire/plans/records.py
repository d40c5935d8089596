"""Captions, citations, keys, colours and packages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import records
from quire.sources.tables import BLOCKS_SQL, blocks, table

from .book import query

_KIND = "CASE WHEN length(text) < 20 THEN 'figure' WHEN length(text) < 60 THEN 'caption' ELSE 'text' END"


@query(f"""WITH {BLOCKS_SQL}, k AS (SELECT doc_id, pos, {_KIND} AS kind FROM blocks), b AS (SELECT *, sum((kind = 'text')::int) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM k),
    c AS (SELECT *, first_value(CASE WHEN kind = 'caption' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a, last_value(CASE WHEN kind = 'caption' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM b)
    SELECT doc_id, pos, coalesce(a, p) AS caption FROM c WHERE kind = 'figure'""")
def caption_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06, JOIN-11, DOC-12: each figure's caption, forward and then back, up to the next text."""
    kind = F.when(F.length("text") < 20, "figure").when(F.length("text") < 60, "caption").otherwise("text")
    return records.captions_after(blocks(spark, sf_dir).withColumn("kind", kind), "doc_id", "pos", "kind").filter("kind = 'figure'").select("doc_id", "pos", "caption")


@query("""WITH a AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS t FROM lineitem GROUP BY ALL HAVING count(*) = 1), b AS (SELECT l_suppkey, min(l_orderkey) AS t FROM lineitem WHERE l_quantity > 49 GROUP BY ALL HAVING count(*) = 1), p AS (SELECT p_partkey, p_partkey % 100 + 1 AS s FROM part)
    SELECT p_partkey, coalesce(a.t, b.t) AS target FROM p LEFT JOIN a ON a.l_partkey = p_partkey AND a.l_suppkey = s LEFT JOIN b ON b.l_suppkey = s""")
def caption_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, DOC-18: the first map that has exactly one target."""
    li = table(spark, sf_dir, "lineitem")
    refs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100 + 1).alias("l_suppkey"))
    by_both = li.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("target"))
    by_one = li.filter("l_quantity > 49").select("l_suppkey", F.col("l_orderkey").alias("target"))
    return records.resolved(refs, [(by_both, ["l_partkey", "l_suppkey"]), (by_one, ["l_suppkey"])], "p_partkey")


@query("""WITH w AS (SELECT l_orderkey AS t, l_linenumber * 8 + l_quantity::bigint % 5 AS r, (l_quantity::bigint % 5) AS width FROM lineitem), c AS (SELECT t, width, count(*) AS n, min(r) AS f FROM w WHERE width > 1 GROUP BY ALL) SELECT t, arg_max(width, (n, -f)) AS width FROM c GROUP BY t""")
def modal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, DOC-10: the usual width of a table's rows. Rows of one number are told apart by width, so no tie is left."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), (F.col("l_linenumber") * 8 + F.col("l_quantity").cast("bigint") % 5).alias("r"), (F.col("l_quantity").cast("bigint") % 5).alias("width"))
    return records.modal_widths(rows, "t", "r", "width")


@query(r"""WITH t AS (SELECT p_partkey, 'see [' || p_size || ', ' || (p_size + 2) || '-' || (p_size + 4) || '] and [' || p_size || ']' AS s FROM part), g AS (SELECT p_partkey, unnest(regexp_extract_all(s, '\[(\d+(?:\s*[-–,]\s*\d+)*)\]', 1)) AS g FROM t), p AS (SELECT p_partkey, unnest(regexp_split_to_array(g, '\s*,\s*')) AS x FROM g),
    n AS (SELECT p_partkey, unnest(range(regexp_split_to_array(x, '\s*[-–]\s*')[1]::int, regexp_split_to_array(x, '\s*[-–]\s*')[-1]::int + 1))::int AS number FROM p) SELECT p_partkey, number, count(*) AS n FROM n WHERE number IN (SELECT p_size FROM part) GROUP BY ALL""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-16, FUN-17: citations with ranges, linked to the references that there are."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit("see ["), "p_size", F.lit(", "), F.col("p_size") + 2, F.lit("-"), F.col("p_size") + 4, F.lit("] and ["), "p_size", F.lit("]"))
    cited = part.select("p_partkey", F.explode(records.expanded_citations(text)).alias("number"))
    return cited.join(part.select(F.col("p_size").alias("number")).distinct(), "number", "left_semi").groupBy("p_partkey", "number").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, left(event_type, 1) AS text, event_type, (event_id % 50) * 10 AS x0, (event_id % 50) * 10 + 6 AS x1 FROM events), n AS (SELECT *, CASE WHEN lag(x1) OVER w IS NULL OR lag(event_type) OVER w IS DISTINCT FROM event_type OR x0 - lag(x1) OVER w > 100 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n) SELECT user_id, run::bigint AS run, string_agg(text, '' ORDER BY event_id) AS text, min(x0) AS x0, max(x1) AS x1 FROM r GROUP BY user_id, run""")
def glyph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13: glyphs of one style that follow each other."""
    g = table(spark, sf_dir, "events").select("user_id", "event_id", F.substring("event_type", 1, 1).alias("text"), "event_type", ((F.col("event_id") % 50) * 10).alias("x0"), ((F.col("event_id") % 50) * 10 + 6).alias("x1"))
    return records.glyph_runs(g, ["user_id"], "event_id", ["event_type"], "x0", "x1", 100)


@query("""SELECT user_id, event_id FROM (SELECT *, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'view' AND b = 'click' AND c IN ('view', 'click')""")
def sequence_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: consecutive rows that match a pattern."""
    return records.pattern_starts(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["^view$", "^click$", "^(view|click)$"])


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS k, l_linenumber AS l, (min(l_partkey) % 9 + 1)::int AS wanted FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l) AS i FROM w),
    r AS (SELECT DISTINCT k, 0::bigint AS i, 0 AS l, 0 AS number, []::int[] AS used FROM o UNION ALL SELECT k, i, l, number, list_append(used, number) FROM (SELECT o.k, o.i, o.l, used, CASE WHEN list_contains(used, wanted) THEN list_min(list_filter(range(1, len(used) + 2), lambda x: NOT list_contains(used, x::int)))::int ELSE wanted END AS number FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1))
    SELECT k AS l_orderkey, l::int AS l_linenumber, number FROM r WHERE i > 0""")
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16: numbers without collision, taken in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 9 + 1).alias("wanted"))
    return records.numbered(rows, "l_orderkey", "l_linenumber", "wanted")


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part), s AS (SELECT p_partkey, (v >> 16) & 255 AS r, (v >> 8) & 255 AS g, v & 255 AS b FROM c), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM s),
    h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) * 60 WHEN hi = g THEN (b - r) / (hi - lo) * 60 + 120 ELSE (r - g) / (hi - lo) * 60 + 240 END AS h0 FROM m), j AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hue FROM h)
    SELECT p_partkey, CASE WHEN hi = 0 OR (hi - lo) * 5 < hi THEN 'gray' WHEN hue < 15 OR hue >= 345 THEN 'red' WHEN hue < 70 THEN 'orange' WHEN hue < 170 THEN 'green' WHEN hue < 255 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'pink' END AS tone FROM j""")
def colour_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-50: tones of packed colours."""
    return table(spark, sf_dir, "part").select("p_partkey", records.tone((F.col("p_partkey") * 7919) % 16777216).alias("tone"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_extendedprice > 1.2 * 612 THEN (l_partkey % 1000) * 612 / 1000.0 ELSE l_partkey % 1000 END::double, 6) AS x, least(greatest(l_quantity, 5), 40) AS clamped, least(greatest(300 + 25 * l_linenumber, 900), 3600)::bigint AS timeout, round_even(l_discount * 50, 0) AS rating FROM lineitem""")
def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-34, FUN-36, FUN-51: clamps, half-even rounding, time budgets and coordinates in points."""
    x = records.rescaled(F.col("l_partkey") % 1000, F.col("l_extendedprice"), F.lit(612))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(x.cast("double"), 6).alias("x"), F.least(F.greatest("l_quantity", F.lit(5)), F.lit(40)).alias("clamped"),
        F.least(F.greatest(300 + 25 * F.col("l_linenumber"), F.lit(900)), F.lit(3600)).cast("bigint").alias("timeout"), F.rint(F.col("l_discount") * 50).alias("rating"),
    )


@query(r"""SELECT doc_id, left(sha256(text), 16) AS short_id, sha256('default' || chr(10) || 'zh-CN' || chr(10) || doc_id || chr(10) || sha256(text)) AS cache_key, (length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::bigint AS utf16 FROM documents""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-20, FUN-40, FUN-41: truncated hashes, cache keys and UTF-16 offsets."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    key = F.sha2(F.concat_ws("\n", F.lit("default"), F.lit("zh-CN"), "doc_id", sha).cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(sha, 1, 16).alias("short_id"), key.alias("cache_key"), (F.length(F.encode("text", "UTF-16LE")) / 2).cast("bigint").alias("utf16"))


@query("""WITH k AS (SELECT l_orderkey AS parent, list_sort(list(DISTINCT 'n' || l_linenumber) FILTER (l_linenumber % 2 = 0)) AS notes, list_sort(list(DISTINCT 'a' || l_linenumber) FILTER (l_linenumber % 2 = 1)) AS attachments FROM lineitem GROUP BY ALL)
    SELECT 'o' || o_orderkey AS key, coalesce(notes, []) AS notes, coalesce(attachments, []) AS attachments, CASE WHEN n_name IS NULL THEN [] ELSE [n_name] END AS names FROM orders LEFT JOIN k ON parent = o_orderkey LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def package_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, DOC-23: items with their notes, attachments and collections."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    note = F.col("l_linenumber") % 2 == 0
    children = li.select(F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.when(note, "note").otherwise("attachment").alias("kind"), F.concat(F.when(note, "n").otherwise("a"), "l_linenumber").alias("key"))
    items = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("key"), F.array(F.col("o_custkey") % 30).alias("collections"))
    return records.packages(items, children, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query(r"""WITH p AS (SELECT user_id, event_id, event_type || ': ' || (event_id % 7) || '/' || 7 AS line FROM events WHERE event_type <> 'error')
    SELECT user_id, arg_max(regexp_extract(line, '^(\w[\w ]*?):', 1), event_id) AS stage, arg_max(regexp_extract(line, '(\d+)\s*/\s*(\d+)', 1)::int, event_id) AS done, 7 AS total FROM p GROUP BY user_id""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: the last progress that output lines tell."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return records.progress(e.select("user_id", "event_id", F.concat("event_type", F.lit(": "), F.col("event_id") % 7, F.lit("/7")).alias("line")), "user_id", "event_id", "line")


@query("""SELECT user_id, arg_max(props, event_id) AS text, arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')) AS evidence FROM events GROUP BY user_id""")
def knowledge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: evidence stays frozen until it is saved again."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("text"), F.col("event_type").alias("evidence"), F.col("event_type").isin("purchase", "signup").alias("saves"))
    return records.frozen_upsert(e, "user_id", F.col("event_id"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, string_agg(CASE WHEN pos = 0 THEN '# ' || text WHEN length(text) < 15 THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS markdown FROM blocks GROUP BY doc_id""")
def markdown_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, FUN-14: documents as Markdown of their ordered blocks."""
    kind = F.when(F.col("pos") == 0, "heading").when(F.length("text") < 15, "item").otherwise("text")
    return records.markdown(blocks(spark, sf_dir).withColumn("kind", kind).withColumn("level", F.lit(1)), "doc_id", "pos")


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS entries FROM (SELECT user_id, event_type, max(event_id) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def translation_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, FUN-47: entries of each document as a map by key, the latest for each."""
    latest = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("n"))
    return latest.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("entries"))
