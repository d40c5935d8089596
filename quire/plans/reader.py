"""What a reader and its assistant need, over the driver's tables: identifiers, roles, sentences, spans, budgets and evidence.

Where the tables have no such text, it is put together by an expression that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup, vectors
from quire.functions import text as T
from quire.operators import reader
from quire.sources.tables import table

from .book import query

_IDS = """CASE p_partkey % 6 WHEN 0 THEN concat('see https://doi.org/10.1000/Part.', p_partkey, '(', p_size, ').') WHEN 1 THEN concat('doi: 10.55555/(a', p_partkey, ')x), and more') WHEN 2 THEN concat('arXiv: 1706.0', 1000 + p_partkey % 9000, 'v2 of ', p_name)
    WHEN 3 THEN concat('http://arxiv.org/abs/hep-th/990', 1000 + p_partkey % 9000) WHEN 4 THEN concat('PMID: ', 10000 + p_partkey, ' ', p_name) ELSE p_name END"""


@query(rf"""WITH t AS (SELECT p_partkey, {_IDS} AS t FROM part), r AS (SELECT p_partkey, t, lower(regexp_replace(regexp_extract(t, '{T.DOI}'), '[.,;:]+$', '')) AS d, regexp_extract(t, '{T.ARXIV_NEW}', 1) AS n, regexp_extract(t, '{T.ARXIV_OLD}', 1) AS o, regexp_extract(t, '{T.PMID}', 1) AS pmid FROM t)
    SELECT p_partkey, left(d, (length(d) - greatest(0, least(length(regexp_extract(d, '\)+$')), length(regexp_replace(d, '[^)]', '', 'g')) - length(regexp_replace(d, '[^(]', '', 'g')))))::int) AS doi, CASE WHEN n <> '' THEN n ELSE o END AS arxiv, pmid FROM r""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-10: DOI, arXiv and PubMed identifiers in texts."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_IDS).alias("t"))
    return t.select("p_partkey", T.doi(F.col("t")).alias("doi"), T.arxiv_id(F.col("t")).alias("arxiv"), T.pmid(F.col("t")).alias("pmid"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(text, '([\x{3400}-\x{9fff}])', ' \1 ', 'g'))), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(w)::int AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM t""")
def lexical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-01: the tokens of whole texts that the search reads."""
    w = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.lexical_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


_VENUE = """CASE p_partkey % 8 WHEN 0 THEN concat('Advances in Neural Information Processing Systems ', p_size) WHEN 1 THEN concat('Proceedings of the ', p_size, 'th Meeting on ', p_name, ' (ABC-', p_size, ')') WHEN 2 THEN concat('2020 ', p_name, ', 2021') WHEN 3 THEN concat(' ,', p_name, ' ;')
    WHEN 4 THEN 'arXiv:1706.03762' WHEN 5 THEN concat('IEEE Conf. on Computer Vision and  Pattern Recognition ', p_size) WHEN 6 THEN '' ELSE concat('ｐｒｏｃ ', p_name, ' ﬁrst') END"""
_NARROW = "replace(translate(t, 'ｐｒｏｃ', 'proc'), 'ﬁ', 'fi')"


def _venue_sql() -> str:
    bare = "name"
    for p in T.VENUE_NOISE:
        bare = f"regexp_replace({bare}, '{p}', '')"
    known = " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{label}'" for p, label in T.VENUES)
    return rf"""WITH t AS (SELECT p_partkey, {_VENUE} AS t FROM part), n AS (SELECT p_partkey, regexp_replace(trim(regexp_replace({_NARROW}, '\s+', ' ', 'g')), '{T.VENUE_EDGES}', '', 'g') AS name FROM t),
        b AS (SELECT p_partkey, name, trim({bare}) AS bare FROM n)
        SELECT p_partkey, CASE WHEN name = '' THEN '' {known} WHEN regexp_extract(bare, '{T.VENUE_ACRONYM}', 1) <> '' THEN regexp_extract(bare, '{T.VENUE_ACRONYM}', 1) ELSE bare END AS venue FROM b"""


@query(_venue_sql())
def venue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-03, FUN-04: short names of venues."""
    return table(spark, sf_dir, "part").select("p_partkey", T.venue(F.expr(_VENUE)).alias("venue"))


@query(r"""WITH t AS (SELECT doc_id, text, (length(text) // 2)::int AS a, least(length(text), length(text) // 2 + 5)::int AS e FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, regexp_replace(left(text, a), '(?s)^.*(?:[。！？]\s*|[.!?]\s+)', '') AS l, substr(text, a + 1, e - a) AS m, substr(text, e + 1) AS r FROM t),
    x AS (SELECT doc_id, l || m || CASE WHEN regexp_matches(r, '(?s)^.*?(?:[。！？]|[.!?](?:\s|\z))') THEN regexp_extract(r, '(?s)^.*?(?:[。！？]|[.!?](?:\s|\z))') ELSE r END AS s FROM p)
    SELECT doc_id, left(regexp_replace(s, '^\s+|\s+$', '', 'g'), 10000) AS sentence FROM x""")
def sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-12: the sentence around the middle of each text."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    a = F.floor(F.length("text") / 2).cast("int")
    return docs.select("doc_id", T.sentence_around(F.col("text"), a, F.least(F.length("text"), a + 5)).alias("sentence"))


_ROLE = "CASE p_partkey % 7 WHEN 0 THEN 'Abstract' WHEN 1 THEN concat('ABSTRACT: ', p_name) WHEN 2 THEN concat('摘 要：', p_name) WHEN 3 THEN concat('Key words - ', p_name) WHEN 4 THEN concat('关键词: ', p_name) WHEN 5 THEN 'Abstract —' ELSE concat('abstract ', p_name) END"


@query(r"""WITH t AS (SELECT p_partkey, trim(""" + _ROLE + r""") AS t FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)^(?:abstract|摘\s*要)\s*(?:[:：.—-])?$') THEN 'abstract-title' WHEN regexp_matches(t, '(?i)^(?:abstract|摘\s*要)\s*[:：.—-]\s*\S') THEN 'abstract-body'
        WHEN regexp_matches(t, '(?i)^(?:index\s+terms?|key\s*words?|keywords?|关\s*键\s*词)\s*[:：.—-]\s*\S') THEN 'keywords' ELSE '' END AS role FROM t""")
def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-15: abstracts and key words, in English and Chinese."""
    return table(spark, sf_dir, "part").select("p_partkey", T.section_role(F.expr(_ROLE)).alias("role"))


_TEX = r"concat('$$ \\left( ', p_name, ' \\right)_{', p_size, '} \\quad = \\; x \\label{eq:', p_partkey, '} \\tag*{', p_size, '} $$')"


@query(r"""WITH t AS (SELECT p_partkey, """ + _TEX.replace("\\\\", "\\") + r""" AS t FROM part), a AS (SELECT p_partkey, regexp_replace(t, '^\s*(?:\$\$|\$|\\\[|\\\()|(?:\$\$|\$|\\\]|\\\))\s*$', '', 'g') AS t FROM t),
    b AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '\\(?:label|tag\*?)\{[^{}]*\}', '', 'g'), '\\(?:,|;|!|:|quad\b|qquad\b)', ' ', 'g') AS t FROM a),
    c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '\\(left|right)\b', '', 'g'), '\s+', ' ', 'g')) AS tex FROM b) SELECT p_partkey, tex, regexp_replace(tex, '[\s{}]+', '', 'g') AS signature FROM c""")
def tex_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-18: TeX without what only concerns layout, and signatures."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEX).alias("t"))
    return t.select("p_partkey", markup.tex_clean(F.col("t")).alias("tex"), markup.tex_signature(F.col("t")).alias("signature"))


_ANSWER = """CASE p_partkey % 6 WHEN 0 THEN concat('<think>so ', p_size, '</think> {"n": ', p_size, '}') WHEN 1 THEN concat('```json', chr(10), '[', p_size, ', 2]', chr(10), '```') WHEN 2 THEN concat('Here it is: {"a": [', p_size, ']} as asked')
    WHEN 3 THEN concat('a __BOLD_START_', p_size, '__b__BOLD_END_', p_size, '__ c __BOLD_START_99__d') WHEN 4 THEN concat('x __COLOR_END_', p_size, '__ {broken') ELSE p_name END"""


@query(rf"""WITH t AS (SELECT p_partkey, regexp_replace({_ANSWER}, '(?s)^\s*<think>.*?</think>\s*', '') AS t FROM part),
    m AS (SELECT p_partkey, t, regexp_extract_all(t, '{T.EMPHASIS}') AS k, regexp_split_to_array(t, '{T.EMPHASIS}') AS g FROM t),
    q AS (SELECT *, list_intersect(list_transform(list_filter(k, lambda x: contains(x, '_START_')), lambda x: regexp_extract(x, '(\d+)__$', 1)), list_transform(list_filter(k, lambda x: contains(x, '_END_')), lambda x: regexp_extract(x, '(\d+)__$', 1))) AS pr FROM m),
    f AS (SELECT *, CASE WHEN regexp_matches(trim(t), '(?is)^```(?:json)?\s*(.*?)\s*```$') THEN regexp_extract(trim(t), '(?is)^```(?:json)?\s*(.*?)\s*```$', 1) ELSE trim(t) END AS i FROM q)
    SELECT p_partkey, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(k) AND list_contains(pr, regexp_extract(k[i], '(\d+)__$', 1)) THEN k[i] ELSE '' END), '') AS answer,
        CASE WHEN json_valid(i) THEN i WHEN json_valid(regexp_extract(i, '(?s)[{{\[].*[}}\]]')) THEN regexp_extract(i, '(?s)[{{\[].*[}}\]]') END AS json FROM f""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-27: answers without reasoning and unpaired emphasis, and the JSON in them."""
    t = table(spark, sf_dir, "part").select("p_partkey", T.without_thinking(F.expr(_ANSWER)).alias("t"))
    return t.select("p_partkey", T.paired_emphasis(F.col("t")).alias("answer"), T.json_body(F.col("t")).alias("json"))


_CODE = "CASE p_partkey % 9 WHEN 0 THEN 'English' WHEN 1 THEN ' zh_CN ' WHEN 2 THEN '简体中文' WHEN 3 THEN 'pt_BR' WHEN 4 THEN '' WHEN 5 THEN 'not a code' WHEN 6 THEN 'auto' WHEN 7 THEN 'zh-TW' ELSE 'fr' END"


def _code_sql(source: bool) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
    return f"(SELECT CASE WHEN {str(source)} AND c = 'auto' THEN c WHEN regexp_matches(c, '^[a-z]{{2,3}}(?:-[a-z0-9]{{2,8}})?$') THEN c END FROM (SELECT CASE l {known} ELSE l END AS c FROM (SELECT CASE WHEN x = '' THEN '{'auto' if source else 'zh'}' ELSE x END AS l)))"


@query(f"WITH t AS (SELECT p_partkey, replace(lower(trim({_CODE})), '_', '-') AS x FROM part) SELECT p_partkey, {_code_sql(False)} AS target, {_code_sql(True)} AS source FROM t")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-28: codes of target and source languages."""
    return table(spark, sf_dir, "part").select("p_partkey", T.language_code(F.expr(_CODE)).alias("target"), T.language_code(F.expr(_CODE), source=True).alias("source"))


@query("""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events) SELECT user_id, min(stamp) AS first, max(stamp) AS last, count(DISTINCT stamp) AS n FROM e GROUP BY user_id""")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-38: times as text, compared as such."""
    e = table(spark, sf_dir, "events").select("user_id", T.utc_stamp(F.col("ts")).alias("stamp"))
    return e.groupBy("user_id").agg(F.min("stamp").alias("first"), F.max("stamp").alias("last"), F.count_distinct("stamp").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, (l_partkey % 400)::int AS a, (l_partkey % 400 + l_quantity)::int AS e, CASE l_returnflag WHEN 'N' THEN 'bold' WHEN 'A' THEN 'color' ELSE 'italic' END AS style, CASE l_linestatus WHEN 'O' THEN 'red' ELSE 'beige' END AS tone FROM lineitem)
    SELECT l_orderkey, greatest(a, 100) - 100 AS a, least(e, 250) - 100 AS e, style, CASE WHEN style = 'color' THEN tone END AS tone, count(*) AS n FROM s WHERE (style = 'bold' OR style = 'color' AND tone IN ('red', 'blue')) AND greatest(a, 100) < least(e, 250) GROUP BY ALL""")
def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-48: styled spans of a text, cut to a slice of it."""
    a = (F.col("l_partkey") % 400).cast("int")
    span = F.struct(a.alias("start"), (a + F.col("l_quantity")).cast("int").alias("end"), F.expr("CASE l_returnflag WHEN 'N' THEN 'bold' WHEN 'A' THEN 'color' ELSE 'italic' END").alias("style"), F.expr("CASE l_linestatus WHEN 'O' THEN 'red' ELSE 'beige' END").alias("tone"))
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    cut = spans.select("l_orderkey", F.explode(reader.sliced_spans(F.col("spans"), F.lit(100), F.lit(250), ["red", "blue"])).alias("s"))
    return cut.groupBy("l_orderkey", F.col("s.start").alias("a"), F.col("s.end").alias("e"), "s.style", "s.tone").agg(F.count("*").alias("n"))


_PAGE = "concat('x \\\\[ a_', p_size, ' = b \\\\] and \\\\(', p_name, '\\\\) or \\\\[  \\\\] then', chr(10), '$$', chr(10), 'c = ', p_size, chr(10), '$$', chr(10))"


@query(rf"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(replace({_PAGE.replace(chr(92) * 2, chr(92))}, '\[', ''), '\]', '') ELSE {_PAGE.replace(chr(92) * 2, chr(92))} END AS t FROM part),
    d AS (SELECT p_partkey, t, regexp_extract_all(t, '(?s)\\\[(.*?)\\\]', 1) AS one, regexp_extract_all(t, '(?ms)^\s*\$\$\s*\n(.*?)^\s*\$\$\s*$', 1) AS two, regexp_extract_all(t, '(?s)\\\((.*?)\\\)', 1) AS inl FROM t)
    SELECT p_partkey, array_to_string(list_filter(list_transform(CASE WHEN len(one) > 0 THEN one ELSE two END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS display, array_to_string(list_filter(list_transform(inl, lambda x: trim(x)), lambda x: x <> ''), '|') AS inline FROM d""")
def formula_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: display and inline formulas of a page's text."""
    page = F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN replace(replace({_PAGE}, '\\\\[', ''), '\\\\]', '') ELSE {_PAGE} END")
    t = table(spark, sf_dir, "part").select("p_partkey", page.alias("t"))
    f = t.select("p_partkey", markup.formula_candidates(F.col("t")).alias("f"))
    return f.select("p_partkey", F.array_join("f.display", "|").alias("display"), F.array_join("f.inline", "|").alias("inline"))


@query("""WITH e AS (SELECT o_custkey AS job, (l_linenumber % 3)::int AS page, CASE WHEN l_partkey % 11 > 0 THEN 'b' || l_partkey || '-' || l_suppkey END AS id, CASE WHEN l_quantity > 5 THEN '' ELSE l_returnflag END AS t, CASE WHEN l_quantity > 20 THEN '<td>' || l_linestatus || '</td> <td>x</td>' END AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    c AS (SELECT job, page, id, array_to_string(list_filter([t, trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))], lambda x: x <> ''), chr(10)) AS c FROM e WHERE page >= 1),
    g AS (SELECT job, id, count(*) AS n, max(page) AS page, max(c) AS c FROM c GROUP BY ALL), k AS (SELECT *, n = 1 AND id IS NOT NULL AND c <> '' AS good FROM g)
    SELECT job, sum(good::int)::bigint AS n_blocks, sum(n - good::int)::bigint AS n_unreadable, md5(coalesce(string_agg(CASE WHEN good THEN id || ':' || page || ':' || c END, ',' ORDER BY id), '')) AS digest FROM k GROUP BY job""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-19: blocks that can be cited: an id of their own, and content."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job"))
    e = li.join(orders, "l_orderkey").select(
        "job", (F.col("l_linenumber") % 3).cast("int").alias("page"), F.when(F.col("l_partkey") % 11 > 0, F.concat(F.lit("b"), "l_partkey", F.lit("-"), "l_suppkey")).alias("block_id"),
        F.when(F.col("l_quantity") > 5, "").otherwise(F.col("l_returnflag")).alias("text"), F.when(F.col("l_quantity") > 20, F.concat(F.lit("<td>"), "l_linestatus", F.lit("</td> <td>x</td>"))).alias("table_html"), F.lit(None).cast("string").alias("tex"),
    )
    blocks, totals = reader.evidence(e)
    digest = blocks.groupBy("job").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", F.concat_ws(":", "block_id", "page", "content").alias("t")))), lambda x: x["t"]), ",")).alias("digest"))
    return totals.join(digest, "job", "left").select("job", "n_blocks", "n_unreadable", F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))


_BOX = (
    "CASE WHEN l_partkey % 2 = 0 THEN 0.1 ELSE 0.55 END AS x0", "CASE WHEN l_partkey % 2 = 0 THEN 0.9 ELSE 0.95 END AS x1", "0.1 + (l_suppkey % 8) * 0.1 AS y0", "0.15 + (l_suppkey % 8) * 0.1 AS y1",
    "CASE l_linenumber % 3 WHEN 0 THEN 'and so on' WHEN 1 THEN 'ends here.' ELSE 'Table 1 of' END AS text",
)


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber AS page, {", ".join(_BOX)} FROM lineitem), u AS (SELECT l_orderkey, page FROM p GROUP BY ALL HAVING count(*) = 1), q AS (SELECT p.* FROM p JOIN u USING (l_orderkey, page))
    SELECT a.l_orderkey, a.page, b.page AS next, a.y1 >= 0.78 AND b.y0 <= 0.20 AND ((a.x1 - a.x0 >= 0.55 AND b.x1 - b.x0 >= 0.55 AND abs(a.x0 - b.x0) <= 0.035)
        OR (a.x1 - a.x0 <= 0.48 AND b.x1 - b.x0 <= 0.48 AND a.x0 >= 0.48 AND b.x1 <= 0.52 AND abs(1 - a.x1 - b.x0) <= 0.04)) AND a.text = 'and so on' AND b.text IN ('and so on', 'ends here.') AS joins
    FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND b.page = a.page + 1""")
def paragraph_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: which paragraphs go on on the next page; figures between them are in the fixtures."""
    p = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber as page", *_BOX)
    alone = p.groupBy("l_orderkey", "page").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    box = F.struct("page", *[F.col(x).cast("double").alias(x) for x in ("x0", "y0", "x1", "y1")], "text")
    own = p.join(alone, ["l_orderkey", "page"]).select("l_orderkey", "page", box.alias("box"))
    nxt = own.select("l_orderkey", (F.col("page") - 1).alias("page"), F.col("page").alias("next"), F.col("box").alias("b"))
    pairs = own.withColumnRenamed("box", "a").join(nxt, ["l_orderkey", "page"]).withColumn("figures", F.array().cast("array<struct<page:bigint,x0:double,y0:double,x1:double,y1:double>>"))
    return reader.paragraphs_join(pairs).select("l_orderkey", "page", "next", "joins")


@query("""WITH s AS (SELECT conv_id, turn, text, ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 3 + (octet_length(encode(text)) - (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))) / 1.5)::bigint AS n, CASE WHEN role = 'assistant' THEN turn END AS r FROM conversations WHERE text IS NOT NULL),
    t AS (SELECT *, 8 + sum(n + 8) OVER (PARTITION BY conv_id) AS total, coalesce(sum(CASE WHEN r IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY r NULLS LAST, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s),
    g AS (SELECT *, r IS NOT NULL AND total - b > 150 AS gone FROM t), z AS (SELECT *, CASE WHEN gone THEN 0 ELSE n END AS m FROM g), o AS (SELECT *, 8 + sum(m + 8) OVER (PARTITION BY conv_id) - 150 AS over FROM z),
    k AS (SELECT conv_id, turn, CASE WHEN gone THEN '' WHEN turn = 0 AND over > 0 THEN left(text, list_max(list_filter(range(0, length(text) + 1), lambda i: ceil((length(left(text, i)) - length(regexp_replace(left(text, i), '[\\x00-\\x7F]', '', 'g'))) / 3 + (octet_length(encode(left(text, i))) - (length(left(text, i)) - length(regexp_replace(left(text, i), '[\\x00-\\x7F]', '', 'g')))) / 1.5) <= greatest(0, m - over)))::int) ELSE text END AS text FROM o),
    l AS (SELECT *, ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 3 + (octet_length(encode(text)) - (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))) / 1.5)::bigint AS n FROM k WHERE text <> '')
    SELECT conv_id, turn, text, 8 + sum(n + 8) OVER (PARTITION BY conv_id) <= 150 AS fits FROM l""")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-25: conversations fitted to 150 tokens: answers give way first, oldest first, then the opening question is cut."""
    m = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", F.col("turn").alias("seq"), "text", F.when(F.col("role") == "assistant", F.col("turn")).alias("removable"), F.when(F.col("turn") == 0, F.col("turn")).alias("truncatable"))
    return reader.fitted(m, "conv_id", 150).withColumnRenamed("seq", "turn")


@query()
def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FUN-23: places of table cells with row and column spans; tests hold it against plain Python."""
    cell = F.struct(F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("row"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") % 2 + 1).cast("int").alias("down"), (F.col("l_partkey") % 2 + 1).cast("int").alias("across"))
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return tables.select("l_orderkey", F.explode(vectors.placed_cells("cells")).alias("c")).select("l_orderkey", "c.*")


@query("""SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders""")
def catalogue_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: the newest first, ties by id, for each owner."""
    from pyspark.sql import Window

    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.row_number().over(newest).alias("place").cast("bigint")).orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_name, p_partkey) AS place FROM part""")
def accessibility_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-10: papers first, then labels; the order of a collation is a parameter of the session, here it is binary."""
    from pyspark.sql import Window

    order = Window.partitionBy("p_brand").orderBy(F.when(F.col("p_size") > 25, 0).otherwise(1), "p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(order).cast("bigint").alias("place"))


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS idx, (l_suppkey % 40)::int AS x0, (CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN l_suppkey % 40 + 10 ELSE 400 END)::int AS x1, 0 AS y0, (CASE WHEN l_linenumber = 1 THEN 500 ELSE 20 END)::int AS y1,
        CASE WHEN l_linenumber = 1 THEN '1 2 3' ELSE '  12 words of ' || l_returnflag || chr(10) || '13 more' END AS text FROM lineitem),
    m AS (SELECT *, x1 - x0 < 30 AND y1 - y0 > 300 AND regexp_matches(text, '^[\\d\\s]+$') AS g FROM b), e AS (SELECT *, max(CASE WHEN g THEN x1 END) OVER (PARTITION BY page) AS edge FROM m)
    SELECT page, idx, CASE WHEN edge IS NOT NULL AND x0 <= edge + 20 THEN regexp_replace(text, '(?m)^\\s*\\d{1,4}\\s+', '', 'g') ELSE text END AS text, count(*) AS n FROM e WHERE NOT g GROUP BY ALL""")
def gutter_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: line numbers at the left of pages taken out of the text beside them."""
    x0 = (F.col("l_suppkey") % 40).cast("int")
    first = F.col("l_linenumber") == 1
    b = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), x0.alias("x0"), F.when(first & (F.col("l_orderkey") % 3 == 0), x0 + 10).otherwise(400).alias("x1"), F.lit(0).alias("y0"), F.when(first, 500).otherwise(20).alias("y1"),
        F.when(first, "1 2 3").otherwise(F.concat(F.lit("  12 words of "), "l_returnflag", F.lit("\n13 more"))).alias("text"),
    )
    return markup.without_gutter(b).groupBy("page", "idx", "text").agg(F.count("*").alias("n"))
