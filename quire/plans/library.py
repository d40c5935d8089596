"""Search, views, folders and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import library, search
from quire.operators.search_index import SearchIndex
from quire.session import version
from quire.sources.tables import BLOCKS_SQL, ITEMS_SQL, annotations, blocks, items, table

from .book import query


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All searchable rows: documents as content, their first lines as metadata, turns as annotations."""
    docs = items(spark, sf_dir)
    content = docs.select("job_id", F.lit("content").alias("kind"), F.concat(F.lit("c"), "job_id").alias("source_id"), F.col("abstract").alias("text"))
    titles = docs.select("job_id", F.lit("metadata").alias("kind"), F.concat(F.lit("m"), "job_id").alias("source_id"), F.col("title").alias("text"))
    quotes = annotations(spark, sf_dir).select("job_id", F.lit("annotations").alias("kind"), F.concat_ws("-", F.lit("a"), "job_id", "seq").alias("source_id"), F.col("quote").alias("text"))
    return content.unionByName(titles).unionByName(quotes)


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The kept index of these tables, brought up to their files: it is built when it is first asked for, and what has changed since is added."""
    at = (spark.sparkContext.applicationId, sf_dir)
    own = _INDEXES.setdefault(at, SearchIndex(spark))
    own.refresh(sources(spark, sf_dir), version(spark, *[f"{sf_dir}/{name}.parquet" for name in ("documents", "labels", "conversations")]))
    return own


SOURCES_SQL = f"""{ITEMS_SQL}, sources AS (
    SELECT job_id, 'content' AS kind, 'c' || job_id AS source_id, abstract AS text FROM items UNION ALL SELECT job_id, 'metadata', 'm' || job_id, title FROM items
    UNION ALL SELECT conv_id, 'annotations', 'a-' || conv_id || '-' || turn, text FROM conversations),
tok AS (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM sources), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok)"""


def _hits_sql(*phrases: list[str], base: str | None = None) -> str:
    def count(p: list[str]) -> str:
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {' AND '.join(f'''t[i + {k}] = '{w}' ''' for k, w in enumerate(p))}))"

    tf = ", ".join(f"{count(p)} AS tf{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases)))
    score = " + ".join(
        f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / mean))" for i in range(len(phrases))
    )
    where = " AND ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"""{base or 'WITH ' + SOURCES_SQL}, c AS (SELECT *, {tf} FROM tok), d AS (SELECT {df} FROM c),
    hits AS (SELECT job_id, kind, source_id, text, -({score}) AS score FROM c, d, st WHERE {where})"""


def _page_sql(wanted: str, extra: str = "", limit: int = 30, offset: int = 0) -> str:
    return f"""SELECT job_id, kind, source_id, round(score, 6) AS score, substr(text, greatest(1, strpos(lower(text), '{wanted}') - 100), 500) AS snippet, (SELECT count(*) FROM hits {extra}) AS total
    FROM hits {extra} ORDER BY hits.score, job_id, source_id LIMIT {limit} OFFSET {offset}"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources before a folder came in, and after it did, items went to the trash, and those of importance were marked as read."""
    own = items(spark, sf_dir).select("job_id", "folder_id", "deleted", F.coalesce("importance", F.lit(0)).alias("importance"))
    rows = sources(spark, sf_dir).join(own, "job_id")
    read = F.when(F.col("importance") == 1, F.concat("text", F.lit(" sur lecture"))).otherwise(F.col("text"))
    columns = ["job_id", "kind", "source_id", "text"]
    return rows.filter("folder_id <> 'src3'").select(*columns), rows.filter("not deleted").withColumn("text", read).select(*columns)


_INDEXED: dict[tuple[str, str, str], tuple[SearchIndex, dict[str, int]]] = {}


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[SearchIndex, dict[str, int]]:
    """The index of the second state, refreshed from the first, and what the refresh did; made once for each state of the files."""
    at = (spark.sparkContext.applicationId, sf_dir, version(spark, *[f"{sf_dir}/{name}.parquet" for name in ("documents", "labels", "conversations")]))
    if at not in _INDEXED:
        before, after = _states(spark, sf_dir)
        own = SearchIndex(spark)
        own.refresh(before)
        _INDEXED[at] = own, own.refresh(after)
    return _INDEXED[at]


_TOKENS_SQL = SOURCES_SQL[SOURCES_SQL.index("tok AS") :]
_STATES_SQL = f"""WITH {SOURCES_SQL.removesuffix(_TOKENS_SQL).rstrip()} rows AS (SELECT s.*, folder_id, deleted, coalesce(importance, 0) AS importance FROM sources s JOIN items USING (job_id)),
before AS (SELECT job_id, kind, source_id, text FROM rows WHERE folder_id <> 'src3'), after AS (SELECT job_id, kind, source_id, CASE WHEN importance = 1 THEN text || ' sur lecture' ELSE text END AS text FROM rows WHERE NOT deleted)"""


@query(f"""{_STATES_SQL}, b AS (SELECT CASE WHEN x.job_id IS NULL THEN 'insert' WHEN y.job_id IS NULL THEN 'delete' WHEN x.text <> y.text THEN 'update' ELSE 'keep' END AS change FROM before x FULL JOIN after y USING (job_id, kind, source_id))
    SELECT c.change, count(b.change) AS n FROM (VALUES ('insert'), ('update'), ('delete'), ('keep')) c(change) LEFT JOIN b ON b.change = c.change GROUP BY c.change""")
def search_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, STR-01, STR-03: what a refresh of the kept index inserts, updates, deletes and keeps when a folder comes in, items go to the trash and texts change."""
    return spark.createDataFrame(sorted(_refreshed(spark, sf_dir)[1].items()), "change string, n bigint")


_AFTER_SQL = f"{_STATES_SQL}, {_TOKENS_SQL.replace('FROM sources', 'FROM after')}"


@query(_hits_sql(["sur", "lecture"], base=_AFTER_SQL) + _page_sql("sur-lecture", limit=100))
def search_after_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, FLT-04, STR-01: a phrase that only the changed texts hold, searched in the refreshed index of several segments."""
    return _refreshed(spark, sf_dir)[0].search("sur-lecture", limit=100)


@query(_hits_sql(["sur"]) + _page_sql("sur", limit=100))
def search_bm25_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, AGG-02, AGG-04, SRT-01, SET-04, FUN-11, SNK-02: one term over all sources."""
    return index(spark, sf_dir).search("sur", limit=100)


@query(_hits_sql(["the"], ["and"]) + _page_sql("the and", "WHERE kind IN ('content', 'metadata')", 50, 10))
def search_phrase_and_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FLT-05, SRT-02: two phrases, two kinds, a page further on."""
    return index(spark, sf_dir).search("the and", limit=50, offset=10, kinds=["content", "metadata"])


@query(_hits_sql(["of", "the"]) + _page_sql("of-the", "WHERE job_id IN (SELECT job_id FROM items WHERE folder_id = 'src3')", 30))
def search_phrase_in_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FLT-06: a phrase of two tokens, within a folder."""
    return index(spark, sf_dir).search("of-the", folder_items=items(spark, sf_dir).filter("folder_id = 'src3'"))


@query(f"WITH {SOURCES_SQL} SELECT kind, count(*) AS n FROM sources WHERE kind IN ('annotations', 'content') GROUP BY kind")
def acl_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: sources that the granted scopes let through."""
    kinds = search.allowed_kinds(["read:content", "read:annotations"], None)
    return sources(spark, sf_dir).filter(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, pos, text, block_id FROM blocks")
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, FUN-43: blocks of documents with stable ids."""
    return blocks(spark, sf_dir)


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'render-' || quality ELSE 'base' END AS generation, coalesce(toxic, 0)::int AS flag
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1""")
def active_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, DOC-17: the active version of each document, or else the base."""
    docs, renders = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1")
    return docs.join(renders, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("render-"), "quality"), F.lit("base")).alias("generation"), F.coalesce("toxic", F.lit(0)).alias("flag"))


@query("""SELECT o_custkey, o_orderkey, status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY prio, o_orderkey) AS rn FROM (
    SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'failed' END AS status, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS prio FROM orders)) WHERE rn = 1""")
def job_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: status of each job by a decision table; for each hash the job of best status. No window: one aggregate."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("failed")
    prio = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct(prio.alias("p"), F.col("o_orderkey").alias("k"), status.alias("s"))).alias("b"))
    return best.select("o_custkey", F.col("b.k").alias("o_orderkey"), F.col("b.s").alias("status"))


@query("SELECT text AS term, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def vocabulary_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: keys that aren't unique."""
    return table(spark, sf_dir, "documents").groupBy(F.col("text").alias("term")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""SELECT event_type AS cache_key, event_id, (props::json->>'k')::bigint AS k FROM events WHERE props IS NOT NULL AND event_type <> 'error'""")
def translation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: entries from JSON text; those without a key are dropped."""
    rows = table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("error")).alias("cache_key"), "event_id", F.from_json("props", "k bigint").alias("p"))
    return rows.filter("cache_key is not null and p is not null").select("cache_key", "event_id", "p.k")


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT folder_id, count(*) FILTER (NOT deleted) AS n FROM items GROUP BY folder_id),
    f AS (SELECT folder_id, n FROM x UNION ALL SELECT 'src-empty', 0)
    SELECT folder_id, n::bigint AS n FROM f UNION ALL SELECT 'system-all', count(*) FILTER (NOT deleted) FROM items
    UNION ALL SELECT 'system-unfiled', 0 UNION ALL SELECT 'system-trash', count(*) FILTER (deleted) FROM items""")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: live members of each folder, empty folders included, and the system buckets."""
    rows = items(spark, sf_dir).select("job_id", F.array("folder_id").alias("folder_ids"), "deleted")
    folders = rows.select(F.explode("folder_ids").alias("folder_id")).distinct().union(spark.sql("SELECT 'src-empty'"))
    return library.folder_counts(rows, folders)


_TREE = """SELECT 'r' || r_regionkey AS folder_id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    out = region.select(F.concat(F.lit("r"), "r_regionkey").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"))
    out = out.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return out.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


@query(f"""WITH RECURSIVE f AS ({_TREE}), u AS (SELECT folder_id, parent_id AS ancestor, 1 AS distance FROM f WHERE parent_id IS NOT NULL
    UNION ALL SELECT u.folder_id, f.parent_id, distance + 1 FROM u JOIN f ON u.ancestor = f.folder_id WHERE f.parent_id IS NOT NULL) SELECT * FROM u""")
def folder_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-04, JOIN-14: ancestors of every folder."""
    return library.ancestors(_folders(spark, sf_dir))


@query(f"""WITH f AS ({_TREE}) SELECT f.folder_id, CASE WHEN r.folder_id IS NULL THEN f.parent_id ELSE r.parent_id END AS parent_id FROM f
    LEFT JOIN (SELECT * FROM f WHERE folder_id LIKE 'n%') r ON f.parent_id = r.folder_id WHERE f.folder_id NOT LIKE 'n%'""")
def folder_reparent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-04: children of removed folders move up."""
    return library.reparent(_folders(spark, sf_dir), F.col("folder_id").startswith("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey")
def view_filtered_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: a saved view with equals and gte filters."""
    filters = [{"field": "o_orderstatus", "operator": "equals", "value": "F"}, {"field": "o_totalprice", "operator": "gte", "value": 100000}]
    return library.view(table(spark, sf_dir, "orders"), filters, "o_totalprice", "desc", "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) AS rn FROM part) WHERE rn > 24 AND rn <= 36")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03: the third page of twelve."""
    return library.page_of(table(spark, sf_dir, "part"), [F.col("p_size"), F.col("p_partkey")], 3).select("p_partkey", "p_name")


@query(f"WITH {ITEMS_SQL} SELECT job_id, title, importance FROM items WHERE NOT deleted AND job_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-02, JOIN-03: columns of live items that no tombstone names."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("job_id"))
    return library.live(items(spark, sf_dir), gone).select("job_id", "title", "importance")


@query("""SELECT c.c_custkey AS job_id, c_name, count(o_orderkey)::bigint AS n_jobs, max(o_orderdate) AS latest FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY ALL""")
def library_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01, AGG-19: every library item with its jobs; items without a job stay. Jobs are summed before the join."""
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    both = table(spark, sf_dir, "customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select(F.col("c_custkey").alias("job_id"), "c_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_jobs"), "latest")


@query("""SELECT p_partkey, p_name, tags FROM (SELECT *, [lower(p_brand), p_type] AS tags FROM part)
    WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'a') AND p_size < 25 AND list_contains([lower(p_brand), p_type], lower(p_brand))""")
def vocabulary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08, FUN-44: entries by text and status."""
    part = table(spark, sf_dir, "part")
    entries = part.select("p_partkey", "p_name", F.col("p_name").alias("term"), F.col("p_type").alias("meaning"), F.col("p_brand").alias("note"), F.array_distinct(F.array(F.lower("p_brand"), "p_type")).alias("tags"), F.when(F.col("p_size") < 25, "learning").otherwise("mastered").alias("status"))
    return library.vocabulary_filter(entries, " A ", "learning", "").select("p_partkey", "p_name", "tags")


@query("""SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, list_sort(list_distinct(list(event_type) FILTER (event_type <> 'error'))) AS allowed,
    len(list_intersect(list_distinct(list(event_type)), ['click', 'view']))::int AS overlap, bool_and(event_type IN ('click', 'view', 'signup', 'purchase', 'error')) AS granted FROM events GROUP BY user_id""")
def scope_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-02, SET-03, SET-05: union, difference, intersection size and subset test of scopes."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    known = F.array(*[F.lit(x) for x in ("click", "view", "signup", "purchase", "error")])
    return per.select(
        "user_id", "kinds", F.array_except("kinds", F.array(F.lit("error"))).alias("allowed"), F.size(F.array_intersect("kinds", F.array(F.lit("click"), F.lit("view")))).alias("overlap"),
        (F.size(F.array_except("kinds", known)) == 0).alias("granted"),
    )


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN true WHEN role = 'user' THEN false ELSE turn = 0 END AS ai FROM conversations""")
def annotation_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: who owns an annotation; the old form is inferred."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(role == "assistant", True).when(role == "user", False).otherwise(F.col("turn") == 0).alias("ai"))


@query(f"WITH {BLOCKS_SQL} SELECT block_id, left(text, 80) AS text FROM blocks WHERE pos = 0 OR (length(text) < 280 AND regexp_matches(lower(text), '@|license|example'))")
def metadata_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: blocks that belong to the metadata of a document."""
    own = (F.col("pos") == 0) | ((F.length("text") < 280) & F.lower("text").rlike("@|license|example"))
    return blocks(spark, sf_dir).filter(own).select("block_id", F.substring("text", 1, 80).alias("text"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
    s AS (SELECT doc_id, w, len(list_filter(w, lambda x: length(x) <= 2)) AS short, len(list_filter(w, lambda x: length(x) = 1)) AS single, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) <= 2 THEN 's' ELSE 'l' END), '') AS m FROM w)
    SELECT doc_id, len(w) >= 24 AND short >= 0.55 * len(w) AND single >= 0.25 * len(w) AND contains(m, 'ssss') AS fragmented FROM s""")
def fragmented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: texts that are broken into pieces."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fragmented(F.col("text")).alias("fragmented"))


@query(r"""SELECT u.conv_id, u.turn, regexp_matches(lower(a.text), '^\s*(sure|certainly|of course|here is)') AS chatty, len(list_filter(list_distinct(regexp_extract_all(u.text, '\d+')), lambda x: NOT list_contains(regexp_extract_all(a.text, '\d+'), x))) > 0 AS lost,
    NOT regexp_matches(a.text, '[.!?。]\s*$') AS cut FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15: answers that are chatty, lose numbers or end in mid-sentence."""
    turns = table(spark, sf_dir, "conversations")
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = turns.filter("role = 'user'").select("conv_id", "turn", "text").join(a, ["conv_id", "turn"])
    numbers = F.array_except(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all("answer", F.lit(r"\d+"), F.lit(0)))
    return both.select("conv_id", "turn", F.lower("answer").rlike(r"^\s*(sure|certainly|of course|here is)").alias("chatty"), (F.size(numbers) > 0).alias("lost"), (~F.col("answer").rlike(r"[.!?。]\s*$")).alias("cut"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O')")
def stale_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, JOIN-03: entries that are kept when those of some owners are purged."""
    gone = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(gone, "l_orderkey", "left_anti")


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - 2 AS before FROM blocks)
    SELECT doc_id, left(string_agg(text, chr(10) || chr(10) ORDER BY pos), 1200) AS context FROM b WHERE before < 1200 GROUP BY doc_id""")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09: blocks in order up to a budget of characters."""
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("pos")) - F.length("text") - 2
    kept = blocks(spark, sf_dir).withColumn("before", before).filter("before < 1200")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return kept.groupBy("doc_id").agg(F.substring(text, 1, 1200).alias("context"))
