"""Providers' answers, the retrieval ladder, and updates of the library, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import bibliography as bib
from quire.operators import updates
from quire.sources.tables import table

from .book import query

_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'crossref' WHEN 1 THEN 'doi' WHEN 2 THEN 'datacite' WHEN 3 THEN 'pubmed' ELSE 'arxiv' END"
_YEAR = "(1990 + p_size % 30)"
_PAYLOAD = f"""CASE p_partkey % 5 WHEN 0 THEN concat('{{"message":{{"title":["<i>', p_name, '</i>"],"DOI":"10.1000/P', p_partkey, '","container-title":["', p_brand, '"],"author":[{{"given":"A","family":"', p_type, '"}},{{"family":"Solo"}}],"issued":{{"date-parts":[[', {_YEAR}, ',1]]}}}}}}')
    WHEN 1 THEN concat('{{"title":"', p_name, '","DOI":"10.1000/P', p_partkey, '","container-title":"', p_brand, '","author":[{{"given":"A","family":"', p_type, '"}}],"issued":{{"date-parts":[[', {_YEAR}, ']]}}}}')
    WHEN 2 THEN concat('{{"data":{{"attributes":{{"titles":[{{"title":"', p_name, '"}}],"doi":"10.1000/P', p_partkey, '","publisher":"', p_brand, '","creators":[{{"givenName":"A","familyName":"', p_type, '"}}],"publicationYear":', {_YEAR}, '}}}}}}')
    WHEN 3 THEN concat('{{"title":"', p_name, '.","fulljournalname":"', p_brand, '","pubdate":"', {_YEAR}, ' Jan","authors":[{{"name":"A ', p_type, '"}}],"articleids":[{{"idtype":"pii","value":"x"}},{{"idtype":"doi","value":"10.1000/P', p_partkey, '"}}]}}')
    ELSE concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>', p_name, '</title><published>', {_YEAR}, '-01-02T00:00:00Z</published><author><name>A ', p_type, '</name></author><arxiv:doi>10.1000/P', p_partkey, '</arxiv:doi></entry></feed>') END"""


@query(f"""SELECT p_partkey, {_KIND} AS provider, p_name AS title, '10.1000/p' || p_partkey AS doi, CASE WHEN p_partkey % 5 = 4 THEN 'arXiv' ELSE p_brand END AS venue, CASE WHEN p_partkey % 5 = 0 THEN 'A ' || p_type || '; Solo' ELSE 'A ' || p_type END AS authors, {_YEAR}::int AS year FROM part""")
def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: answers of five providers in one form."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KIND).alias("provider"), F.expr(_PAYLOAD).alias("payload"))
    t = t.select("p_partkey", "provider", bib.provider_fields(F.col("provider"), F.col("payload")).alias("r"))
    return t.select("p_partkey", "provider", "r.title", "r.doi", "r.venue", F.array_join("r.authors", "; ").alias("authors"), "r.year")


_ITEMS = """SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN concat('https://doi.org/10.1/', p_partkey, '.') ELSE '' END AS doi, CASE WHEN p_partkey % 3 = 0 THEN concat('2001.', 10000 + p_partkey) END AS arxiv,
    CASE WHEN p_partkey % 5 = 0 THEN concat('', 70000 + p_partkey) END AS pmid FROM part"""
_DOIS = "SELECT concat('10.1/', p_partkey) AS key, CASE WHEN p_partkey % 8 = 0 THEN 'another work' ELSE upper(p_name) END AS title, concat('10.1/', p_partkey) AS doi FROM part WHERE p_partkey % 16 <> 4"
_ARXIV = "SELECT concat('2001.', 10000 + p_partkey) AS key, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 1 THEN concat('10.1/', p_partkey) END AS doi FROM part"
_PMID = "SELECT concat('', 70000 + p_partkey) AS key, p_name AS title, concat('10.9/', p_partkey) AS doi FROM part WHERE p_partkey % 2 = 1"
_FOUND = "SELECT p_partkey AS id, p_name AS title, concat('10.3/', p_partkey) AS doi, CAST(p_size AS DOUBLE) / 50 AS confidence FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT p_partkey AS id, p_name AS title, concat('10.4/', p_partkey) AS doi, 0.1 AS confidence FROM part WHERE p_partkey % 11 = 0"


@query(rf"""WITH i AS ({_ITEMS}), d AS ({_DOIS}), a AS ({_ARXIV}), p AS ({_PMID}), f AS ({_FOUND}), h AS (SELECT id, arg_max(title, (confidence, doi)) AS title, arg_max(doi, (confidence, doi)) AS doi, max(confidence) AS confidence FROM f GROUP BY id),
    k AS (SELECT *, regexp_replace(regexp_replace(doi, '^https://doi.org/', ''), '[.,;:]+$', '') AS dk FROM i),
    j AS (SELECT k.*, d.title AS dt, d.doi AS dd, d.title IS NOT NULL AND (k.title = '' OR lower(k.title) = lower(d.title)) AS dok, a.title AS a_t, a.doi AS ad, a.title IS NOT NULL AND (k.title = '' OR lower(k.title) = lower(a.title)) AS aok, p.title AS pt, p.doi AS pd, p.title IS NOT NULL AND (k.title = '' OR lower(k.title) = lower(p.title)) AS pok, h.title AS ht, h.doi AS hd, h.confidence AS hc
        FROM k LEFT JOIN d ON dk = d.key LEFT JOIN a ON arxiv = a.key LEFT JOIN p ON pmid = p.key LEFT JOIN h ON h.id = k.id),
    r AS (SELECT *, CASE WHEN dok THEN 'doi' WHEN aok THEN 'arxiv' WHEN pok THEN 'pubmed' END AS rung FROM j), n AS (SELECT r.*, e.title AS nt, e.doi AS nd, e.title IS NOT NULL AND e.key <> dk AND (r.title = '' OR lower(r.title) = lower(e.title)) AS nok FROM r LEFT JOIN d e ON e.key = CASE rung WHEN 'arxiv' THEN ad WHEN 'pubmed' THEN pd END)
    SELECT id, CASE WHEN nok THEN rung || '+doi' WHEN rung IS NOT NULL THEN rung WHEN hc >= 0.92 THEN 'search' END AS provider, CASE WHEN rung IS NOT NULL OR hc >= 0.92 THEN 'complete' WHEN hc IS NOT NULL THEN 'needs-review' WHEN title <> '' OR dk <> '' OR arxiv IS NOT NULL OR pmid IS NOT NULL THEN 'local' ELSE 'failed' END AS status,
        coalesce(CASE WHEN rung = 'doi' THEN dt WHEN nok THEN nt WHEN rung = 'arxiv' THEN a_t WHEN rung = 'pubmed' THEN pt WHEN hc >= 0.92 THEN ht END, title) AS title,
        nullif(coalesce(CASE WHEN rung = 'doi' THEN dd WHEN nok THEN nd WHEN rung = 'arxiv' THEN ad WHEN rung = 'pubmed' THEN pd WHEN hc >= 0.92 THEN hd END, CASE WHEN NOT dok AND dt IS NOT NULL THEN '' ELSE dk END), '') AS doi FROM n""")
def retrieval_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-08: DOI, arXiv, PubMed and search, with what must agree before a record is taken."""
    table(spark, sf_dir, "part").createOrReplaceTempView("ladder_part")
    frames = [spark.sql(x.replace("FROM part", "FROM ladder_part")) for x in (_ITEMS, _DOIS, _ARXIV, _PMID, _FOUND)]
    return bib.ladder(*frames)


_OP = "CASE event_id % 9 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'trash' WHEN 3 THEN 'restore' WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN 'purge' ELSE 'set' END ELSE 'set' END"
_NAME = "CASE WHEN event_id % 9 IN (0, 1) THEN concat('folder', event_id % 4) ELSE concat('p', event_id % 5) END"
_VALUE = "CASE WHEN event_id % 8 > 0 THEN event_type END"


@query(f"""WITH o AS (SELECT user_id AS job, event_id AS seq, {_OP} AS op, {_NAME} AS name, {_VALUE} AS value FROM events), p AS (SELECT job, min(seq) FILTER (op = 'purge') AS gone FROM o GROUP BY job),
    l AS (SELECT o.* FROM o JOIN p USING (job) WHERE gone IS NULL OR seq < gone), k AS (SELECT *, CASE WHEN op IN ('add', 'remove') THEN 'folder' WHEN op = 'set' THEN 'value' ELSE 'state' END AS part FROM l),
    n AS (SELECT job, part, CASE WHEN part = 'state' THEN '' ELSE name END AS name, arg_max(op, seq) AS op, arg_max(row(value), seq)[1] AS value FROM k GROUP BY ALL)
    SELECT p.job, coalesce(string_agg(CASE WHEN part = 'folder' AND op = 'add' AND gone IS NULL THEN name END, ',' ORDER BY name), '') AS folders, coalesce(bool_or(part = 'state' AND op = 'trash' AND gone IS NULL), false) AS deleted, gone IS NOT NULL AS purged,
        coalesce(string_agg(CASE WHEN part = 'value' AND value IS NOT NULL AND name <> 'p3' AND gone IS NULL THEN name || '=' || value END, ',' ORDER BY name), '') AS vals FROM p LEFT JOIN n USING (job) GROUP BY p.job, gone""")
def item_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17: folders, properties, trash, restore and purge, from the operations on each item."""
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(_OP).alias("op"), F.expr(_NAME).alias("name"), F.expr(_VALUE).alias("value"))
    out = updates.updated_items(ops, spark.createDataFrame([("p3",)], "name string"))
    return out.select("job", F.array_join("folders", ",").alias("folders"), "deleted", "purged", F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["name"], v["value"])), ",").alias("vals"))


@query("""WITH d AS (SELECT doc_id AS job, n_chars AS size, doc_id % 100 AS mtime, CASE WHEN toxic = 1 THEN 'FAIL' END AS status, source <> 'src1' AS enabled FROM documents LEFT JOIN labels USING (doc_id))
    SELECT job, size, mtime FROM d WHERE status IS NULL AND coalesce(enabled, true) AND NOT (job % 3 = 0)""")
def snapshots_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: documents whose snapshot isn't the one that was written; invalid and disabled ones have none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("job"), F.col("n_chars").alias("size"), (F.col("doc_id") % 100).alias("mtime"), F.when(F.col("toxic") == 1, "FAIL").alias("status"), (F.col("source") != "src1").alias("enabled"))
    written = docs.select(F.col("doc_id").alias("job"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 100).otherwise(-1).alias("mtime"))
    return updates.due_snapshots(own, written).select("job", "size", "mtime")


@query(r"""WITH f AS (SELECT CASE page_id % 6 WHEN 0 THEN '\x89PNG\x0D\x0A\x1A\x0A'::blob || encode(url) WHEN 1 THEN '\xFF\xD8\xFF'::blob || encode(url) WHEN 2 THEN encode('GIF89a' || url) WHEN 3 THEN encode('RIFF0000WEBP' || url) WHEN 4 THEN encode('GIF87a same') ELSE encode(html) END AS c, CASE page_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'gif' END AS type FROM pages)
    SELECT 'assets/' || sha256(c) || '.' || type AS ref, type, octet_length(c)::bigint AS size, count(*) AS n FROM f WHERE type IS NOT NULL GROUP BY ALL""")
def stored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: images by content, each once; what is no image is refused."""
    kind, url = F.col("page_id") % 6, F.col("url").cast("binary")
    content = F.when(kind == 0, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), url)).when(kind == 1, F.concat(F.lit(b"\xff\xd8\xff"), url)).when(kind == 2, F.concat(F.lit(b"GIF89a"), url)).when(kind == 3, F.concat(F.lit(b"RIFF0000WEBP"), url)).when(kind == 4, F.lit(b"GIF87a same")).otherwise(F.col("html").cast("binary"))
    return updates.stored_assets(table(spark, sf_dir, "pages").select(content.alias("content")))
