"""Layout sidecars made of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import sidecars
from quire.sources.tables import table

from .book import query

#: Ceilings that some of the messages pass.
LOW = sidecars.Ceilings(pages=9, elements=60, nodes=400, chars=4000)


def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar for each message: its lines are pages, their sentences are elements."""

    def element(sentence):
        part = F.struct(F.lit("text").alias("type"), sentence.alias("content"))
        return F.struct(F.when(F.length(sentence) < 20, "title").otherwise("paragraph").alias("type"), F.struct(F.array(part).alias("parts")).alias("content"))

    pages = F.transform(F.split("text", "\n"), lambda line: F.transform(F.filter(F.split(line, r"\. "), lambda s: s != ""), element))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(pages).alias("json"))


_JSON = """m AS (SELECT conv_id, turn, to_json(list_transform(string_split(text, chr(10)), lambda l: list_transform(list_filter(string_split(l, '. '), lambda s: s <> ''),
    lambda s: {'type': CASE WHEN length(s) < 20 THEN 'title' ELSE 'paragraph' END, 'content': {'parts': [{'type': 'text', 'content': s}]}}))) AS j FROM conversations),
t AS (SELECT conv_id, turn, t.type AS kind, t.atom, t.fullkey AS place, len(regexp_extract_all(t.fullkey, '[.\\[]')) AS depth, CASE WHEN t.fullkey NOT LIKE '%]' AND t.key IS NOT NULL THEN length(t.key) ELSE 0 END AS named FROM m, json_tree(m.j) t),
n AS (SELECT conv_id, turn, count(*) AS nodes, max(depth) AS depth, sum(named + CASE WHEN kind = 'VARCHAR' THEN length(json_extract_string(atom, '$')) ELSE 0 END)::bigint AS chars, count(*) FILTER (depth = 1)::int AS pages, count(*) FILTER (depth = 2) AS elements FROM t GROUP BY conv_id, turn),
s AS (SELECT *, CASE WHEN pages > 9 THEN 'too many pages' WHEN elements > 60 THEN 'too many elements' WHEN nodes > 400 THEN 'too many nodes' WHEN chars > 4000 THEN 'too many chars' ELSE 'ok' END AS status FROM n)""".replace("\\\\", "\\")


@query(f"WITH {_JSON} SELECT conv_id, turn, status, pages, elements FROM s")
def sidecar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: sidecars of all messages, each with what it holds and the ceiling that it passes."""
    return sidecars.scan(sidecar_rows(spark, sf_dir), ["conv_id", "turn"], ceilings=LOW)[0].select("conv_id", "turn", "status", "pages", "elements")


@query(rf"""WITH {_JSON}, e AS (SELECT conv_id, turn, regexp_extract(place, '^\$\[(\d+)\]\[(\d+)\]', 1)::int AS page, regexp_extract(place, '^\$\[(\d+)\]\[(\d+)\]', 2)::int AS element, t.depth, place, json_extract_string(atom, '$') AS x FROM t JOIN s USING (conv_id, turn) WHERE status = 'ok' AND kind = 'VARCHAR')
    SELECT conv_id, turn, page, element, max(x) FILTER (depth = 3) AS type, max(x) FILTER (place LIKE '%.content') AS text FROM e GROUP BY conv_id, turn, page, element""")
def sidecar_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, FUN-45: elements of the sidecars that are within the ceilings, with their texts."""
    return sidecars.scan(sidecar_rows(spark, sf_dir), ["conv_id", "turn"], ceilings=LOW)[1]
