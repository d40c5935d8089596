"""Chat formatting by quotation linking: replies are tied to the messages that they quote.

A line's quote level is the number of `>` in front of it. Consecutive lines of one level form a
passage. A passage is normalised (white space collapsed, lower case) and hashed, as a whole and line
by line, and so is what each message says itself. Equal hashes join a quoted passage to its
original: the latest earlier turn of the conversation that says it, or else the first message of
all that does, if that comes before. A message's parent is the original of the longest passage at
its lowest level of quoting; deeper levels link to older messages. Roots and depths follow by
pointer doubling. Messages are returned without quotes and without the line that introduces one,
in reply order: by root, depth and turn.

Null texts stay null and quote nothing; empty lines and empty quoted passages link with nothing;
rows that repeat a key (conv_id, turn) share one parent; a null key never links; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

_MARK = re.compile(r"^(?:[ \t]*>)+[ \t]?")
# Lines that introduce a quotation.
_INTRO = re.compile(r"^(?:On .* wrote|Le .* a écrit|Am .* schrieb.*|El .* escribió) ?:$")


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, content) of each line."""
    out = []
    for line in text.split("\n"):
        found = _MARK.match(line)
        out.append((found[0].count(">"), line[found.end() :]) if found else (0, line))
    return out


def normal(text: str) -> str:
    return " ".join(text.split()).lower()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def parse(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without quotes, and (level, hash, length) of what it says (level 0) and quotes, as passages and as lines."""
    lines = levels(text)
    said: list[str] = []
    units: dict[tuple[int, int], int] = {}

    def note(level: int, passage: str) -> None:
        if passage:
            units[level, _hash(passage)] = len(passage)

    for level, run in groupby(lines, key=lambda x: x[0]):
        content = [x for _, x in run]
        if level == 0:
            said.append("\n".join(content))
        note(level, normal(" ".join(content)))
        for line in content:
            note(level, normal(line))
        if level == 0:
            for paragraph in re.split(r"\n[ \t]*\n", "\n".join(content)):
                note(0, normal(paragraph))
    if any(level for level, _ in lines):
        own = [x for x in "\n".join(said).split("\n") if not _INTRO.match(x.strip())]
        note(0, normal(" ".join(own)))
        return "\n".join(own).strip("\n"), [(level, h, n) for (level, h), n in units.items()]
    return text, [(level, h, n) for (level, h), n in units.items()]


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, units, quoting = [], [], []
        for text in batch.column(3).to_pylist():
            own, found = parse(text) if text is not None else (None, [])
            texts.append(own)
            units.append([{"level": a, "h": b, "n": n} for a, b, n in found])
            quoting.append(any(x["level"] for x in units[-1]))
        kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(units, kind), pa.array(quoting, pa.bool_())], ["conv_id", "turn", "role", "text", "units", "quoting"])

    return c.map_rows(messages, run, "conv_id bigint, turn bigint, role string, text string, units array<struct<level:int,h:bigint,n:int>>, quoting boolean")


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, p_conv, p_turn): the original of each message's longest linked passage at each level."""
    units = parsed.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*").filter("conv_id is not null and turn is not null")
    asked = units.filter("level > 0").select("conv_id", "turn", "level", "h", "n")
    said = units.filter("level = 0").select("conv_id", "turn", "h").join(asked.select("h").distinct(), "h", "left_semi")
    said = c.materialise(said)
    events = said.select("conv_id", "h", "turn", F.lit(0).alias("level"), F.lit(0).alias("n"), F.col("turn").alias("own")).union(asked.select("conv_id", "h", "turn", "level", "n", F.lit(None).cast("bigint").alias("own")))
    before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("p_turn", F.max("own").over(before)).filter("level > 0")
    first = said.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = near.join(first, "h", "left")
    earlier = F.col("first") < F.struct("conv_id", "turn")
    parent = F.when(F.col("p_turn").isNotNull(), F.struct(F.col("conv_id"), F.col("p_turn").alias("turn"))).when(earlier, F.col("first"))
    found = found.withColumn("parent", parent).filter("parent is not null")
    best = found.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "parent")).alias("best"))
    return best.select("conv_id", "turn", "level", F.col("best.parent.conv_id").alias("p_conv"), F.col("best.parent.turn").alias("p_turn"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, r_conv, r_turn, depth) of every message with a parent, by pointer doubling; parents come before their replies."""
    state = c.materialise(parents.select("conv_id", "turn", F.col("p_conv").alias("r_conv"), F.col("p_turn").alias("r_turn"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        up = state.select(F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("r_conv").alias("a_conv"), F.col("r_turn").alias("a_turn"), F.col("depth").alias("more"))
        joined = state.join(up, ["r_conv", "r_turn"], "left")
        step = c.materialise(joined.select("conv_id", "turn", F.coalesce("a_conv", "r_conv").alias("r_conv"), F.coalesce("a_turn", "r_turn").alias("r_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        state = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return state


def threads(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, p_conv, p_turn, root_conv, root_turn, depth, n_levels), in reply order; n_levels counts the levels of quoting that were linked."""
    own = messages.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    parsed = c.materialise(_parsed(own))
    links = c.materialise(link(parsed))
    parents = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "p_conv", "p_turn")).alias("p"), F.count("*").alias("n_levels")).select("conv_id", "turn", "p.p_conv", "p.p_turn", "n_levels")
    parents = c.materialise(parents)
    joined = parsed.select("conv_id", "turn", "role", "text").join(parents, ["conv_id", "turn"], "left").join(_roots(parents), ["conv_id", "turn"], "left")
    out = joined.select(
        "conv_id", "turn", "role", "text", "p_conv", "p_turn", F.coalesce("r_conv", "conv_id").alias("root_conv"), F.coalesce("r_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("n_levels", F.lit(0)).cast("bigint").alias("n_levels"),
    )
    return out.orderBy("root_conv", "root_turn", "depth", "conv_id", "turn")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(c.table(spark, sf_dir, "conversations"))


_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, i, regexp_extract(x, '^(?:[ \t]*>)+[ \t]?') AS mark, x FROM (SELECT conv_id, turn, i, ls[i] AS x FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM m))),
v AS (SELECT conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(x, length(mark) + 1) AS c FROM l),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i))::int AS b FROM v)),
p AS (SELECT *, sum((trim(c, ' ' || chr(9)) = '')::int) OVER (PARTITION BY conv_id, turn, run ORDER BY i) AS para FROM r),
q AS (SELECT conv_id, turn, max(level) > 0 AS quoting FROM v GROUP BY ALL),
w AS (SELECT r.* FROM r JOIN q USING (conv_id, turn) WHERE quoting AND level = 0 AND NOT regexp_matches(trim(c), '^(?:On .* wrote|Le .* a écrit|Am .* schrieb.*|El .* escribió) ?:$')),
k AS (SELECT conv_id, turn, level, string_agg(c, ' ' ORDER BY i) AS s FROM r GROUP BY conv_id, turn, level, run UNION ALL SELECT conv_id, turn, level, c FROM r
    UNION ALL SELECT conv_id, turn, 0, string_agg(c, ' ' ORDER BY i) FROM p WHERE level = 0 GROUP BY conv_id, turn, run, para UNION ALL SELECT conv_id, turn, 0, string_agg(c, ' ' ORDER BY i) FROM w GROUP BY conv_id, turn),
u AS (SELECT DISTINCT conv_id, turn, level, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS s FROM k WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND trim(regexp_replace(s, '\s+', ' ', 'g')) <> ''),
f AS (SELECT s, min((conv_id, turn)) AS f FROM u WHERE level = 0 GROUP BY s),
a AS (SELECT a.conv_id, a.turn, a.level, length(a.s) AS n, (SELECT max(o.turn) FROM u o WHERE o.level = 0 AND o.s = a.s AND o.conv_id = a.conv_id AND o.turn < a.turn) AS near, f.f FROM u a LEFT JOIN f USING (s) WHERE a.level > 0),
b AS (SELECT conv_id, turn, level, max((n, CASE WHEN near IS NOT NULL THEN row(conv_id, near) ELSE f END)) AS best FROM a WHERE near IS NOT NULL OR f < row(conv_id, turn) GROUP BY conv_id, turn, level),
h AS (SELECT conv_id, turn, arg_min(best[2][1], level) AS p_conv, arg_min(best[2][2], level) AS p_turn, count(*) AS n_levels FROM b GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, p_conv AS r_conv, p_turn AS r_turn, 1 AS depth FROM h UNION ALL SELECT t.conv_id, t.turn, h.p_conv, h.p_turn, depth + 1 FROM t JOIN h ON h.conv_id = t.r_conv AND h.turn = t.r_turn),
z AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(r_conv, depth) AS r_conv, arg_max(r_turn, depth) AS r_turn FROM t GROUP BY conv_id, turn),
o AS (SELECT conv_id, turn, trim(string_agg(c, chr(10) ORDER BY i), chr(10)) AS own FROM w GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, CASE WHEN quoting THEN coalesce(own, '') ELSE text END AS text, p_conv, p_turn, coalesce(r_conv, m.conv_id) AS root_conv, coalesce(r_turn, m.turn) AS root_turn, coalesce(depth, 0)::bigint AS depth, coalesce(n_levels, 0)::bigint AS n_levels
FROM m LEFT JOIN q USING (conv_id, turn) LEFT JOIN h USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)
"""

QUERIES = {"op5_quotation_linking": op5_quotation_linking}
ORACLES = {"op5_quotation_linking": _SQL}
