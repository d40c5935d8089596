"""Personal data: pattern detectors, and information-theoretic sanitisation of the terms that go with what they find.

A protected entity is a detected value. A term is a word of a text, lower case and without outer
punctuation, that touches no detected value. Corpus co-occurrence says how much a term reveals: with
n(t,e) distinct texts that hold the term and the entity, n(t) distinct texts that hold the term, n(e)
texts with the entity and N texts, a term discloses the entity when n(t,e) >= support, n(t,e)/n(t) >=
confidence and log2(n(t,e) N / (n(t) n(e))) >= bits. Such a term is removed wherever it stands in a text
that holds the entity, so texts without protected entities stay as they are. Exact copies count once.

Only what can reach the thresholds is paired: entities and terms of `support` texts or more, and a term
with an entity only if it isn't in more texts than the entity's divided by the confidence.

Null texts are empty, an empty text has no spans, rows that repeat an id are judged each by its own
text, extra columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: In these patterns the run before @ or the first dot is entered only where it begins, or where the last match ended,
#: and repeats are possessive: the matches are those of the plain patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_EDGE = ".,;:!?\"'()[]{}<>|*#"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(bare) < 4) & (F.substring(bare, 1, 3).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), small)


def _card_ok(m: Column) -> Column:
    def luhn(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48
            twice = digit * 2
            return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0

    return c.let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def detected(text: Column) -> Column:
    """Spans (start, k, end, kind, text) of the four kinds."""
    return F.concat(
        c.as_spans(c.matches(text, EMAIL, word="@"), 0, "email"),
        c.as_spans(c.matches(text, IP, _ip_ok, word="."), 1, "ip"),
        c.as_spans(c.matches(text, CARD, _card_ok), 2, "card"),
        c.as_spans(c.matches(text, PHONE, _phone_ok, word="+"), 3, "phone"),
    )


#: Stands for each character of a detected value where words are looked for; it is no character of texts.
_HIDDEN = "\uffff"


def _hidden(text: Column, spans: Column) -> Column:
    """`text` with each character of a span replaced, so that all others keep their places."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        end = F.greatest(begin, s["end"])
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(acc["out"], gap, F.repeat(F.lit(_HIDDEN), (end - begin).cast("int"))).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _term(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(_EDGE)))


def _words(text: Column) -> Column:
    """The distinct terms of a text whose detected values are hidden."""
    found = F.array_distinct(F.transform(F.split(text, c.SPACES), _term))
    return F.filter(found, lambda t: (t != "") & ~F.contains(t, F.lit(_HIDDEN)))


def _places(text: Column, terms: Column) -> Column:
    """Spans of the words of a text, with its detected values hidden, that are among the terms."""
    front = F.lit(f"^[{re.escape(_EDGE)}]*")

    def span(w: Column) -> Column:
        core = F.btrim(w["text"], F.lit(_EDGE))
        begin = w["start"] + F.length(w["text"]) - F.length(F.regexp_replace(w["text"], front, F.lit("")))
        return F.struct(begin.alias("start"), F.lit(len(KINDS)).alias("k"), (begin + F.length(core)).alias("end"), F.lit(TERM).alias("kind"), F.lower(core).alias("text"))

    return F.filter(F.transform(c.matches(text, c.WORD), span).cast(c.SPAN), lambda s: F.array_contains(terms, s["text"]))


def _entity(s: Column) -> Column:
    return F.xxhash64(s["kind"], F.lower(F.regexp_replace(s["text"], r"[\x20().-]", "")))


def disclosing(base: DataFrame, texts: DataFrame, support: int, confidence: float, bits: float) -> DataFrame:
    """(entity, term): which terms disclose which entities; base (copy, spans, hidden), texts (copy, text)."""
    entities = base.filter("hidden is not null").select("copy", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct()
    having = entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    entities = c.materialise(entities.join(having, "entity"))
    reach = entities.groupBy("copy").agg((F.max("n_e") / confidence).alias("most"))
    words = c.materialise(base.filter("hidden is not null").join(reach, "copy").select("copy", "most", F.explode(_words(F.col("hidden"))).alias("term")).distinct())
    # A term is in no fewer texts than it is in with any recurring entity, and it is only paired with entities of as many texts.
    around = c.materialise(words.groupBy("term").agg(F.count("*").alias("n_some")).filter(F.col("n_some") >= support))
    likely = words.join(around, "term").filter(F.col("n_some") <= F.col("most")).select("copy", "term", "n_some")
    together = likely.join(entities, "copy").filter(F.col("n_some") <= F.col("n_e") / confidence).groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_some").alias("n_some"), F.first("n_e").alias("n_e"))
    together = c.materialise(together.filter((F.col("n_te") >= support) & (F.col("n_te") >= confidence * F.col("n_some"))).drop("n_some"))
    terms = together.select("term").distinct()
    every = texts.select("copy", F.explode(F.split("text", c.SPACES)).alias("word")).select("copy", _term(F.col("word")).alias("term"))
    anywhere = c.join_small(every, terms, ["term"], "left_semi").groupBy("term", "copy").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("n_t"))
    total = texts.groupBy("copy").agg(F.lit(1)).count()
    strong = together.join(anywhere, "term").filter((F.col("n_te") >= confidence * F.col("n_t")) & (F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e"))) >= bits))
    pairs = strong.select("entity", "term").join(entities.select("copy", "entity"), "entity")
    return pairs.join(words.select("copy", "term"), ["copy", "term"]).groupBy("copy").agg(F.collect_set("term").alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, confidence: float = 0.8, bits: float = 3.0) -> DataFrame:
    """(doc_id, spans) of every row: detected spans, and spans of kind `term` for what discloses them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("doc_id", F.xxhash64("text").alias("copy"), c.let(detected(F.col("text")), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, _hidden(F.col("text"), s)).alias("hidden"))).alias("x"))
    base = c.materialise(found.select("doc_id", "copy", "x.spans", "x.hidden"))
    revealed = c.materialise(disclosing(base, rows.select(F.xxhash64("text").alias("copy"), "text"), support, confidence, bits))
    plain = base.filter("hidden is null").select("doc_id", "spans")
    places = F.when(F.col("terms").isNotNull(), _places(F.col("hidden"), F.col("terms"))).otherwise(F.array().cast(c.SPAN))
    return plain.union(base.filter("hidden is not null").join(revealed, "copy", "left").select("doc_id", F.concat("spans", places).alias("spans")))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """(doc_id, text) with each detected value and each disclosing term replaced by the name of its kind; ids must be unique."""
    found = find(docs, id_col, text_col, **options)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(found, "doc_id").select("doc_id", c.redact(F.col("text"), F.col("spans")).alias("text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["k"] < len(KINDS))
    return find(c.table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("bigint"), *[count(k) for k in KINDS], F.sha2(c.spans_text(base).cast("binary"), 256).alias("base_sha256"), c.spans_text(spans).alias("spans"), count(TERM)
    )


def _oracle() -> str:
    """DuckDB: the plain patterns, offsets by running sums, and the statistics of terms near entities."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::int WHEN {digits}[-i]::int > 4 THEN {digits}[-i]::int * 2 - 9 ELSE {digits}[-i]::int * 2 END)) % 10 = 0"
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(x.m, '.'), lambda y: y::hugeint > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }
    placed = "list_transform(range(1, len(h) + 1), lambda i: {'m': h[i], 'e': (list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(h[1:i], lambda y: length(y))))::bigint})"
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, t, {k} AS k, '{kind}' AS kind, x.e - length(x.m) AS a, x.e AS e, x.m AS m FROM (SELECT doc_id, t, unnest(list_filter({placed}, lambda x: {keep})) AS x
        FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')))"""
        for k, (kind, (p, keep)) in enumerate(rules.items())
    )
    word, edge = r"[^\x20\x09-\x0D]+", _EDGE.replace("'", "''")
    core = f"trim(w, '{edge}')"
    joined = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k, e)"
    counts = ", ".join(f"coalesce(n{k}, 0)::bigint AS n_{kind}" for k, kind in enumerate(KINDS))
    sums = ", ".join(f"count(*) FILTER (k = {k}) AS n{k}" for k in range(len(KINDS) + 1))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({parts}),
    en AS (SELECT DISTINCT t, kind || ':' || lower(regexp_replace(m, '[\\x20().-]', '', 'g')) AS entity FROM s),
    ne AS (SELECT entity, count(*) AS n_e FROM en GROUP BY 1 HAVING count(*) >= 3),
    x AS (SELECT doc_id, t, y.e - length(y.m) AS a, y.m AS w FROM (SELECT doc_id, t, unnest({placed}) AS y FROM (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS h, regexp_split_to_array(t, '{word}') AS g FROM d WHERE doc_id IN (SELECT doc_id FROM s)))),
    n AS (SELECT doc_id, t, lower({core}) AS term, a + length(w) - length(ltrim(w, '{edge}')) AS a, a + length(w) - length(ltrim(w, '{edge}')) + length({core}) AS e FROM x
        WHERE {core} <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = x.doc_id AND s.a < x.a + length(x.w) AND s.e > x.a)),
    te AS (SELECT entity, term, count(*) AS n_te, any_value(n_e) AS n_e FROM (SELECT DISTINCT t, term FROM n) JOIN en USING (t) JOIN ne USING (entity) GROUP BY entity, term HAVING count(*) >= 3),
    nt AS (SELECT term, count(DISTINCT t) AS n_t FROM (SELECT t, lower(trim(unnest(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+')), '{edge}')) AS term FROM d) WHERE term IN (SELECT term FROM te) GROUP BY term),
    st AS (SELECT entity, term FROM te JOIN nt USING (term) WHERE n_te >= 0.8 * n_t AND log2(n_te * (SELECT count(DISTINCT t) FROM d) / (n_t * n_e)) >= 3),
    u AS (SELECT doc_id, k, kind, a, e FROM s UNION ALL SELECT DISTINCT doc_id, {len(KINDS)}, '{TERM}', a, e FROM n JOIN (SELECT DISTINCT t, term FROM en JOIN st USING (entity)) USING (t, term)),
    f AS (SELECT doc_id, {sums}, {joined} FILTER (k < {len(KINDS)}) AS b, {joined} AS l FROM u GROUP BY doc_id)
    SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(l, '') AS spans, coalesce(n{len(KINDS)}, 0)::bigint AS n_term FROM d LEFT JOIN f USING (doc_id)"""


QUERIES = {"op10_pii": op10_pii}
ORACLES = {"op10_pii": _oracle()}
