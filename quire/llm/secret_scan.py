"""Secret scan: a trigram inverted index chooses the texts that a rule must read.

Each rule's pattern is parsed and turned into a Boolean query over trigrams of the lower-cased
text. One pass over the texts builds the postings (gram, document) of the trigrams that some query
names, and scans every text for the rules without a mandatory trigram. The postings of each
alternative of a query are intersected, the alternatives' results united, and the texts of these
candidates alone are fetched and verified by the rules' patterns.

A document is known by hashes of its id and text, so that null and repeated ids need no care:
repeated rows have equal spans. Null texts are empty, an empty text has no spans, extra columns stay
with `annotate`, which refuses a column of the name that it adds, and are left out by `scan`; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


@dataclass(frozen=True)
class Rule:
    """`pattern` is read alike by Python and Java; `group` of it needs `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("git_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE + MORE

#: A query is a set of alternatives, each a set of trigrams that all have to occur; {∅} means every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset({frozenset()})
_MOST = 64


def _simplify(q: Query) -> Query:
    kept = frozenset(a for a in q if not any(b < a for b in q))
    return kept if len(kept) <= _MOST else ANY


def _both(p: Query, q: Query) -> Query:
    return _simplify(frozenset(a | b for a, b in product(p, q))) if len(p) * len(q) <= _MOST**2 else p


def _grams(strings: set[str]) -> Query:
    return _simplify(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies, over ASCII-lower-cased text."""
    from re import _constants as k
    from re import _parser as parser

    def chars(items: list) -> set[str] | None:
        out: set[str] = set()
        for op, arg in items:
            if op is k.LITERAL:
                out.add(chr(arg))
            elif op is k.RANGE and arg[1] - arg[0] < 4:
                out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out

    def lower(strings: set[str]) -> set[str]:
        return {"".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s) for s in strings}

    def walk(items: list) -> tuple[Query, set[str] | None]:
        """The query, and all strings that the part can be if they are few."""
        query, run, whole = ANY, {""}, True
        for op, arg in items:
            exact: set[str] | None
            inner: Query = ANY
            if op is k.LITERAL:
                exact = lower({chr(arg)})
            elif op is k.IN:
                exact = chars(arg)
                exact = lower(exact) if exact is not None else None
            elif op is k.SUBPATTERN:
                inner, exact = walk(arg[3])
            elif op is k.BRANCH:
                parts = [walk(x) for x in arg[1]]
                inner = _simplify(frozenset(a for q, _ in parts for a in q))
                exact = set().union(*(e for _, e in parts)) if all(e is not None for _, e in parts) else None
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
                low, high, body = arg
                q, e = walk(body)
                inner = q if low else ANY
                exact = {"".join(t) for n in range(low, high + 1) for t in product(e, repeat=n)} if e is not None and high != k.MAXREPEAT and len(e) ** high <= _MOST else None
            elif op in (k.AT, k.ASSERT, k.ASSERT_NOT):
                exact = {""}
            else:
                exact = None
            if exact is not None and len(exact) * len(run) <= _MOST:
                run = {a + b for a, b in product(run, exact)}
            else:
                query, run, whole = _both(_both(query, _grams(run)), inner), {""}, False
                if exact is not None and len(exact) <= _MOST:
                    run = exact
        return (query, run) if whole else (_both(query, _grams(run)), None)

    query, run = walk(list(parser.parse(pattern)))
    return _both(query, _grams(run)) if run is not None else query


def queries(rules: tuple[Rule, ...] = RULES) -> dict[str, Query]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for q in queries(rules).values() for a in q for g in a})


_KEY = ["__id", "__copy"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __copy, __text): the key of a document, and its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(id_col).alias("__id"), F.xxhash64(text).alias("__copy"), text.alias("__text"))


def _indexed(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, grams, spans): the named trigrams of each document, null where it lacks one, and the spans of the rules that read every text."""
    plans = queries(rules)
    low = keyed.withColumn("__low", F.lower("__text"))
    grams = F.array(*[F.when(F.contains("__low", F.lit(g)), F.lit(n)) for n, g in enumerate(_vocabulary(rules))]).cast("array<int>")
    every = [_verify(F.col("__text"), r, k) for k, r in enumerate(rules) if frozenset() in plans[r.kind]]
    return low.select(*_KEY, grams.alias("grams"), F.concat(F.array().cast(c.SPAN), *every).alias("spans"))


def _candidates(indexed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, ks): the documents in which some rules can match, with the numbers of the rules, by intersecting postings (gram, key)."""
    plans, number = queries(rules), {g: n for n, g in enumerate(_vocabulary(rules))}
    wanted = [(number[g], k, i, len(a)) for k, r in enumerate(rules) if frozenset() not in plans[r.kind] for i, a in enumerate(sorted(plans[r.kind], key=sorted)) for g in sorted(a)]
    terms = indexed.sparkSession.createDataFrame(wanted, "gram int, k int, alternative int, need int")
    postings = indexed.select(*_KEY, F.explode("grams").alias("gram")).filter("gram is not null").distinct()
    hits = postings.join(F.broadcast(terms), "gram").groupBy(*_KEY, "k", "alternative").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return hits.filter("n = need").groupBy(*_KEY).agg(F.collect_set("k").alias("ks"))


def lookup(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, id) of the candidates of each rule that has a mandatory trigram."""
    found = _candidates(_indexed(_keyed(docs, id_col, text_col), rules), rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    own = docs.select(F.col(id_col), F.xxhash64(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__copy"))
    return own.join(found, _KEY).select(F.explode(F.transform("ks", lambda k: F.get(kinds, k))).alias("kind"), id_col).distinct()


def _verify(text: Column, rule: Rule, k: int) -> Column:
    if rule.group:
        def valid(m: Column) -> Column:
            return F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    else:
        def valid(m: Column) -> Column:
            return F.length(m) >= rule.least
    return c.as_spans(c.matches(text, rule.pattern, valid), k, rule.kind)


def _found(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(key, spans) of every document, once."""
    keyed = _keyed(docs, id_col, text_col)
    indexed = c.materialise(_indexed(keyed, rules))
    candidates = c.materialise(_candidates(indexed, rules))
    read = c.join_small(keyed, candidates, _KEY, "inner").dropDuplicates(_KEY)
    plans, none = queries(rules), F.array().cast(c.SPAN)
    verified = [F.when(F.array_contains("ks", k), _verify(F.col("__text"), r, k)).otherwise(none) for k, r in enumerate(rules) if frozenset() not in plans[r.kind]]
    spans = c.materialise(read.select(*_KEY, F.concat(none, *verified).alias("more")).filter(F.size("more") > 0))
    every = indexed.select(*_KEY, "spans").dropDuplicates(_KEY)
    return every.join(spans, _KEY, "left").select(*_KEY, F.array_sort(F.concat("spans", F.coalesce("more", none))).alias("spans"))


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """`docs` with the spans of all rules: array of (start, k, end, kind, text) in the rules' order k; `out` must not be a column of `docs`."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}: give another name")
    found = _found(docs, rules, id_col, text_col).withColumnRenamed("spans", out)
    keys = {"__id": F.xxhash64(id_col), "__copy": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    return docs.withColumns(keys).join(found, _KEY).select(*docs.columns, out)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "clean_text") -> DataFrame:
    """`docs` with each secret replaced by the name of its kind."""
    found = annotate(docs, rules, id_col, text_col, "__spans")
    return found.withColumn(out, c.redact(F.coalesce(F.col(text_col), F.lit("")), F.col("__spans"))).drop("__spans")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = own.select("doc_id", F.xxhash64("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__copy"))
    return keys.join(_found(own, rules, "doc_id", "text"), _KEY).select("doc_id", "spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["k"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return scan(c.table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("bigint"), *[count(r.kind) for r in BASE], F.sha2(c.spans_text(base).cast("binary"), 256).alias("base_sha256"), c.spans_text(spans).alias("spans")
    )


def _oracle() -> str:
    """DuckDB: matches and the texts between them once per rule, then offsets by running sums; rules without a match cost one test."""
    word = "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in "password|passwd|secret|token|api_?key")
    assign = f"({word})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    rules = {"assign": (assign, f"length(regexp_extract(x.m, '{assign}', 2)) >= 8"), "access": ("AKIA[A-Z0-9]+", "length(x.m) >= 16"), "hex": ("[0-9a-f]+", "length(x.m) >= 32")}
    rules |= {r.kind: (r.pattern.replace("[^\\s:/@]", "[^\\x20\\x09-\\x0D:/@]"), "true") for r in MORE}
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'m': h[i],
        'e': (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))))::bigint}}), lambda x: {keep})) AS x
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p if kind != "hex" else "[0-9a-f]{32}"}'))"""
        for k, (kind, (p, keep)) in enumerate(rules.items())
    )
    text = "string_agg(kind || ':' || (x.e - length(x.m)) || ':' || x.e, ',' ORDER BY x.e - length(x.m), k, x.e)"
    counts = ", ".join(f"coalesce(n{k}, 0)::bigint AS n_{r.kind}" for k, r in enumerate(BASE))
    sums = ", ".join(f"count(*) FILTER (k = {k}) AS n{k}" for k in range(len(BASE)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({parts}),
    f AS (SELECT doc_id, {sums}, {text} FILTER (k < {len(BASE)}) AS b, {text} AS a FROM s GROUP BY doc_id)
    SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES = {"op9_secret_scan": _oracle()}

assert all(re.compile(r.pattern) for r in RULES)
