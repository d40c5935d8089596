"""Quality rules: Jensen-Shannon distance of a document's histograms to those of its language.

Each document gives two histograms: its characters by class, and its words by common word (the
words of its language's list, and all others as one bin). They are compared with fixed references of
the language, which don't depend on the documents judged. A document is rejected when it fails a base
rule, or when it is long enough for a histogram to mean something and its distance to the reference is
over the limit. A text without a language, or with a code that names none, is held to the nearest
reference of all, by the sum of both distances, unless most of its letters are beyond ASCII; such a
text, and one of a language without references, gives no distances, and only the base rules judge it.

Null texts have no words and fail the base rules, as empty ones do. Repeated rows are judged alike,
extra columns stay where `keep` returns the rows, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

# Common words of each language, with rounded shares of the words of general prose in hundredths of a percent.
COMMON = {
    "de": {"der": 330, "die": 320, "das": 100, "und": 290, "in": 190, "von": 110, "zu": 100, "den": 120, "mit": 90, "sich": 80, "des": 80, "auf": 80, "für": 80, "ist": 80, "im": 80, "dem": 80, "nicht": 70, "ein": 70, "eine": 70, "als": 60, "auch": 60, "es": 60, "an": 50},
    "en": {"the": 620, "of": 300, "and": 270, "to": 260, "in": 190, "a": 220, "is": 100, "that": 110, "it": 100, "was": 90, "for": 90, "on": 70, "with": 65, "as": 65, "be": 65, "by": 50, "at": 50, "this": 45, "are": 45, "from": 40, "or": 35, "an": 33, "which": 35},
    "es": {"de": 630, "la": 380, "que": 320, "el": 280, "en": 260, "y": 260, "a": 200, "los": 170, "se": 130, "del": 120, "las": 110, "un": 110, "por": 100, "con": 90, "no": 100, "una": 85, "su": 75, "para": 75, "es": 70, "al": 65, "lo": 60, "como": 55},
    "fr": {"de": 520, "la": 310, "le": 260, "et": 240, "les": 220, "des": 190, "en": 150, "un": 130, "une": 110, "du": 130, "que": 110, "qui": 90, "est": 100, "dans": 90, "pour": 80, "par": 70, "sur": 65, "au": 65, "avec": 50, "il": 60, "ne": 50, "se": 45, "pas": 50},
}

# Codes of languages that have no references here.
OTHERS = frozenset(
    "af am ar az be bg bn bs ca cs cy da el et eu fa fi ga gl gu he hi hr hu hy id is it ja ka kk km kn ko ky lo lt lv mk ml mn mr ms mt my nb ne nl nn no pa pl ps pt ro ru si sk sl so sq sr sv sw ta te tg th tk tl tr uk ur uz vi yi zh zu".split()
)

#: Limits of the distances: see README for how far documents of either kind are from the references.
CHAR_LIMIT, WORD_LIMIT = 0.22, 0.35

#: Digits count with small letters, so that a number, key or address in a short text does not move it far.
CLASSES = ("alnum", "upper", "space", "newline", "stop", "pipe", "symbol", "quote", "other_ascii", "letter_beyond")

# Shares of these classes in general prose, in hundredths of a percent.
CHARACTERS = {
    "de": (7550, 500, 1450, 40, 220, 0, 0, 80, 10, 150),
    "en": (7750, 250, 1650, 40, 220, 0, 0, 80, 10, 0),
    "es": (7650, 200, 1650, 40, 220, 0, 0, 60, 10, 170),
    "fr": (7500, 200, 1650, 40, 200, 0, 0, 150, 10, 250),
}


def _class_table() -> np.ndarray:
    """Class of each byte; the continuation bytes of UTF-8 have none."""
    t = np.full(256, CLASSES.index("other_ascii"))
    for name, chars in (
        ("alnum", [*range(97, 123), *range(48, 58)]), ("upper", range(65, 91)), ("space", b" \t\v\f\r"), ("newline", b"\n"),
        ("stop", b".,;:!?"), ("pipe", b"|"), ("symbol", b"#*$%&<>"), ("quote", b"\"'()[]{}-"), ("letter_beyond", range(192, 256)),
    ):
        t[list(chars)] = CLASSES.index(name)
    t[128:192] = len(CLASSES)
    return t.astype(np.uint8)


TABLE = _class_table()
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ", ".join(f"{x} bigint" for x in _COUNTS) + ", char_distance double, word_distance double"


def shares(parts: list[int] | tuple[int, ...]) -> np.ndarray:
    return np.array(parts, np.float64) / sum(parts)


REF_CHARS = {lang: shares(x) for lang, x in CHARACTERS.items()}
REF_WORDS = {lang: shares([*x.values(), 10_000 - sum(x.values())]) for lang, x in COMMON.items()}


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float | None:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal distributions, 1 for disjoint ones; None of nothing."""
    if not (total := counts.sum()):
        return None
    p = counts / total
    m = (p + reference) / 2
    half = [float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, reference)]
    return max(0.0, sum(half) / 2) ** 0.5


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words in windows of `size` that are found twice or more; ids: dense numbers of the words."""
    m = len(ids) - size + 1
    if m < 2:
        return 0
    key = ids[:m]
    for i in range(1, size):
        key = key * (int(ids.max()) + 1) + ids[i : i + m]
        if i < size - 1 and len(ids) >= 2_000_000:  # keeps the products within 64 bits
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(size):
        covered[i : i + m] |= twice
    return int(covered.sum())


def measure(text: bytes, lang: str | None) -> tuple:
    """The five counts, and the distances of the histograms to the language's references, to the nearest ones if it is unknown, or none if there are none of it."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    hist = np.bincount(TABLE[np.frombuffer(text, dtype=np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    of = np.bincount(ids, minlength=1)
    near = []
    beyond = int(hist[CLASSES.index("letter_beyond")])
    foreign = 2 * beyond > beyond + int(hist[CLASSES.index("alnum")] + hist[CLASSES.index("upper")])
    for name in (lang,) if lang in COMMON else () if lang in OTHERS or foreign else COMMON:
        known = [int(of[seen[w]]) if (w := x.encode()) in seen else 0 for x in COMMON[name]]
        near.append((js_distance(hist, REF_CHARS[name]), js_distance(np.array([*known, len(words) - sum(known)]), REF_WORDS[name])))
    best = min(near, key=lambda x: (x[0] or 0) + (x[1] or 0), default=(None, None))
    blank = int(hist[CLASSES.index("space")] + hist[CLASSES.index("newline")])
    return (len(words), int(hist.sum()) - blank, int(hist[CLASSES.index("symbol")] + hist[CLASSES.index("pipe")]), len(lines) - len(set(lines)), repeated_words(ids), *best)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, counts, char_distance, word_distance) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(2).to_pylist()
        rows = [measure(t, x) for t, x in zip(c.texts_of(batch.column(1)), langs, strict=True)]
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * 5 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]], ["doc_id", *_COUNTS, "char_distance", "word_distance"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return c.map_rows(own, run, f"doc_id bigint, {FEATURES}")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = 50, min_words_common: int = 150) -> DataFrame:
    """(doc_id, counts, base_failed, char_distance, word_distance, kept) of every row.

    The character histogram needs `min_words` words to count, the histogram of common words `min_words_common`.
    """
    failed = _base_failed()
    far = ((F.col("n_words") >= min_words) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= min_words_common) & (F.col("word_distance") > word_limit))
    return features(docs, id_col, text_col, lang_col).select("doc_id", *_COUNTS, failed.alias("base_failed"), "char_distance", "word_distance", (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; ids must be unique and not null."""
    rejected = judge(docs, id_col, **options).filter("not kept").select(F.col("doc_id").alias("__rejected"))
    return docs.join(rejected, docs[id_col].cast("bigint") == rejected["__rejected"], "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept", F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"))


def _oracle() -> str:
    patterns = ["[a-z0-9]", "[A-Z]", r"[\x20\x09\x0B-\x0D]", r"\n", "[.,;:!?]", "[|]", "[#*$%&<>]", "[\"''()\\[\\]{}-]", "[^a-zA-Z0-9\\x20\\x09-\\x0D.,;:!?|#*$%&<>\"''()\\[\\]{}\\x80-\\x{10FFFF}-]", r"[^\x00-\x7F]"]
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for p in patterns)

    def listed(values: object) -> str:
        return f"[{', '.join(map(repr, values))}]"

    def distance(own: str, ref: str) -> str:
        term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({1} + {2}) / 2)) ELSE 0 END"
        p, q = f"({own}[i] / list_sum({own}))", f"({ref}[i] / list_sum({ref}))"
        return f"CASE WHEN list_sum({own}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({own}) + 1), lambda i: {term.format(p, p, q)} + {term.format(q, p, q)})) / 2)) END"

    refs = ", ".join(f"('{lang}', {listed(CHARACTERS[lang])}, {listed(words)}, {listed([*words.values(), 10_000 - sum(words.values())])})" for lang, words in COMMON.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {tuple(COMMON)} THEN lang WHEN lang IN {tuple(sorted(OTHERS))} THEN 'none' END AS language,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    refs(language, r_chars, words, r_words) AS (VALUES {refs}),
    g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
    c AS (SELECT row, g FROM g GROUP BY ALL HAVING count(*) > 1), r AS (SELECT row, count(DISTINCT x) AS n FROM (SELECT g.row, unnest([i, i + 1, i + 2]) AS x FROM g JOIN c USING (row, g)) GROUP BY row),
    l AS (SELECT row, count(*) - count(DISTINCT x) AS n FROM (SELECT row, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY row),
    k AS (SELECT *, [{counts}] AS chars FROM d),
    h AS (SELECT k.row, refs.language, chars, r_chars, r_words, list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))) AS known, len(w) AS n FROM k JOIN refs ON coalesce(k.language, CASE WHEN 2 * chars[10] > chars[1] + chars[2] + chars[10] THEN 'none' ELSE refs.language END) = refs.language),
    e AS (SELECT row, language, {distance('chars', 'r_chars')} AS cd, {distance('common', 'r_words')} AS wd FROM (SELECT *, list_append(known, n - list_sum(known)) AS common FROM h)),
    f AS (SELECT row, cd, wd FROM e QUALIFY row_number() OVER (PARTITION BY row ORDER BY coalesce(cd, 0) + coalesce(wd, 0), language) = 1),
    b AS (SELECT k.row, doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, (chars[6] + chars[7])::bigint AS n_symbols, coalesce(l.n, 0)::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words,
        len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM k LEFT JOIN l USING (row) LEFT JOIN r USING (row))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce((n_words >= 50 AND cd > {CHAR_LIMIT}) OR (n_words >= 150 AND wd > {WORD_LIMIT}), false) AS kept, round(cd, 9) AS char_distance, round(wd, 9) AS word_distance FROM b LEFT JOIN f USING (row)"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": _oracle()}
