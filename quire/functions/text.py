"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having "
    "he her hers him his how i if in into is it its itself may might more most must no nor not of on once "
    "only or other our ours out over own same she should so some such than that the their theirs them then "
    "there these they this those through to too under up very was we were what when where which while who why "
    "will with would you your yours also based between both each et etc paper propose proposed presents present "
    "show shows shown method methods approach approaches result results study studies using use used via new"
).split()

#: Latin letters with marks, and the letters below the marks.
_MARKED = [chr(x) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(x))) > 1 and ord(unicodedata.normalize("NFD", chr(x))[0]) < 128]
_PLAIN = [unicodedata.normalize("NFD", x)[0] for x in _MARKED]


#: The same for str.translate.
PLAIN = dict(zip(map(ord, _MARKED), _PLAIN, strict=True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_marks(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, "".join(_MARKED), "".join(_PLAIN))


def lexical_tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; each ideograph stands alone."""
    apart = F.regexp_replace(text, r"([\x{3400}-\x{9fff}])", " $1 ")
    return F.regexp_extract_all(fold_marks(F.lower(apart)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often the tokens of `phrase` follow each other; overlapping occurrences count."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    wanted = F.array(*[F.lit(p) for p in phrase])
    starts = F.filter(F.transform(tokens, lambda t, i: F.when(t == phrase[0], i)), lambda i: i.isNotNull())
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i + 1, len(phrase)) == wanted))


#: Characters that stand for one other (full-width forms, mathematical letters, old-style spaces) and for several (ligatures), by Unicode's compatibility forms.
_WIDE = [(chr(x), n) for x in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if (n := unicodedata.normalize("NFKC", chr(x))) != chr(x)]
_ALIKE = "".join(x for x, n in _WIDE if len(n) == 1), "".join(n for _, n in _WIDE if len(n) == 1)
_LIGATURES = [(x, n) for x, n in _WIDE if "\ufb00" <= x <= "\ufb06" or x == "\u2026"]
#: A letter and the mark behind it that make one character.
_COMPOSED = [(d, chr(x)) for x in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(x))) == 2]


def compatible(text: Column) -> Column:
    """Full-width forms, ligatures and the like as plain characters, and Latin letters with a mark behind them as one; texts in ASCII aren't touched."""
    def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
        table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
        return F.aggregate(table, x, lambda acc, p: F.replace(acc, p["a"], p["b"]))

    def composed(x: Column) -> Column:
        return F.when(x.rlike(r"[\x{0300}-\x{036F}]"), replaced(x, _COMPOSED)).otherwise(x)

    return F.when(text.rlike(r"[^\x00-\x7F]"), let(replaced(F.translate(text, *_ALIKE), _LIGATURES), composed)).otherwise(text)


def clean(text: Column) -> Column:
    """Compatible characters, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(compatible(text), r"\s+", " "))


def canonical(text: Column) -> Column:
    return F.lower(clean(text))


# Patterns of a topic word and of a run of ideographs.
TOPIC_WORD = r"[a-z0-9]+(?:[._+-][a-z0-9]+)*"
TOPIC_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"


def topic_tokens(text: Column) -> Column:
    """Words of small Latin letters and digits, without single characters, numbers and stop words, then pairs of neighbouring ideographs."""
    low = canonical(text)
    words = F.filter(
        F.regexp_extract_all(low, F.lit(TOPIC_WORD), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$") & ~t.isin(STOPWORDS)
    )
    runs = F.filter(F.regexp_extract_all(low, F.lit(TOPIC_RUN), F.lit(0)), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def snippet(text: Column, wanted: str) -> Column:
    """500 characters from 100 before the first occurrence, any case; from the start if there is none."""
    return F.substring(text, F.greatest(F.lit(1), F.locate(wanted.lower(), F.lower(text)) - 100), F.lit(500))


# Venue families, tried in this order.
VENUES = (
    (r"(?:advances\s+in\s+)?neural\s+information\s+processing\s+systems|\bneurips\b|\bnips\b", "NeurIPS"),
    (r"computer\s+vision\s+and\s+pattern\s+recognition|\bcvpr\b", "CVPR"),
    (r"international\s+conference\s+on\s+machine\s+learning|\bicml\b", "ICML"),
    (r"international\s+conference\s+on\s+learning\s+representations|\biclr\b", "ICLR"),
    (r"international\s+conference\s+on\s+computer\s+vision|\biccv\b", "ICCV"),
    (r"european\s+conference\s+on\s+computer\s+vision|\beccv\b", "ECCV"),
    (r"association\s+for\s+computational\s+linguistics|\bacl\b", "ACL"),
    (r"empirical\s+methods\s+in\s+natural\s+language\s+processing|\bemnlp\b", "EMNLP"),
    (r"transactions\s+on\s+machine\s+learning\s+research|\btmlr\b", "TMLR"),
    (r"journal\s+of\s+machine\s+learning\s+research|\bjmlr\b", "JMLR"),
    (r"^arxiv(?:\b|[-:])", "arXiv"),
)


# Patterns of a venue's outer punctuation, leading year, "Proceedings of", trailing year and acronym.
VENUE_EDGES = r"^[,;:\s]+|[,;:\s]+$"
VENUE_NOISE = (r"^(?:19|20)\d{2}\s+", r"(?i)^proceedings\s+of\s+(?:the\s+)?(?:\d+(?:st|nd|rd|th)\s+)?", r"[,\s]+(?:19|20)\d{2}$")
VENUE_ACRONYM = r"\(([A-Za-z][A-Za-z0-9.+&/-]{1,11})\)\s*$"


def venue(text: Column) -> Column:
    """Short name of a known venue, or else an acronym in brackets at the end, or else the name without year and "Proceedings of"."""

    def named(name: Column) -> Column:
        low, bare = F.lower(name), name
        for pattern in VENUE_NOISE:
            bare = F.regexp_replace(bare, pattern, "")
        bare = F.trim(bare)
        acronym = F.regexp_extract(bare, VENUE_ACRONYM, 1)
        out = F.when(name == "", "")
        for pattern, label in VENUES:
            out = out.when(low.rlike(pattern), label)
        return out.when(acronym != "", acronym).otherwise(bare)

    return let(F.regexp_replace(clean(text), VENUE_EDGES, ""), named)


def edge_key(text: Column) -> Column:
    """Key of a line at a page's edge: small letters, no punctuation, each number as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), r"\d+", "#"))


def title_key(name: Column) -> Column:
    """Key of a file name: without a trailing "(n)", word characters only."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\s*\(\d+\)\s*$", "")), r"[^\p{L}\p{N}]+", "")


def token_estimate(text: Column) -> Column:
    """Tokens of a text, roughly: a third of its ASCII characters, and its other bytes by 1.5."""
    ascii_count = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_count / 3 + (F.octet_length(text) - ascii_count) / 1.5)


# Patterns of identifiers.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
ARXIV_NEW = r"(?i)(?:arXiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}(?:v\d+)?)"
ARXIV_OLD = r"(?i)(?:arXiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)((?:astro-ph|cond-mat|cs|gr-qc|hep-ex|hep-lat|hep-ph|hep-th|math|math-ph|nlin|nucl-ex|nucl-th|physics|q-bio|quant-ph)/\d{7}(?:v\d+)?)"
PMID = r"(?i)\bPMID\s*:\s*(\d{5,10})\b"


def clean_doi(value: Column) -> Column:
    """A DOI in small letters, without resolver, "doi:", punctuation behind it and closing brackets that nothing opens."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi\s*:\s*", "")
    bare = F.regexp_replace(bare, r"[.,;:]+$", "")
    closing = F.length(F.regexp_extract(bare, r"\)+$", 0))
    surplus = F.length(F.regexp_replace(bare, r"[^)]", "")) - F.length(F.regexp_replace(bare, r"[^(]", ""))
    return F.lower(F.substring(bare, F.lit(1), F.length(bare) - F.greatest(F.lit(0), F.least(closing, surplus))))


def doi(text: Column) -> Column:
    """First DOI, cleaned; empty if there is none."""
    return clean_doi(F.regexp_extract(text, DOI, 0))


def arxiv_id(text: Column) -> Column:
    """First arXiv identifier of the new form, or else of the old one; empty if there is none."""
    new = F.regexp_extract(text, ARXIV_NEW, 1)
    return F.when(new != "", new).otherwise(F.regexp_extract(text, ARXIV_OLD, 1))


def pmid(text: Column) -> Column:
    """First PubMed number; empty if there is none."""
    return F.regexp_extract(text, PMID, 1)


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence or sentences that a span (end exclusive) stands in, of 10,000 characters at most; a Latin full stop needs white space behind it."""
    left = F.regexp_replace(F.substring(text, F.lit(1), start), r"(?s)^.*(?:[。！？]\s*|[.!?]\s+)", "")
    rest = F.substring(text, end + 1, F.length(text))
    tail = F.regexp_extract(rest, r"(?s)^.*?(?:[。！？]|[.!?](?:\s|\z))", 0)
    right = F.when(tail != "", tail).otherwise(rest)
    whole = F.concat(left, F.substring(text, start + 1, end - start), right)
    return F.substring(F.regexp_replace(whole, r"^\s+|\s+$", ""), 1, 10000)


# What opens an abstract and a list of key words.
_ABSTRACT, _KEYWORDS = r"(?:abstract|摘\s*要)", r"(?:index\s+terms?|key\s*words?|keywords?|关\s*键\s*词)"


def section_role(text: Column) -> Column:
    """`abstract-title`, `abstract-body` or `keywords` by how a block begins; empty for others."""
    value = F.trim(text)
    return (
        F.when(value.rlike(rf"(?i)^{_ABSTRACT}\s*(?:[:：.—-])?$"), "abstract-title").when(value.rlike(rf"(?i)^{_ABSTRACT}\s*[:：.—-]\s*\S"), "abstract-body").when(value.rlike(rf"(?i)^{_KEYWORDS}\s*[:：.—-]\s*\S"), "keywords").otherwise("")
    )


def year(text: Column, now: int) -> Column:
    """First year from 1800 to now + 2 that stands alone; null if there is none."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{4}(?!\d)"), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(1800, now + 2))
    return F.get(found, 0)


def join_hyphenated(left: Column, right: Column) -> Column:
    """Two parts of one paragraph: a hyphen at the break goes, otherwise a space comes between."""
    return F.when(left.endswith("-"), F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, F.lit(" "), right))


def fragmented(text: Column) -> Column:
    """Whether a text is broken into pieces: 24 words or more, 55 % of at most two letters, 25 % of one, and four short ones in a row."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    marks = F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 2, "s").otherwise("l")), "")
    return (F.size(words) >= 24) & (short >= 0.55 * F.size(words)) & (single >= 0.25 * F.size(words)) & F.contains(marks, F.lit("ssss"))


def strip_tags(html: Column) -> Column:
    """Text of HTML: script, style and tags taken out, the five basic entities decoded, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return clean(text)


def marker_score(text: Column, markers: list[str]) -> Column:
    """Occurrences of all markers in the lower-cased text."""
    low = F.lower(text)
    return sum((F.size(F.split(low, r"\Q" + m + r"\E", -1)) - 1 for m in markers), F.lit(0))


def without_thinking(text: Column) -> Column:
    """A model's answer without the reasoning block in front."""
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")


def placeholders(text: Column) -> Column:
    """Sorted multiset of the placeholders ⟦n⟧ and $n."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"⟦\d+⟧|\$\d+"), F.lit(0)))


#: A mark of emphasis in a text on its way through a model.
EMPHASIS = r"__(?:BOLD|COLOR)_(?:START|END)_\d+__"


def paired_emphasis(text: Column) -> Column:
    """The text without the marks of emphasis of which a model kept only the start or only the end."""
    marks = F.regexp_extract_all(text, F.lit(EMPHASIS), F.lit(0))

    def numbers(which: str) -> Column:
        return F.transform(F.filter(marks, lambda m: F.contains(m, F.lit(which))), lambda m: F.regexp_extract(m, r"(\d+)__$", 1))

    paired = F.array_intersect(numbers("_START_"), numbers("_END_"))
    kept = F.transform(marks, lambda m: F.when(F.array_contains(paired, F.regexp_extract(m, r"(\d+)__$", 1)), m).otherwise(""))
    return F.array_join(F.zip_with(F.split(text, EMPHASIS, -1), kept, lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")


def json_body(text: Column) -> Column:
    """The JSON of a model's answer: fenced, plain, or between the first and the last bracket; null if that is none."""
    value = F.trim(text)
    fenced = F.regexp_extract(value, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    inner = F.when(fenced != "", fenced).otherwise(value)
    between = F.regexp_extract(inner, r"(?s)[{\[].*[}\]]", 0)

    def valid(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(valid(inner), valid(F.when(between != "", between)))


# Names of languages and the codes that they stand for.
LANGUAGES = {
    "中文": "zh", "简体中文": "zh", "中文（简体）": "zh", "chinese": "zh", "zh-cn": "zh", "zh-hans": "zh", "繁体中文": "zh-hant", "zh-tw": "zh-hant",
    "english": "en", "英文": "en", "英语": "en", "日语": "ja", "japanese": "ja", "德语": "de", "german": "de", "法语": "fr", "french": "fr", "自动检测": "auto",
}


def language_code(code: Column, source: bool = False) -> Column:
    """Canonical language code; none stands for `zh`, or `auto` for a source; null if it is no code."""
    low = F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))
    low = F.when(F.coalesce(low, F.lit("")) == "", F.lit("auto" if source else "zh")).otherwise(low)
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), low), low)
    ok = known.rlike(r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})?$")
    return F.when((known == "auto") if source else F.lit(False), known).when(ok, known)


def utc_stamp(time: Column) -> Column:
    """A point in time as text of ISO 8601 in UTC, to the second: such texts sort as the times do."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
