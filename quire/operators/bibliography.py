"""Bibliographic records of several providers in one form, and the ladder that picks one for an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors

FIELDS = ("title", "doi", "venue", "authors", "year")
_DATE = "struct<`date-parts`:array<array<int>>>"
_PERSON = "struct<given:string,family:string>"


def _names(people: Column) -> Column:
    return F.coalesce(F.transform(people, lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), F.array().cast("array<string>"))


def _record(title: Column, doi: Column, venue: Column, authors: Column, year: Column) -> Column:
    return F.struct(title.alias("title"), doi.alias("doi"), venue.alias("venue"), authors.alias("authors"), year.cast("int").alias("year"))


def _cleaned(r: Column) -> Column:
    """A record without tags, doubled white space and empty fields."""
    texts = F.transform(F.array(r["title"], r["venue"]), lambda x: F.nullif(T.clean(F.regexp_replace(F.coalesce(x, F.lit("")), r"<[^>]+>", "")), F.lit("")))
    return F.struct(F.get(texts, 0).alias("title"), F.nullif(T.clean_doi(F.coalesce(r["doi"], F.lit(""))), F.lit("")).alias("doi"), F.get(texts, 1).alias("venue"), r["authors"].alias("authors"), r["year"].alias("year"))


def _crossref(payload: Column) -> Column:
    m = F.from_json(payload, f"struct<message:struct<title:array<string>,DOI:string,`container-title`:array<string>,author:array<{_PERSON}>,issued:{_DATE}>>")["message"]
    return _record(F.get(m["title"], 0), m["DOI"], F.get(m["container-title"], 0), _names(m["author"]), F.get(F.get(m["issued"]["date-parts"], 0), 0))


def _csl(payload: Column) -> Column:
    m = F.from_json(payload, f"struct<title:string,DOI:string,`container-title`:string,author:array<{_PERSON}>,issued:{_DATE}>")
    return _record(m["title"], m["DOI"], m["container-title"], _names(m["author"]), F.get(F.get(m["issued"]["date-parts"], 0), 0))


def _datacite(payload: Column) -> Column:
    m = F.from_json(payload, "struct<data:struct<attributes:struct<titles:array<struct<title:string>>,doi:string,publisher:string,creators:array<struct<givenName:string,familyName:string>>,publicationYear:int>>>")["data"]["attributes"]
    people = F.transform(m["creators"], lambda a: F.struct(a["givenName"].alias("given"), a["familyName"].alias("family")))
    return _record(F.get(m["titles"], 0)["title"], m["doi"], m["publisher"], _names(people), m["publicationYear"])


def _pubmed(payload: Column) -> Column:
    m = F.from_json(payload, "struct<title:string,fulljournalname:string,pubdate:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>>")
    doi = F.get(F.filter(m["articleids"], lambda x: x["idtype"] == "doi"), 0)["value"]
    names = F.coalesce(F.transform(m["authors"], lambda a: F.trim(a["name"])), F.array().cast("array<string>"))
    return _record(F.regexp_replace(m["title"], r"\.$", ""), doi, m["fulljournalname"], names, F.nullif(F.regexp_extract(m["pubdate"], r"\d{4}", 0), F.lit("")))


def _arxiv(payload: Column) -> Column:
    entry = F.regexp_replace(payload, r"<(/?)\w+:", "<$1")

    def text(path: str) -> Column:
        return F.nullif(F.xpath_string(entry, F.lit(f"/feed/entry/{path}")), F.lit(""))

    return _record(text("title"), text("doi"), F.coalesce(text("journal_ref"), F.lit("arXiv")), F.xpath(entry, F.lit("/feed/entry/author/name/text()")), F.nullif(F.substring(text("published"), 1, 4), F.lit("")))


PROVIDERS = {"crossref": _crossref, "doi": _csl, "datacite": _datacite, "pubmed": _pubmed, "arxiv": _arxiv}


def provider_fields(provider: Column, payload: Column) -> Column:
    """struct<title, doi, venue, authors, year> of a provider's answer; null fields where it has none."""
    raw = reduce(lambda out, x: out.when(provider == x[0], x[1](payload)), list(PROVIDERS.items())[1:], F.when(provider == "crossref", _crossref(payload)))
    return T.let(raw, _cleaned)


#: Least likeness of titles; up to the second one the authors are asked as well, of whom so many have to be shared. Titles of less confidence than the last prove nothing.
TITLE, SURE_TITLE, AUTHORS, CONFIDENCE = 0.76, 0.9, 0.15, 0.55


def surnames(names: Column) -> Column:
    """The last word of letters of each name, compatible and case folded, each once."""
    last = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.try_element_at(F.regexp_extract_all(T.canonical(n), F.lit(r"\p{L}+"), F.lit(0)), F.lit(-1)))
    return F.array_distinct(F.array_compact(F.transform(last, lambda x: F.nullif(x, F.lit("")))))


def shared_authors(a: Column, b: Column) -> Column:
    """Share of the shorter list that both have; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def consistent(plain: Column, other: Column, authors: Column, other_authors: Column, loose: Column) -> Column:
    """Whether a record that an identifier gives is the item's: its title is like the item's, or either has none, or the item's (`loose`) proves nothing."""
    like = vectors.title_ratio(plain, other)
    own, theirs = surnames(authors), surnames(other_authors)
    doubted = (F.size(own) > 0) & (F.size(theirs) > 0) & (like < SURE_TITLE) & (shared_authors(own, theirs) < AUTHORS)
    return (plain == "") | (other == "") | loose | ((like >= TITLE) & ~doubted)


def ladder(items: DataFrame, by_doi: DataFrame, by_arxiv: DataFrame, by_pmid: DataFrame, found: DataFrame, safe: float = 0.92) -> DataFrame:
    """`items` (id, title, doi, arxiv, pmid) with what the first trustworthy rung gives: (id, provider, status, title, doi).

    The rungs are tables of (key, title, doi), one record a key, and `found` has (id, title, doi,
    confidence) from a search; items and rungs can have `authors` (array), and items `title_source`
    and `title_confidence`. A record counts if its title is like the item's (0.76 of both in matching
    blocks) and, below 0.9, not by other authors; a title from a file's name, or of little
    confidence, is not held against it. Else its identifier is dropped. The DOI that an arXiv or PubMed
    record gives is followed. `complete` from a rung, or from a search hit of at least `safe`;
    `needs-review` with a lesser hit; `local` with any field of its own; else `failed`.
    """

    def keyed(table: DataFrame) -> DataFrame:
        if "authors" not in table.columns:
            table = table.withColumn("authors", F.array().cast("array<string>"))
        words = F.regexp_replace(T.canonical(F.col("title")), r"[^\p{L}\p{N}]+", " ")
        return table.withColumn("plain", F.coalesce(F.trim(words), F.lit("")))

    loose = F.lit(False)
    if "title_source" in items.columns:
        loose = loose | F.coalesce(F.col("title_source") == "filename", F.lit(False))
    if "title_confidence" in items.columns:
        loose = loose | (F.coalesce("title_confidence", F.lit(0.0)) < CONFIDENCE)

    def agrees(x: str) -> Column:
        return F.col(f"{x}_title").isNotNull() & consistent(F.col("plain"), F.col(f"{x}_plain"), F.col("authors"), F.col(f"{x}_authors"), F.col("loose"))

    by_doi, by_arxiv, by_pmid, out = map(keyed, (by_doi, by_arxiv, by_pmid, items.withColumn("loose", loose)))
    for name, table, key in (("d", by_doi, T.clean_doi(F.coalesce("doi", F.lit("")))), ("a", by_arxiv, F.col("arxiv")), ("p", by_pmid, F.col("pmid"))):
        out = out.withColumn(f"{name}_key", key).join(table.select(F.col("key").alias(f"{name}_key"), F.col("title").alias(f"{name}_title"), F.col("doi").alias(f"{name}_doi"), F.col("plain").alias(f"{name}_plain"), F.col("authors").alias(f"{name}_authors")), f"{name}_key", "left")
        out = out.withColumn(f"{name}_ok", agrees(name))
    rung = F.when(F.col("d_ok"), "doi").when(F.col("a_ok"), "arxiv").when(F.col("p_ok"), "pubmed")
    out = out.withColumn("rung", rung).withColumn("next", F.when(F.col("rung") == "arxiv", T.clean_doi(F.coalesce("a_doi", F.lit("")))).when(F.col("rung") == "pubmed", T.clean_doi(F.coalesce("p_doi", F.lit("")))))
    follow = by_doi.select(F.col("key").alias("next"), F.col("title").alias("n_title"), F.col("doi").alias("n_doi"), F.col("plain").alias("n_plain"), F.col("authors").alias("n_authors"))
    out = out.join(follow, "next", "left").withColumn("n_ok", (F.col("next") != F.col("d_key")) & agrees("n"))
    best = found.groupBy("id").agg(F.max_by(F.struct("title", "doi", "confidence"), F.struct("confidence", "doi")).alias("hit"))
    out = out.join(best, "id", "left")
    by_search = F.col("rung").isNull() & (F.col("hit.confidence") >= safe)
    own = (F.col("plain") != "") | (F.col("d_key") != "") | (F.coalesce("arxiv", F.lit("")) != "") | (F.coalesce("pmid", F.lit("")) != "")
    status = F.when(F.col("rung").isNotNull() | F.coalesce(by_search, F.lit(False)), "complete").when(F.col("hit").isNotNull(), "needs-review").when(own, "local").otherwise("failed")
    provider = F.when(F.col("n_ok"), F.concat("rung", F.lit("+doi"))).when(F.col("rung").isNotNull(), F.col("rung")).when(by_search, "search")
    remote = F.when(F.col("rung") == "doi", F.struct(F.col("d_title").alias("title"), F.col("d_doi").alias("doi"))).when(F.col("n_ok"), F.struct(F.col("n_title").alias("title"), F.col("n_doi").alias("doi")))
    remote = remote.when(F.col("rung") == "arxiv", F.struct(F.col("a_title").alias("title"), F.col("a_doi").alias("doi"))).when(F.col("rung") == "pubmed", F.struct(F.col("p_title").alias("title"), F.col("p_doi").alias("doi"))).when(by_search, F.struct(F.col("hit.title").alias("title"), F.col("hit.doi").alias("doi")))
    kept_doi = F.when(~F.coalesce("d_ok", F.lit(False)) & F.col("d_title").isNotNull(), F.lit("")).otherwise(F.col("d_key"))  # a DOI of another work is dropped
    out = out.withColumn("remote", remote).withColumn("status", status).withColumn("provider", provider)
    return out.select("id", "provider", "status", F.coalesce("remote.title", "title").alias("title"), F.nullif(F.coalesce(T.clean_doi(F.col("remote.doi")), kept_doi), F.lit("")).alias("doi"))
