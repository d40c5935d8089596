"""The retrieval ladder: which records count as an item's."""

import pytest

from quire.operators import bibliography as bib


def test_records_with_like_titles_count(spark):
    item = "id int, title string, doi string, arxiv string, pmid string, authors array<string>, title_source string, title_confidence double"
    long = "Learning to rank documents with deep neural networks"
    items = [
        (1, long, "10.1/1", None, None, ["Ann Lee"], "layout", 0.9),  # a subtitle more
        (2, long, "10.1/2", None, None, ["Ann Lee"], "layout", 0.9),  # another work
        (3, "scan0001", "10.1/3", None, None, [], "filename", 0.9),  # a file's name proves nothing
        (4, "Foo bar", "10.1/4", None, None, [], "layout", 0.3),  # nor does a title of little confidence
        (5, long, "10.1/5", None, None, ["Ann Lee 1", "Bo Chen"], "layout", 0.9),  # like title, other authors
        (6, long, "10.1/6", None, None, ["Ann Lee 1", "Bo Chen"], "layout", 0.9),  # like title, one author shared
        (7, long.upper() + ".", "10.1/7", None, None, ["X Y"], "layout", 0.9),  # the same title: authors aren't asked
        (8, None, "10.1/8", None, None, None, None, None), (9, long, None, None, None, None, None, 0.9), (10, None, None, None, None, None, None, None),
    ]
    other = "Learning to rank documents with deep forests"
    records = [("10.1/1", f"{long}: a survey", "10.1/1", ["Lee, A. Lee"]), ("10.1/2", "Soil chemistry of alpine lakes", "10.1/2", []), ("10.1/3", long, "10.1/3", []), ("10.1/4", long, "10.1/4", []), ("10.1/5", other, "10.1/5", ["Carl Doe"]), ("10.1/6", other, "10.1/6", ["B. CHEN"]), ("10.1/7", long, "10.1/7", ["Carl Doe"]), ("10.1/8", "Anything", "10.1/8", [])]
    rung = "key string, title string, doi string, authors array<string>"
    none = spark.createDataFrame([], rung)
    found = spark.createDataFrame([(9, long, "10.9/9", 0.95)], "id int, title string, doi string, confidence double")
    got = {r.id: (r.provider, r.status, r.doi) for r in bib.ladder(spark.createDataFrame(items, item), spark.createDataFrame(records, rung), none, none, found).collect()}
    taken = {i: ("doi", "complete", f"10.1/{i}") for i in (1, 3, 4, 6, 7, 8)}
    assert got == taken | {2: (None, "local", None), 5: (None, "local", None), 9: ("search", "complete", "10.9/9"), 10: (None, "failed", None)}


@pytest.mark.parametrize("a,b,want", [(["Ann Lee"], ["B Lee"], 1.0), (["Ann Lee 2", "Bo Chen"], ["Chen"], 1.0), (["Ann Lee"], ["Bo Chen"], 0.0), ([], ["X"], 0.0), (["12"], ["12"], 0.0)])
def test_shared_authors(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(bib.shared_authors(bib.surnames("a"), bib.surnames("b")).alias("x")).first()
    assert row.x == want
