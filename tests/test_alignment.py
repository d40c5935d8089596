"""Alignment against the quadratic table, and styles against plain Python."""

import random

from pyspark.sql import functions as F

from quire.functions import alignment
from quire.operators import glyphs


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_is_a_longest_one():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcd "[: draw.randint(1, 5)]) for _ in range(draw.randint(0, 40))) for _ in range(2))
        for find in (alignment.common_subsequence, alignment.aligned):
            pairs = find(a, b)
            assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_anchors_divide_long_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", 2500)
    draw = random.Random(3)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    other = list(text)
    for _ in range(60):
        other[draw.randrange(len(other))] = draw.choice(["", "z", "xx"])
    other = "".join(other)
    pairs = alignment.aligned(text, other)
    assert all(text[i] == other[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) >= 0.995 * longest(text, other)
    assert len(alignment.aligned("a" * 3000, "a" * 100 + "b" * 3000)) >= 100


def test_long_texts_take_little_time():
    text = " ".join(f"word{i * 7919 % 5000}" for i in range(40_000))
    assert len(alignment.aligned(text, text[:90_000] + "#" + text[90_500:])) == len(text) - 500


def test_spans_follow_the_glyphs():
    def of(text, style):
        return [{"text": c, "styles": style} for c in text]

    got = alignment.style_spans("A ﬁne bold word here", of("A ", []) + of("fine bold", ["bold"]) + of(" word ", []) + of("here", ["italic", "bold"]))
    assert got["status"] == "confirmed" and got["spans"] == [{"start": 2, "end": 10, "styles": ["bold"]}, {"start": 16, "end": 20, "styles": ["bold", "italic"]}]
    assert alignment.style_spans("abc", [])["status"] == "unsupported" and alignment.style_spans("abcdefgh", of("xyz", ["bold"]))["spans"] == []
    part = alignment.style_spans("one two", of("one two three", ["bold"]))
    assert part["status"] == "unresolved" and part["spans"] == [{"start": 0, "end": 7, "styles": ["bold"]}]
    assert alignment.style_spans("one two", of("one two", ["bold"]), [(0, 3)])["spans"] == [{"start": 4, "end": 7, "styles": ["bold"]}]


def test_rows_of_texts_and_glyphs(spark):
    rows = spark.createDataFrame([(1, "The final 12 ways"), (2, None), (3, "")], "key int, text string").withColumn("glyphs", glyphs.glyph_runs(F.col("text")))
    got = {r.key: r for r in glyphs.styled(rows, ["key"]).collect()}
    assert [(s.start, s.end, s.styles) for s in got[1].spans] == [(0, 3, ["bold"]), (10, 12, ["italic"])] and got[1].matched == 17
    assert got[2].matched == 0 and got[2].status == "unsupported" and got[3].target_chars == 0
    assert glyphs.styled(rows.limit(0), ["key"]).count() == 0


def test_query_equals_plain_python(spark):
    """Each block by itself: what is lost are whole words, so that all that is left can be matched."""
    from quire.plans.glyphs import style_spans, with_glyphs

    sf = "/root/testdata/sf0.001"
    given = {(r.doc_id, r.pos): r for r in with_glyphs(spark, sf).collect()}
    got = style_spans(spark, sf).collect()
    assert len(got) == len(given) > 200
    for r in got:
        row = given[r.doc_id, r.pos]
        target, source = alignment._plain(row.text)[0], alignment._plain("".join(g.text for g in row.glyphs))[0]
        assert (r.target_chars, r.source_chars) == (len(target), len(source)) and r.matched >= len(source) - 1
        if len(target) < 400:
            assert r.matched == longest(target, source)
    assert sum("bold" in r.spans for r in got) > 100
