"""What the findings of round 3 named."""

from pathlib import Path

import pytest

from quire.operators import graph
from quire.plans import catalogue

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def rows_of_sql(name, folder):
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con.sql(catalogue.oracle_sql()[name])


@needs_tables
def test_similar_pairs_are_all_pairs_to_the_last_digit(spark):
    """no threshold, and one rounding."""
    sql = rows_of_sql("similar_pairs", SF)
    got = catalogue.queries()["similar_pairs"](spark, SF).select(*sql.columns).collect()
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in got) == sorted((r[0], r[1], r[2], tuple(r[3])) for r in sql.fetchall())
    assert any(r[2] < 0.3 for r in got)


def test_similar_pairs_of_classes(spark, monkeypatch):
    """members of classes, more than lie in one row, and frequent tokens dealt out."""
    monkeypatch.setattr(graph, "_MEMBERS", 2)
    titles = ["same words here"] * 5 + ["other words there"] * 3 + [f"words number{i}" for i in range(80)] + ["alone"]
    papers = spark.createDataFrame([(i * 7 % 89, t.split()) for i, t in enumerate(titles)], "paper bigint, title array<string>")
    vectors = {r.paper: {x.token: x.u for x in r.vector} for r in graph.unit_vectors(papers).collect()}
    want = {}
    for a in vectors:
        for b in vectors:
            shared = {t: u * vectors[b][t] for t, u in vectors[a].items() if t in vectors[b]}
            if a < b and shared:
                want[a, b] = (round(sum(shared.values()), 6), sorted(shared, key=lambda t: (-round(shared[t], 9), t))[:5])
    for threshold in (0.0, 0.4):
        got = graph.similar_pairs(papers, threshold).collect()
        assert {(r.left, r.right): (r.score, r.tokens) for r in got} == {p: (pytest.approx(s, abs=2e-6), t) for p, (s, t) in want.items() if s >= threshold}
        assert len({(r.left, r.right) for r in got}) == len(got)


def test_intervals_with_unknown_ends(spark, tmp_path):
    """unknown places and quantities, as the SQL takes them."""
    rows = [(1, 5, None), (1, 7, 3.0), (1, 20, 2.0), (2, None, 4.0), (2, 3, 2.0), (2, 5, None), (2, 9, 1.0), (3, None, None), (None, 8, 1.0), (None, 9, 5.0), (4, 3, None), (4, 3, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/made")
    next(Path(f"{tmp_path}/made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    want = rows_of_sql("interval_merge", tmp_path).fetchall()
    got = [tuple(r) for r in catalogue.queries()["interval_merge"](spark, str(tmp_path)).select("page", "start", "end").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ratio_of_titles_that_meet_again_is_found_once(monkeypatch):
    """a title's ratio with another one is kept, in the order of the two."""
    import pandas as pd

    from quire.functions import vectors

    made, real = [], vectors.SequenceMatcher
    monkeypatch.setattr(vectors, "SequenceMatcher", lambda *x: made.append(x) or real(*x))
    a, b = ["tide", "diet", None, "x" * 500] * 50, ["diet", "tide", "x", "x" * 500] * 50
    got = vectors.title_ratio.func(pd.Series(a), pd.Series(b)).tolist()
    assert got[:2] == [round(real(None, x, y).ratio(), 6) for x, y in zip(a[:2], b[:2])] and got[3] == 1.0 and got[2] != got[2]
    assert len(made) == 2 + 50


def test_tables_without_tall_cells_are_not_laid_out(spark, monkeypatch):
    """only tables with cells that reach down, or without a width, go through Python."""
    from pyspark.sql import functions as F

    from quire.functions import vectors
    from quire.operators import tables

    kind = "table int, row int, idx int, text string, down int, across int"
    flat = [(t, r, i, "x", 1, 1 + (r == 0 and i == 1)) for t in range(3) for r in range(4) for i in range(2 + (r > 0))]
    odd = [(7, 0, 0, "x", 2, 1), (7, 0, 1, "x", 1, 1), (7, 1, 0, "x", 1, 1), (7, 1, 1, "x", 1, 2), (8, 0, 0, "x", 1, 1), (8, 0, 1, "x", 1, 0), (9, 0, 0, "x", 1, None), (9, 0, 1, "x", 1, 1)]
    assert {r.table: r.width for r in tables.widths(spark.createDataFrame(flat + odd, kind)).collect()} == {0: 3, 1: 3, 2: 3, 7: 2, 8: 1, 9: 2}
    laid = spark.sparkContext.accumulator(0)

    def count(cells):
        laid.add(1)
        return vectors.placed(cells)

    monkeypatch.setattr(vectors, "placed_cells", F.udf(count, vectors.placed_cells.returnType))
    assert {r.width for r in tables.widths(spark.createDataFrame(flat, kind)).collect()} == {3} and laid.value == 0


def test_spans_of_blocks_without_a_table(monkeypatch, spark):
    """a text that lacks words is aligned without a table, what is lost is found once for each block, and a word is one run of glyphs."""
    from pyspark.sql import functions as F

    from quire.functions import alignment
    from quire.operators import glyphs

    monkeypatch.setattr(alignment, "common_subsequence", lambda *x: pytest.fail("a table was made"))
    words = [f"Word{i * 7919 % 500} of final {i}" for i in range(200)]
    text, source = " ".join(words), " ".join(w for i, w in enumerate(words) if i % 17) + " "
    runs = alignment.aligned_runs(text, source)
    assert sum(n for _, _, n in runs) == len(source) - 1 and all(text[i : i + n] == source[j : j + n] for i, j, n in runs)
    rows = spark.createDataFrame([(1, "The final  12 ways")], "key int, text string").withColumn("glyphs", glyphs.glyph_runs(F.col("text"), F.array(F.lit(1))))
    assert [(g.text, g.styles) for g in rows.first().glyphs] == [("The ", ["bold"]), (" ", []), ("12 ", ["italic"]), ("ways ", [])]
    two = alignment.style_rows(["Bold", " x", ""], ["Bold ", "x", ""], [1, 1, 0], [5, 1], alignment.bits([["b"], ["i", "b"]], ["b", "i"]), ["b", "i"])
    assert [r["spans"] for r in two] == [[{"start": 0, "end": 4, "styles": ["b"]}], [], []] and [r["status"] for r in two] == ["unresolved", "unresolved", "unsupported"]
    many = [f"s{i}" for i in range(70)]
    assert alignment.style_spans("abc", [{"text": "abc", "styles": many}])["spans"][0]["styles"] == sorted(many)


def test_edges_from_lists_of_best_partners(spark, monkeypatch):
    """lists that are used up, blocks that meet in packed rows, and no pairs that go out."""
    import random

    draw = random.Random(5)
    titles = [[f"w{int(draw.paretovariate(0.7)) % 40}" for _ in range(draw.randint(1, 6))] for _ in range(150)]
    papers = spark.createDataFrame([(i * 7 % 151, t) for i, t in enumerate(titles)], "paper bigint, title array<string>")
    vectors = {r.paper: {x.token: x.u for x in r.vector} for r in graph.unit_vectors(papers).collect()}
    pairs = [(round(sum(u * vectors[b].get(t, 0.0) for t, u in vectors[a].items()), 9), a, b) for a in vectors for b in vectors if a < b]
    room, want = dict.fromkeys(vectors, 2), set()
    for s, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if s > 0 and room[a] and room[b]:
            room[a], room[b] = room[a] - 1, room[b] - 1
            want.add((a, b))
    monkeypatch.setattr(graph, "_PAIRS", 3)
    monkeypatch.setattr(graph, "_SMALL", 50)
    monkeypatch.setattr(graph, "cosine_pairs", lambda *x: pytest.fail("pairs went out"))
    got = [(r.left, r.right) for r in graph.similarity_edges(papers).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_postings_are_made_without_a_shuffle(spark, capsys):
    """F7 to F10: no occurrence of a token is shuffled, and no table of tokens is written beside the segment."""
    from quire.operators import search_index

    rows = [("1", "notes", "a", 3, ["x", "y", "x"]), ("1", "notes", "b", 0, []), ("2", "content", "c", None, None), ("2", "content", "d", 1, ["y"])]
    made = search_index._postings_of(spark.createDataFrame(rows, "job_id string, kind string, source_id string, size int, tokens array<string>"))
    assert sorted((r.token, r.job_id, r.kind, r.source_id, r["size"], tuple(r.places)) for r in made.collect()) == [("x", "1", "notes", "a", 3, (0, 2)), ("y", "1", "notes", "a", 3, (1,)), ("y", "2", "content", "d", 1, (0,))]
    made.explain()
    assert "Exchange" not in capsys.readouterr().out
