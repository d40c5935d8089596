"""Queries against their SQL on the smallest tables, and the functions that SQL has no form for against plain Python."""

import glob
import os
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.engine import Engine
from quire.functions import text as T
from quire.functions import vectors
from quire.operators import graph, layout, library, merge, reader, search, state
from quire.plans import catalogue, graphs
from quire.sources.json_files import assets, formula_files, replace_version, tolerant_json, with_fallback

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(value):
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(x) for x in value])
    if value is None or value is pd.NA or value != value:
        return "null"
    return f"{float(value):.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False))


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def folded_terms(duck):
    import hashlib
    import unicodedata

    return {(i, hashlib.sha256(" ".join(unicodedata.normalize("NFKC", t).casefold().split()).encode()).hexdigest()) for i, t in duck.sql("select doc_id, text from documents").fetchall()}


def matched_records(duck):
    part = duck.sql("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part order by 1").fetchall()
    pairs = ((a, b) for i, a in enumerate(part) for b in part[i + 1 :] if a[2:5] == b[2:5])
    return {(a[0], b[0], round(0.72 * round(SequenceMatcher(None, a[1], b[1]).ratio(), 6) + 0.20 + (0.08 if abs(a[5] - b[5]) <= 100 else 0), 6)) for a, b in pairs}


def filled_batches(duck):
    out = set()
    for i, text in duck.sql("select doc_id, text from documents").fetchall():
        batches = [[]]
        for pos, line in enumerate(text.split("\n")):
            rest, part = line.strip(" "), 0
            while rest:
                head = rest
                if len(rest) > 4000:
                    ends = [rest.rfind(x, 0, 4000) + 1 for x in (". ", "! ", "? ", "。", "\n")]
                    head = rest[: max(ends) if max(ends) > 2000 else 4000]
                if len(batches[-1]) == 16 or (batches[-1] and sum(n for _, _, n in batches[-1]) + len(head) > 5000):
                    batches.append([])
                batches[-1].append((pos, part, len(head)))
                rest, part = rest[len(head) :], part + 1
        out |= {(i, b, *x) for b, batch in enumerate(batches) for x in batch}
    return out


def greedy_edges(duck):
    pairs = duck.sql(graphs.SCORES_SQL).fetchall()
    degree, out = {}, set()
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if max(degree.get(a, 0), degree.get(b, 0)) < 2:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            out.add((a, b, round(score, 6)))
    return out


def laid_out_cells(duck):
    """Cells put into a grid of taken places, one by one."""
    tables = {}
    for order, line, quantity, part in duck.sql("select l_orderkey, l_linenumber, l_quantity, l_partkey from lineitem").fetchall():
        tables.setdefault(order, []).append(((line - 1) // 3, line, int(quantity) % 2 + 1, part % 2 + 1))
    out = []
    for order, cells in tables.items():
        taken, at, before = set(), 0, None
        for row, _, down, across in sorted(cells):
            at = 0 if row != before else at
            before = row
            while (row, at) in taken:
                at += 1
            own = [(row + r, at + c) for r in range(down) for c in range(across)]
            out.append((order, row, at, down, across, any((row, c) in taken for _, c in own)))
            taken.update(own)
            at += across
    return sorted(out)


def spread_blocks(duck):
    """Blocks in the order first, last, and the middles of ever smaller gaps, as long as they fit."""
    out = set()
    for doc, text in duck.sql("select doc_id, text from documents where text is not null").fetchall():
        own = [(i, line.strip(" ")) for i, line in enumerate(text.split("\n")) if line.strip(" ")]
        order, gaps = [0, len(own) - 1] if len(own) > 1 else [0][: len(own)], [(0, len(own) - 1)]
        while gaps:
            below = []
            for a, b in gaps:
                if b - a > 1:
                    order.append((a + b) // 2)
                    below += [(a, (a + b) // 2), ((a + b) // 2, b)]
            gaps = below
        left, every = 1500, sum(len(t) for _, t in own) <= 1500
        for k in order:
            if every or len(own[k][1]) <= left:
                left -= len(own[k][1])
                out.add((doc, own[k][0]))
    return out


PLAINLY = {"table_layout": (laid_out_cells, ("l_orderkey", "row", "col", "down", "across", "overlaps")), "evidence_sample": (spread_blocks, ("doc_id", "pos")), "term_fold": (folded_terms, ("doc_id", "key")), "record_match": (matched_records, ("l_key", "r_key", "confidence")), "micro_batches": (filled_batches, ("doc_id", "batch", "pos", "part", "chars")), "similarity_edges": (greedy_edges, ("left", "right", "score"))}


@needs_tables
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).collect()
    if name not in PLAINLY:  # its functions are tested by themselves
        assert got
        return
    want, columns = PLAINLY[name]
    rows_ = [tuple(r[c] for c in columns) for r in got]
    want = want(duck)
    assert sorted(rows_) == want if isinstance(want, list) else set(rows_) == want


# a library's graph


def test_greedy_edges_equal_the_sequential_choice(spark):
    x, pairs = 7, []
    for a in range(14):
        for b in range(a + 1, 14):
            x = (x * 1103515245 + 12345) % (1 << 31)
            if x % 3:
                pairs.append((a, b, (x >> 8) % 6 / 6))
    degree, want = {}, set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if degree.get(a, 0) < 2 and degree.get(b, 0) < 2:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            want.add((a, b, s))
    df = spark.createDataFrame(pairs, "left int, right int, score double")
    assert {tuple(r) for r in graph.capped_edges(df, 2).collect()} == want


def test_tokens_and_venues(spark):
    df = spark.createDataFrame([("The 大模型研究 of GPT-4 in 2023", "2023 IEEE/CVF Conference on Computer Vision and Pattern Recognition (CVPR)"), ("", "Proceedings of the 5th Workshop on Things (WoT), 2021"), (None, None)], "t string, v string")
    got = df.select(T.topic_tokens(F.col("t")).alias("k"), T.venue(F.col("v")).alias("v")).collect()
    assert got[0].k == ["gpt-4", "大模", "模型", "型研", "研究"] and got[0].v == "CVPR" and got[1].k == [] and got[1].v == "WoT"


# search


def test_search_reads_words_as_phrases(spark):
    data = [("p", "content", "c1", "Base English attention 中文深度学习"), ("p", "notes", "n1", "自己的读书笔记 neural insight café"), ("p", "annotations", "a1", "highlight evidence 异常指标"), ("p", "metadata", "m1", "Synthetic metadata title"), ("q", "content", "c2", "other words here")]
    src = spark.createDataFrame(data, "job_id string, kind string, source_id string, text string")

    def hits(q, **more):
        return [r.source_id for r in search.search(src, q, **more).collect()]

    assert hits("attention") == hits("深度学习") == ["c1"] and hits("读书笔记") == hits("cafe") == ["n1"] and hits("异常指标") == ["a1"]
    assert hits("深学习") == [] and hits('" OR *') == [] and len(hits("")) == 5 and hits("neural-insight") == ["n1"] and hits("attention", kinds=["notes"]) == []
    with pytest.raises(ValueError, match="limit"):
        search.search(src, "x", limit=0)
    with pytest.raises(PermissionError):
        search.allowed_kinds(["read:notes"], ["content"])
    engine = Engine(spark, sources=src, scopes=["read:content"])
    assert [r.source_id for r in engine.call("search_library", query="attention").collect()] == ["c1"]
    with pytest.raises(ValueError, match="no capability"):
        engine.call("nothing")


def test_a_kept_index_answers_as_a_scan_does(spark):
    from quire.operators.search_index import SearchIndex

    kind = "job_id string, kind string, source_id string, text string"
    data = [(str(i % 4), ("content", "notes", "metadata")[i % 3], f"s{i}", t) for i, t in enumerate(["the cat and the dog", "The Cat café", "dog dog dog", "", "cat 猫和狗 the cat the", "and the", None, "Việt Nam the cat"])]
    index = SearchIndex(spark, fan=3)
    assert index.current() is None

    def same(rows):
        src = spark.createDataFrame(rows, kind)
        for q, args in (("the cat", {}), ("the-cat", {}), ("dog", {"kinds": ["content"]}), ("猫和", {}), ("viet", {}), ("", {}), ("nothing", {}), ("the", {"limit": 2, "offset": 1}), ("cat", {"folder_items": spark.createDataFrame([("0",)], "job_id string")})):
            assert index.search(q, **args).collect() == search.search(src, q, **args).collect(), q

    assert index.refresh(spark.createDataFrame(data, kind)) == {"insert": 8, "update": 0, "delete": 0, "keep": 0}
    same(data)
    assert index.refresh(spark.createDataFrame(data, kind)) == {"insert": 0, "update": 0, "delete": 0, "keep": 8} and index.current().generation == 1
    changed = [(*data[0][:3], "a bird and the cat"), *data[2:], ("9", "notes", "s99", "the cat again")]
    assert index.refresh(spark.createDataFrame(changed, kind)) == {"insert": 1, "update": 1, "delete": 1, "keep": 6}
    same(changed)
    assert SearchIndex(spark, index.path).search("bird").count() == 1


def test_scores_follow_the_formula(spark):
    import math

    data = [(str(i), "content", f"c{i}", t) for i, t in enumerate(["a b c", "a a b", "c c c c", "d e f g h i"])]
    got = {r.source_id: r.score for r in search.search(spark.createDataFrame(data, "job_id string, kind string, source_id string, text string"), "c").collect()}
    n, df, mean = 4, 2, 16 / 4
    idf = math.log((n - df + 0.5) / (df + 0.5)) or 1e-6
    want = {f"c{i}": -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) for i, tf, size in ((0, 1, 3), (2, 4, 4))}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


# merges


def test_winner_and_locks(spark):
    cur = spark.createDataFrame([("r", "title", "old", 0.5, False), ("r", "venue", "kept", 0.5, True), ("r", "year", "2020", 0.9, False)], "record string, field string, value string, confidence double, locked boolean")
    new = spark.createDataFrame([("r", "title", "new", 0.5), ("r", "venue", "no", 0.9), ("r", "year", "2021", 0.8), ("r", "doi", "10.1/x", 0.3)], "record string, field string, value string, confidence double")
    assert {(r.field, r.value) for r in merge.merged_fields(cur, new).collect()} == {("title", "new"), ("venue", "kept"), ("year", "2020"), ("doi", "10.1/x")}


def test_quotes_anchor_when_unique(spark):
    quotes = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "shared words in two of them"), (3, "not there at all ever"), (4, "zeta"), (5, "")], "quote_id int, quote string")
    texts = spark.createDataFrame([(10, "x alpha beta gamma delta epsilon y"), (11, "shared words in two of them. zeta"), (12, "also shared words in two of them")], "place int, text string")
    assert {r.quote_id: (r.n, r.place) for r in merge.anchored(quotes, texts).collect()} == {1: (1, 10), 2: (2, None), 3: (0, None), 4: (1, 11), 5: (0, None)}
    inside = spark.createDataFrame([(10, "see (two plain words here) and 这是引用的一句话。"), (11, "ends plain words"), (12, "x")], "place int, text string")
    asked = ["two plain words here", "plain words", "引用的", "plain", "no such words here", "(two", "x", "two plain words"]
    got = {r.quote_id: (r.n, r.place) for r in merge.anchored(spark.createDataFrame(list(enumerate(asked)), "quote_id int, quote string"), inside).collect()}
    want = {i: [p for p, t in ((10, "see (two plain words here) and 这是引用的一句话。"), (11, "ends plain words"), (12, "x")) if q in t] for i, q in enumerate(asked)}
    assert got == {i: (len(p), p[0] if len(p) == 1 else None) for i, p in want.items()}


# layout


def test_two_columns_read_left_first(spark):
    boxes = [(1, 1, 10, 10, 600, 40), (1, 2, 10, 60, 280, 90), (1, 3, 320, 50, 600, 80), (1, 4, 10, 100, 280, 130), (1, 5, 320, 110, 600, 140), (1, 6, 10, 200, 600, 240), (1, 7, 10, 250, 280, 280)]
    df = spark.createDataFrame(boxes, "page bigint, idx int, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    assert [r.idx for r in layout.reading_order(df, 610).orderBy("reading_order").collect()] == [1, 2, 4, 3, 5, 6, 7]
    groups = {r.idx: r.group for r in layout.box_groups(df, 12).collect()}
    assert groups[2] == groups[4] and groups[3] != groups[2] and len(groups) == 7


def test_hyphens_join(spark):
    df = spark.createDataFrame([(1, 0, "a para-"), (1, 1, "graph goes on"), (1, 2, "to its end."), (1, 3, "next one")], "doc int, pos int, text string")
    assert [r.text for r in layout.merged_runs(df, "doc", "pos").orderBy("pos").collect()] == ["a paragraph goes on to its end.", "next one"]


# functions without SQL


def test_python_functions():
    assert vectors.spread_order(9)[:5] == [0, 8, 4, 2, 6] and sorted(vectors.spread_order(23)) == list(range(23)) and vectors.spread_order(0) == [] and vectors.spread_order(1) == [0]


def covered_places(cells):
    """Places by marking every covered one: the plain way."""
    taken, out, at, line = {}, [], 0, None
    for cell in cells:
        at, line = (at if cell["row"] == line else 0), cell["row"]
        while (line, at) in taken:
            at += 1
        places = [(line + i, at + j) for i in range(cell["down"]) for j in range(cell["across"])]
        out.append((line, at, any(x in taken for x in places)))
        taken.update(dict.fromkeys(places))
        at += cell["across"]
    return out


def test_table_cells_are_placed():
    import random

    rng = random.Random(1)
    for _ in range(300):
        cells = sorted(({"row": rng.randint(0, 4), "down": rng.choice((1, 1, 2, 3)), "across": rng.choice((1, 1, 2, 3))} for _ in range(rng.randint(0, 12))), key=lambda c: c["row"])
        assert [(c["row"], c["col"], c["overlaps"]) for c in vectors.placed(cells)] == covered_places(cells)
    assert vectors.placed(None) == []


def test_messages_give_way_in_order(spark):
    def tokens(t):
        n = sum(x < "\x80" for x in t)
        return math.ceil(n / 3 + (len(t.encode()) - n) / 1.5)

    def plain(rows, limit):
        left = {seq: text for seq, text, _, _ in rows}

        def total():
            return 8 + sum(8 + tokens(t) for t in left.values())

        for which in (2, 3):
            for r in sorted((r for r in rows if r[which] is not None), key=lambda r: r[which]):
                if total() > limit:
                    text, left[r[0]] = left[r[0]], ""
                    if which == 3:
                        left[r[0]] = max((text[:k] for k in range(len(text) + 1) if total() + tokens(text[:k]) <= limit), key=len, default="")
        over = 8 + sum(8 + tokens(t) for t in left.values() if t) <= limit
        return {(seq, t, over) for seq, t in left.items() if t}

    import math
    import random

    rng = random.Random(2)
    for limit in (40, 90, 200):
        rows = [(i, "ab é 漢字 word"[: rng.randint(0, 13)] * rng.randint(0, 14), rng.choice((None, 9 - i)), rng.choice((None, i))) for i in range(7)]
        rows = [(a, b, c, d if c is None else None) for a, b, c, d in rows]
        df = spark.createDataFrame([("k", *r) for r in rows], "key string, seq int, text string, removable int, truncatable int")
        assert {(r.seq, r.text, r.fits) for r in reader.fitted(df, "key", limit).collect()} == plain(rows, limit)


def test_paragraphs_join_over_pages_and_figures(spark):
    box = "struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>"
    fig = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    low, high = (1, 0.1, 0.6, 0.9, 0.9, "goes on and"), (2, 0.1, 0.1, 0.9, 0.3, "ends in this line")
    cases = [
        (low, high, [], True), (low, (*high[:5], "Starts anew"), [], False), ((*low[:5], "is over."), high, [], False), ((*low[:4], 0.7, low[5]), high, [], False), (low, (3, *high[1:]), [], False),
        ((*low[:5], "Figure 3 shows"), high, [], False), (low, (2, 0.1, 0.4, 0.9, 0.6, high[5]), [(2, 0.1, 0.05, 0.9, 0.38)], True), (low, (2, 0.1, 0.6, 0.9, 0.8, high[5]), [(2, 0.1, 0.05, 0.9, 0.38)], False),
        ((1, 0.1, 0.1, 0.9, 0.3, "goes on and"), (1, 0.1, 0.6, 0.9, 0.8, "ends here"), [(1, 0.1, 0.32, 0.9, 0.55)], True), ((1, 0.1, 0.1, 0.9, 0.3, "goes on and"), (1, 0.1, 0.6, 0.9, 0.8, "ends here"), [], False),
        ((1, 0.52, 0.6, 0.95, 0.9, "goes on"), (2, 0.05, 0.1, 0.48, 0.3, "in the left column"), [], True), ((1, 0.1, 0.9, 0.9, 1.2, "x"), high, [], False), (low, high, [(2, 0.1, 0.05, 0.9, 0.09), (1, 0.1, 0.91, 0.9, 0.95)], False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, a {box}, b {box}, figures {fig}, want boolean")
    assert [r.i for r in reader.paragraphs_join(df).filter("joins <> want").collect()] == []


def test_texts_in_other_forms(spark):
    import unicodedata

    texts = ["Ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ﬂow", "e\u0301te\u0301", "plain", "", "a\u00a0b", "𝐀𝐛𝟏", "Việt Nam", "İstanbul", "½ ℃"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.clean(F.col("t"))).collect()]
    assert got[:9] == [" ".join(unicodedata.normalize("NFKC", t).split()) for t in texts[:9]]
    assert [r[0] for r in df.orderBy("i").select(T.fold_marks(F.lower("t"))).collect()][7] == "viet nam"


def test_frames_of_python_functions(spark):
    page = "<p>One <b>two</b><script>x()</script></p><nav><p>no</p></nav><ul><li>a<li>b</ul><td rowspan='2' onclick='x'>1 &lt; 2</td>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string")
    assert [(r.tag, r.text) for r in vectors.html_blocks(df).collect()][0] == ("p", "One two")
    assert df.select(vectors.sanitise("html")).first()[0] == '<p>One <b>two</b></p><p>no</p><ul><li>a<li>b</ul><td rowspan="2">1 &lt; 2</td>'
    assert "One **two**" in df.select(vectors.to_markdown("html")).first()[0]
    assert spark.createDataFrame([("abcd", "abxd")], "a string, b string").select(vectors.title_ratio("a", "b")).first()[0] == round(SequenceMatcher(None, "abcd", "abxd").ratio(), 6)
    kind = "doc bigint, blocks array<struct<pos:int,block_id:string,text:string>>"
    rows = spark.createDataFrame([(1, [(i, f"b{i}", "s. " * 900) for i in range(4)]), (2, []), (3, None)], kind)
    got = vectors.micro_batches(rows, "doc").collect()
    assert {r.batch for r in got} == {0, 1, 2, 3} and all(r.chars <= 4000 for r in got)
    long = spark.createDataFrame([(1, [(i, f"b{i}", "x" * 10) for i in range(9)])], kind)

    def taken(budget, priority=None):
        return [r.pos for r in vectors.spread_sample(long, "doc", budget, priority=priority).collect()]

    assert taken(90) == list(range(9)) and taken(35) == [0, 4, 8] and taken(35, ["b3", "b5"]) == [0, 3, 8] and taken(9) == []


def test_counts_of_folders_keep_zeros(spark):
    items = spark.createDataFrame([(1, ["a", "b"], False), (2, ["a"], True), (3, [], False), (4, None, False)], "job_id int, folder_ids array<string>, deleted boolean")
    folders = spark.createDataFrame([("a", None), ("c", "a")], "folder_id string, parent_id string")
    assert {r.folder_id: r.n for r in library.folder_counts(items, folders).collect()} == {"a": 1, "b": 1, "c": 0, "system-all": 3, "system-unfiled": 2, "system-trash": 1}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "folder_id string, parent_id string")
    assert {(r.folder_id, r.ancestor) for r in library.ancestors(loop).collect()} == {("a", "b"), ("b", "a"), ("c", "b"), ("c", "a")}


# sources and sinks


def test_json_sources_bear_broken_files(spark, tmp_path):
    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("a", LongType())
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{nope")
    good, bad = (tolerant_json(spark, str(tmp_path / f"{x}.json"), schema) for x in ("good", "bad"))
    assert tolerant_json(spark, str(tmp_path / "none.json"), schema).count() == 0
    assert [r.a for r in with_fallback(bad, good).collect()] == [1]
    (tmp_path / "page-3.mmd").write_text("x \\(a+b\\) and\n$$\nc\n=d\n$$\n")
    r = formula_files(spark, str(tmp_path / "page-3.mmd")).first()
    assert (r.page, r.display, r.inline) == (3, ["c\n=d"], ["a+b"])
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nx"),), (bytearray(b"\x89PNG\r\n\x1a\nx"),), (bytearray(b"%PDF-1"),)], "content binary")
    assert sorted(r.kind for r in assets(png).collect()) == ["pdf", "png"]
    path = replace_version(good.select("a"), f"file://{tmp_path}/out")
    assert spark.read.json(path).first().a == 1


# streams


def test_streams_agree_with_batches(spark, tmp_path):
    from quire.streaming import incremental as s

    ev = [(i % 3, i, ("queue", "start", "finish", "fail", "cancel")[i * 7 % 5]) for i in range(30)]
    df = spark.createDataFrame(ev, "key bigint, seq bigint, event string")
    df.filter("seq < 15").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.filter("seq >= 15").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.landing(spark, f"{tmp_path}/in", df.schema)
    q = s.refresh(stream, f"{tmp_path}/index", f"{tmp_path}/ck", "key", "seq")
    q.awaitTermination()
    assert {(r.key, r.seq) for r in s.current(spark, f"{tmp_path}/index", "key").collect()} == {(0, 27), (1, 28), (2, 29)}
    want = {(r.key, r.status, r.applied) for r in state.replay(df, "key", ["seq"], "event").collect()}
    got = s.drain(s.job_states(stream, "key", "event", "seq"), "jobs", "update")
    assert want <= {(r.key, r.status, r.applied) for r in got.collect()}


# reconstruction


def test_raw_blocks_become_a_document(spark):
    from quire.operators import reconstruct

    raw = []
    for page in (1, 2, 3):
        raw.append((1, page, 0, 50.0, 10.0, 300.0, 30.0, f"Journal of Things, page {page}"))
    raw += [(1, 1, 1, 50.0, 100.0, 280.0, 150.0, "The left column breaks off with a hy-"), (1, 1, 2, 320.0, 100.0, 560.0, 150.0, "phen and ends here."), (1, 2, 1, 50.0, 100.0, 560.0, 150.0, "Next.")]
    df = spark.createDataFrame(raw, "doc int, page int, idx int, x0 double, y0 double, x1 double, y1 double, text string")
    got = reconstruct.build(df, 612, 792).orderBy("element").collect()
    assert [r.text for r in got] == ["The left column breaks off with a hyphen and ends here.", "Next."] and got[0].parts == 2
    assert reconstruct.quality(reconstruct.build(df, 612, 792), df).first().status == "PASS"
    up = reconstruct.from_bottom_up(spark.createDataFrame([(0.0, 700.0, 10.0, 720.0)], "x0 double, y0 double, x1 double, y1 double"), 792).first()
    assert (up.y0, up.y1) == (72.0, 92.0)


def test_broken_hierarchies_are_repaired(spark):
    from quire.operators import reconstruct

    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone"), ("d", "c"), ("e", None)], "folder_id string, parent_id string")
    assert {tuple(r) for r in reconstruct.repaired_hierarchy(df).collect()} == {("a", None), ("b", None), ("c", "gone"), ("d", "c"), ("e", None), ("gone", None)}


def test_levels_and_batches_give_the_greedy_choice(spark, monkeypatch):
    """Titles in classes, in ties and in near copies; lists and batches so short that every way of the choice is taken."""
    import random

    draw = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    titles = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(50)]
    titles += ["same words here"] * 8 + [f"shared token{i}" for i in range(9)] + ["twice twice", "twice"] + [f"a long title about things number{i}" for i in range(7)]
    papers = spark.createDataFrame([(i, t.split()) for i, t in enumerate(titles)], "paper bigint, title array<string>")
    vectors = {r.paper: {x.token: x.u for x in r.vector} for r in graph.unit_vectors(papers).collect()}
    pairs = []
    for a in sorted(vectors):
        for b in sorted(vectors):
            if a < b and (score := round(sum(u * vectors[b].get(t, 0.0) for t, u in vectors[a].items()), 9)) > 0:
                pairs.append((a, b, score))
    assert {(r.left, r.right): pytest.approx(r.score) for r in graph.cosine_pairs(graph.unit_vectors(papers), 0.6).collect()} == {(a, b): s for a, b, s in pairs if s >= 0.6}
    monkeypatch.setattr(graph, "_PAIRS", 4)
    monkeypatch.setattr(graph, "_ANYWAY", 60)
    for k, threshold in ((2, 0.0), (3, 0.4)):
        degree, want = {}, {}
        for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if s >= threshold and degree.get(a, 0) < k and degree.get(b, 0) < k:
                degree[a], degree[b], want[a, b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1, s
        assert {(r.left, r.right): r.score for r in graph.similarity_edges(papers, k, threshold).collect()} == {p: pytest.approx(s, abs=1e-6) for p, s in want.items()}
    degree, want = {}, set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if degree.get(a, 0) < 2 and degree.get(b, 0) < 2:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            want.add((a, b, s))
    df = spark.createDataFrame(pairs, "left bigint, right bigint, score double")
    assert {tuple(r) for r in graph.capped_edges(df, 2, batch=40).collect()} == want


def test_rows_are_numbered_across_partitions(spark):
    from quire.operators.ranks import numbered

    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 5003, i) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "key string, x int, id int").repartition(5), ["key"], ["x", "id"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.key, r.x, r.id)):
        assert r.n == by.get(r.key, 0)
        by[r.key] = r.n + 1
    assert len(got) == 3000
