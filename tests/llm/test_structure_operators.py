"""Operators 11 to 13 against brute force, their SQL and pages of several templates."""

import heapq
import random

import duckdb
import pytest
from samples import prose

from quire.llm import periodic_runs, turn_repair, wrapper_induction


def sql_rows(path, tables, sql, names):
    con = duckdb.connect()
    for name in tables:
        con.sql(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    got = con.sql(sql)
    assert sorted(got.columns) == sorted(names)
    return sorted(map(str, con.sql(f"select {', '.join(names)} from got").fetchall()))


def both(spark, path, table, df, query, sql):
    df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
    got = query(spark, str(path))
    names = sorted(got.columns)
    return sorted(str(tuple(r[n] for n in names)) for r in got.collect()), sql_rows(path, [table], sql, names)


# --- 11: periodic runs ---


def all_runs(words, least, times):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s = words[i : j + q]
            if j > i and len(s) >= max(least, times * q) and all(any(s[x] != s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (6, 2), (9, 3)])
def test_runs_are_those_of_brute_force(least, times):
    draw, total = random.Random(least), 0
    for _ in range(60):
        texts = []
        for _ in range(draw.randint(1, 6)):
            words = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 90))]
            if words and draw.random() < 0.5:
                a, p = draw.randrange(len(words)), draw.randint(1, 9)
                words = words[:a] + [words[a + (i - a) % min(p, len(words) - a)] for i in range(a, len(words))]
            texts.append(words * draw.choice([1, 1, 2]))
        texts.append(texts[0])
        found = periodic_runs.batch_runs(texts, least, times)
        assert found == [all_runs(t, least, times) for t in texts]
        total += sum(map(len, found))
    assert total > 50


def test_runs_of_odd_documents(spark, odd, none):
    rows = odd.union(spark.createDataFrame([(8, "a b c " * 9 + "d", "en", "s", 1), (8, "a b c " * 9 + "d", "en", "s", 1), (9, "x " * 24, "en", "s", 1), (10, "x " * 23, "en", "s", 1), (None, "y " * 40, "en", "s", 1)], odd.schema))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.runs(rows).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == 12 and sum(g[0] == 8 for g in got) == 2
    assert by[8][2] == [(0, 27, 3)] and by[8][3] == "a b c d" and by[9][2] == [(0, 24, 1)] and by[9][3] == "x" and by[10][2] == []
    assert by[1][1:] == (0, [], "") and by[2][1:] == (0, [], "") and by[None][2] == [(0, 40, 1)]
    assert by[5][1] == 30_000 and by[5][2] == []
    assert periodic_runs.runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(none, least=3, times=2)


def test_runs_query_is_its_sql(spark, tmp_path):
    rows = [(i, prose(i, 20 + 7 * i)) for i in range(120)] + [(500, None), (501, ""), (502, "a b " * 100 + "c d e " * 50), (503, "q " * 400), (504, prose(3, 40) + " " + " ".join([prose(4, 33)] * 4)), (504, prose(9, 5))]
    got, want = both(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id bigint, text string"), periodic_runs.op11_periodic_runs, periodic_runs.ORACLES["op11_periodic_runs"])
    assert got == want and len(got) == 126


# --- 12: conversation repair ---


def cheapest(kinds):
    heap, seen = [(0, "", 0, 0)], set()
    asked = {0: 2, 1: 2, 2: 3, 3: 2}
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(kinds) and state in (0, 3):
            return cost, edits
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 5, edits + "I", i, asked[state]))
        if i < len(kinds):
            kind, extra = kinds[i].lower(), 5 if kinds[i].isupper() else 0
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if kinds[i] != "D":
                heapq.heappush(heap, (cost + 1 + extra, edits + "R", i + 1, asked[state]))
                if kind == "s" and state == 0:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, 1))
                if kind == {2: "u", 3: "a"}[asked[state]]:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, asked[state]))


def test_layers_give_the_cheapest_and_least_edits():
    draw = random.Random(5)
    for _ in range(800):
        kinds = "".join(draw.choice("suaxDSUAXuauaua") for _ in range(draw.randint(0, 14)))
        [(cost, edits, end)] = turn_repair.traces(kinds, turn_repair._END, (0,))
        assert (cost, edits + turn_repair.tail(end)) == cheapest(kinds), kinds


def test_long_conversations_are_cut_and_put_together(spark, tmp_path):
    draw = random.Random(6)
    rows = []
    for conv, n in ((1, 700), (2, 3), (3, 130), (None, 90), (5, 0), (6, 64), (7, 65)):
        for turn in range(n):
            text = draw.choice(["Yes.", "And then?", "no end", "", " \n", None, f"Fine {turn}.", f"Well {turn}"])
            rows.append((conv, None if draw.random() < 0.02 else turn + draw.randrange(2), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text, 7))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, h int")
    df = df.dropDuplicates(["conv_id", "turn", "role", "text"])
    got, want = both(spark, tmp_path, "conversations", df, turn_repair.op12_turn_repair, turn_repair.ORACLES["op12_turn_repair"])
    assert got == want and len(got) == 6


def test_repaired_messages(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "user", "Hi."), (1, 4, "assistant", "Hello"), (1, 5, "assistant", "Hello there."), (2, 0, "user", "  ")]
    edited, counts = turn_repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    by = {r.conv: r for r in counts.collect()}
    assert (by[1].gaps, by[1].blank, by[1].duplicate, by[1].truncated, by[1].illegal, by[1].cost) == (1, 0, 1, 1, 2, 4) and by[2].cost == 2
    parts = edited.filter("conv = 1").orderBy("part", "segment").collect()
    assert "".join(p.audit for p in parts) == "KKDDK"
    assert [(m.role, m.text) for p in parts for m in p.messages if m.edit != "D"] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello there.")]
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [x.count() for x in turn_repair.repair(none)] == [0, 0]


# --- 13: main text ---

LONG = "Lorem ipsum dolor sit amet, consetetur & so on"


def test_blocks_of_a_page():
    def text(page):
        root = wrapper_induction.parse(page)
        wrapper_induction._settle(root)
        return " ".join(x for _, x, _ in wrapper_induction.Skeleton(root).blocks)

    assert text("a &amp; b &lt;i&gt; <i>c</i>d<br>e\n\t f &#8217; &eacute;&nbsp;&am") == "a & b <i> cd e f ’ é &am"
    assert text('<title>t</title><script>if (a < b) "</p>"</script><p>x<!-- <p>y</p> --><p>z<style>p{}</style>') == "x z"
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>") == "a b c 1 2"
    assert text("") == "" and text("<p") == "" and text("<div>" * 3000 + "deep") == "deep"
    assert len(text("<div>" + "".join(f"<div class=c{i}><p>{i} word</p></div>" for i in range(2000)) + "</div>").split()) == 4000


def pages_of(template, n, host):
    return [(f"http://{host}/{i}", template.replace("@T", f"Title {i}").replace("@M", " ".join(f"menu{i * 7 % 5}{k}" for k in range(3))).replace("@P", f"<p>{prose(i + 50, 40)}</p>\n<p>{prose(i + 90, 60)} &amp; so</p>"), f"{prose(i + 50, 40)} {prose(i + 90, 60)} & so", i) for i in range(n)]


TEMPLATES = {
    "plain.example.com": '<html><body><header><h1>The site</h1></header><nav><a href="/">@M</a></nav><main><article><h1>@T</h1>@P<div class="share">Share this</div></article><aside>@M</aside></main><footer>&copy; 2020</footer></body></html>',
    "soup.example.com": '<body class="has-sidebar"><div id="top"><div><a href="/">Home</a> <a href="/n">News</a></div></div><div class="cookie-notice">We use cookies.</div><div class="wrap"><div class="col"><h1>@T</h1>@P<p>Thank you for reading this page of ours.</p></div><div class="col2"><ul><li><a href="/x">@M</a></li><li><a href="/y">@M more</a></li></ul></div></div><div class="reader-comments"><p>@M says that this is very good and long and that there is no end to it at all.</p></div><form action="/s"><p>Search</p></form></body>',
    "late.example.com": "<div><p>Subscribe now to get all of our news every day by mail</p></div><div><h1>@T</h1>@P</div><div><p>All rights are kept by the owner of this site</p></div>",
}
TEMPLATES |= {
    "holder.example.com": '<body><div class="leftcol"><p>@M and many more words here that are not of the article at all, but change from page to page</p></div><div id="page-content"><h1>@T</h1><div class="lead">@P</div></div><div id="cookiebar"><p>Cookies</p></div><div class="adslot"><p>@M</p></div><div><h3>2 Comments</h3><p>@M I say.</p><p>Me too @M.</p></div></body>',
    "parts.example.com": "<body><div><a href='/'>Home</a></div><div class='x'><h1>@T</h1><p>An opening of @T that is long enough to count as a part of the text.</p><div class='rest'>@P</div></div><div class='userComments'><div><p>@M @M</p></div></div><div class='side'><p>@M</p></div></body>",
}


def test_main_text_of_several_templates(spark):
    rows, want = [], {}
    for host, template in TEMPLATES.items():
        for url, page, text, i in pages_of(template, 8, host):
            rows.append((len(rows), url, page, "x"))
            want[url] = f"Title {i} {text}" if host != "parts.example.com" else f"Title {i} An opening of Title {i} that is long enough to count as a part of the text. {text}"
    rows += [(900, None, None, "x"), (901, "http://one.example.com/", "", "x"), (902, "no url", f"<p>{LONG}</p>", "x"), (902, "no url", f"<p>{LONG}</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = [(r.page_id, r.url, r.text) for r in wrapper_induction.extract(pages).collect()]
    assert len(got) == len(rows)
    for _, url, text in got:
        if url in want:
            assert text == want[url], url
    assert sorted(t for i, _, t in got if i >= 900) == ["", "", LONG, LONG]
    assert wrapper_induction.extract(pages.limit(0)).count() == 0


def test_copies_of_one_article_are_not_taken_for_a_template(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>One</h1>" + "".join(f"<p>{prose(k, 30)}</p>" for k in range(4)) + "<p>@</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://copies.example.com/{i}", page.replace("@", f"number {i}")) for i in range(12)], "page_id bigint, url string, html string")
    texts = {r.page_id: r.text for r in wrapper_induction.extract(pages).collect()}
    assert texts == {i: " ".join(["One", *(prose(k, 30) for k in range(4)), f"number {i}"]) for i in range(12)}


def test_alignment_matches_most_nodes():
    a = [[-1, "html", "", ""], [0, "div", "top", ""], [0, "div", "", ""], [2, "p", "", ""], [2, "h2", "", ""]]
    b = [[-1, "html", "", ""], [0, "div", "", ""], [1, "p", "", ""], [1, "h2", "", ""], [0, "p", "", ""]]
    assert wrapper_induction.align(a, b) == [0, -1, 1, 2, 3]
    wide = [[-1, "html", "", ""], *([0, "div", f"{'abcdefgh'[k % 8]}{'xyz' * (k // 8)}", ""] for k in range(300))]
    other = [wide[0], *(x for k, x in enumerate(wide[1:]) if k % 3), [0, "div", "new", ""]]
    found = wrapper_induction.align(wide, other)
    assert found[1:6] == [-1, 1, 2, -1, 3] and sum(x >= 0 for x in found) == 201
    assert wrapper_induction.align(a, a) == list(range(5)) and wrapper_induction.align(a, [[-1, "p", "", ""]]) == [-1] * 5


def test_pages_query_is_its_sql_on_the_given_pages(spark):
    path = "/root/testdata/sf0.001"
    got = wrapper_induction.op13_html_extraction(spark, path).collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet'")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got) == sorted(con.sql(wrapper_induction.ORACLES["op13_html_extraction"]).fetchall())


# --- rules and files that other languages and writers need ---


def test_other_scripts_are_judged_by_the_base_rules(spark):
    from quire.llm import quality

    russian = " ".join(f"слово{i} и предложение номер {i} о погоде." for i in range(20))
    chinese = " ".join(f"这是第{i}个句子。" for i in range(80))
    arabic = " ".join(f"جملة{i} رقم{i} هنا وهناك{i}" for i in range(40))
    junk = " ".join(f"| {i} $ # %" for i in range(60))
    rows = [(1, russian, "ru"), (2, chinese, "zh"), (3, arabic, "ar"), (4, russian, None), (5, chinese, ""), (6, junk, None), (7, "слово " * 200, "ru")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False}


def test_files_of_another_writer_are_read():
    from quire.llm import warc

    body = b"<p>x</p>"
    data = b"WARC/1.0\r\nwarc-type: response\r\nwarc-date: 2024-02-03T04:05:06Z\r\nwarc-record-id:<urn:uuid:1>\r\nWarc-Target-Uri:   http://a/\r\ncontent-length:%d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    [first, second] = list(warc.parse(data * 2))
    assert first[2:5] == ("<urn:uuid:1>", "http://a/", body) and first[6] is None and second[0] == len(data)


def test_long_lists_that_link_nothing_are_dropped_whole(spark):
    """Texts that share most of a boilerplate, too little to link: no list of it may be joined, dealt out or not."""
    from quire.llm import jaccard_join

    boilerplate = prose(7, 45)
    rows = [(i, f"{boilerplate} {prose(1000 + i, 12)}") for i in range(400)] + [(900, f"{prose(31, 60)} end"), (901, f"{prose(31, 60)} fin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = []
    for most in (100, 100_000):
        *_, lists = jaccard_join._prepared(docs, "doc_id", "text", 4, 85, most)
        counts.append(lists.count())
        got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, most=most).collect()}
        assert got[901] == 900 and all(got[i] == i for i in range(400))
    assert counts[0] == counts[1] < 400
