"""The kept index: segments, tombstones, merges and readers that see no stale table."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.search_index import SearchIndex, to_merge

KIND = "job_id string, kind string, source_id string, text string"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_tiers():
    assert to_merge([], 4) == 0 and to_merge([5], 4) == 0 and to_merge([100, 1, 1, 1], 4) == 0
    assert to_merge([100, 1, 1, 1, 1], 4) == 4
    assert to_merge([1000, 4, 4, 4, 1, 1, 1, 1], 4) == 7  # four of tier 0 make one of tier 1, with which there are four of that
    assert to_merge([20, 20, 20, 5, 1, 1], 4) == 0 and to_merge([20, 20, 20, 17], 4) == 4
    # However many refreshes there are, segments stay few.
    sizes = [2000]
    for _ in range(300):
        sizes.append(1)
        if k := to_merge(sizes, 4):
            sizes = [*sizes[:-k], sum(sizes[-k:])]
        assert len(sizes) < 4 * 7


def test_one_changed_source_writes_one_small_segment(spark, tmp_path):
    rows = [(str(i % 50), "content", f"s{i}", f"word{i % 97} and word{i % 31} common text of some length number{i}") for i in range(2000)]
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.refresh(spark.createDataFrame(rows, KIND))
    first = index.current()
    old = {p.name: size(p) for p in Path(f"{tmp_path}/index/segments").iterdir()}
    assert len(old) == 1 and first.live == 2000 and len(first.segments) == 1
    rows[7] = (*rows[7][:3], "a changed text about a heron")
    assert index.refresh(spark.createDataFrame(rows, KIND)) == {"insert": 0, "update": 1, "delete": 0, "keep": 1999}
    now = {p.name: size(p) for p in Path(f"{tmp_path}/index/segments").iterdir()}
    [new] = set(now) - set(old)
    assert set(old) < set(now) and now[new] < sum(old.values()) / 10
    assert [(s.n, s.gone) for s in index.current().segments] == [(2000, 0), (1, 1)]
    other = SearchIndex(spark, index.path)
    assert [r.source_id for r in other.search("heron").collect()] == ["s7"] and "s7" not in [r.source_id for r in other.search("number7").collect()]
    # A refresh that finds nothing writes nothing; one of a known state doesn't read.
    assert index.refresh(spark.createDataFrame(rows, KIND))["keep"] == 2000 and index.current().generation == 2
    index.refresh(spark.createDataFrame(rows, KIND), version="one")
    assert index.current().version == "one" and index.refresh(None, version="one")["keep"] == 2000
    # Two writers can't make one generation.
    with pytest.raises(Exception, match="(?i)already exists"):
        index._publish(index.current())


def test_refreshes_in_a_row_answer_as_a_scan_does(spark, tmp_path):
    draw = random.Random(4)
    words = "the cat dog heron river café 猫 stone and of".split()

    def text():
        return None if draw.random() < 0.05 else " ".join(draw.choice(words) for _ in range(draw.randint(0, 8)))

    state = {f"s{i}": (str(i % 5), draw.choice(["content", "notes"]), f"s{i}", text()) for i in range(40)}
    index = SearchIndex(spark, f"file://{tmp_path}/index", fan=2)
    merged = False
    for step in range(6):
        sources = spark.createDataFrame(list(state.values()), KIND)
        index.refresh(sources)
        now = index.current()
        merged |= step > 1 and len(now.segments) < step + 1
        stats = sources.select(F.size(search.T.lexical_tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("a"), F.count("n").alias("b"), F.sum("n").alias("c")).first()
        assert (now.live, now.sized, now.total) == tuple(stats)
        for q in ("the cat", "cat-dog")[step % 2 :][:1]:
            assert index.search(q, limit=100).collect() == search.search(sources, q, limit=100).collect(), (step, q)
        left = {p.name for p in Path(f"{tmp_path}/index/manifest").iterdir()}
        assert left == {str(g) for g in range(max(1, now.generation - 1), now.generation + 1)}
        for key in draw.sample(sorted(state), 4):
            if draw.random() < 0.4:
                del state[key]
            else:
                state[key] = (*state[key][:3], text())
        state[f"n{step}"] = ("9", "notes", f"n{step}", "the new cat")
    assert merged
    index.refresh(spark.createDataFrame([], KIND))
    assert index.current().live == 0 and index.search("the").count() == 0 and index.search("").count() == 0


def test_replaced_tables_give_new_hits_in_one_session(spark, tmp_path):
    from quire.plans import library

    def tables(text):
        spark.createDataFrame([(i, text, "en", f"src{i}", len(text)) for i in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")

    tables("nothing here")
    assert library.search_bm25_term(spark, str(tmp_path)).count() == 0
    tables("on sur le")
    assert library.search_bm25_term(spark, str(tmp_path)).count() == 24
    tables("nothing again")
    assert library.search_bm25_term(spark, str(tmp_path)).count() == 0
