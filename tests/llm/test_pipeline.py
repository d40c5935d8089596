"""The pipeline on a small corpus: each stage against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from samples import prose
from test_operators import brute_components, brute_lines


COMMON = "the of and to in a is that it was for on with as be by at this are from".split()


def corpus(spark, folder):
    item = prose(77, 40)
    docs = []
    for i in range(24):
        docs.append((i, "\n".join(" ".join(f"{w} {COMMON[j % 20]}" for j, w in enumerate(prose(1000 * i + k, 25).split())) + "." for k in range(4)), "en", f"src{i % 3}"))
    docs.append((30, docs[3][1], "en", "src0"))
    docs.append((31, docs[4][1].replace("\n", " "), "en", "src0"))
    docs.append((32, docs[5][1] + "\n" + item, "en", "src0"))
    docs.append((33, " ".join(f"{w}### %%%" for w in prose(5, 80).split()), "en", "src1"))
    docs += [(34, None, "en", "src1"), (35, "", None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_each_stage_does_its_job_on_what_is_left(spark, tmp_path):
    docs, folder = corpus(spark, str(tmp_path)), str(tmp_path)
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        texts.append({r.doc_id: r.text for r in docs.collect()})
    raw, good, lines, near, clean = texts
    assert set(raw) - set(good) == {33, 34, 35}
    want = {i: t for i, t in brute_lines(sorted(good.items())).items() if t.split() or t == good[i]}
    assert lines == want and 30 not in lines
    parts = brute_components(sorted(lines.items()), 5, 80)
    assert set(near) == {i for i, (_, p) in parts.items() if p == i} and 31 not in near
    assert set(near) - set(clean) == {32}
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(done) == set(clean) and all(r.lossless and r.n_pieces > 0 for r in done.values())


def test_a_run_goes_on_where_one_stopped(spark, tmp_path, monkeypatch):
    corpus(spark, f"{tmp_path}/in")
    whole = sorted(corpus_pipeline.run(spark, f"{tmp_path}/in").collect())
    real, done = corpus_pipeline.STAGES, []

    def noted(name, stage):
        return name, lambda *args: (done.append(name), stage(*args))[1]

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*(noted(*x) for x in real[:2]), ("near_duplicates", broken), *real[3:]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/kept")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*x) for x in real])
    assert sorted(corpus_pipeline.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/kept").collect()) == whole
    assert done == [x for x, _ in real]


def test_columns_that_clash_or_lack(spark):
    line = "one line of some words that stands in two documents of this small table"
    docs = spark.createDataFrame([(1, f"{line}\nfirst", 7), (2, f"{line}\nsecond", 8)], "doc_id bigint, text string, n_removed int")
    out = corpus_pipeline.line_deduplication(spark, docs, "")
    assert sorted(tuple(r) for r in out.collect()) == [(1, f"{line}\nfirst", 7), (2, "second", 8)] and out.columns == docs.columns


def test_an_empty_table_passes_through(spark, tmp_path):
    docs = corpus(spark, f"{tmp_path}/full").limit(0)
    docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
