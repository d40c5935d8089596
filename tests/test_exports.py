"""Outputs are made again only where inputs or their form have changed."""

from pathlib import Path

from pyspark.sql import functions as F

from quire.sources.exports import Exports


def test_only_changes_are_written(spark, tmp_path):
    made = []

    def render(rows):
        made.append(sorted({r.key for r in rows.select("key").collect()}))
        return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("text")), "+").alias("content"))

    def runs():
        return {p.name for p in Path(f"{tmp_path}/e/runs").iterdir()}

    def inputs(rows):
        return spark.createDataFrame(rows, "key string, pos int, text string")

    def outputs(e):
        return {r.key: r.content for r in e.outputs().collect()}

    rows = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("c", 0, None), (None, 0, "left out")]
    e = Exports(spark, f"file://{tmp_path}/e")
    assert outputs(e) == {}
    assert e.refresh(inputs(rows), ["pos", "text"], render) == {"make": 3, "migrate": 0, "keep": 0, "drop": 0}
    first = runs()
    assert outputs(e) == {"a": "one+two", "b": "three", "c": ""}
    # A second run writes nothing; rows in another order are the same document.
    assert e.refresh(inputs(rows[::-1]), ["pos", "text"], render)["keep"] == 3 and runs() == first and len(made) == 1
    rows[1] = ("a", 1, "deux")
    assert e.refresh(inputs([*rows, ("d", 0, "new")]), ["pos", "text"], render) == {"make": 2, "migrate": 0, "keep": 2, "drop": 0}
    assert made[-1] == ["a", "d"] and first < runs() and len(runs()) == 2 and outputs(e) == {"a": "deux+one", "b": "three", "c": "", "d": "new"}
    # A newer form: what hasn't changed is migrated without its input.
    third = Exports(spark, e.path, 3, {1: lambda c: F.upper(c), 2: lambda c: F.concat(c, F.lit("!"))})
    assert third.refresh(inputs([*rows[:2], ("b", 0, "four")]), ["pos", "text"], lambda x: render(x).withColumn("content", F.concat(F.upper("content"), F.lit("!")))) == {"make": 1, "migrate": 1, "keep": 0, "drop": 2}
    assert outputs(third) == {"a": "DEUX+ONE!", "b": "FOUR!"} and made[-1] == ["b"]
    # From a form that no migration leads on from, all is made again.
    assert Exports(spark, e.path, 5, {4: lambda c: c}).refresh(inputs(rows[:2]), ["pos", "text"], render) == {"make": 1, "migrate": 0, "keep": 0, "drop": 1}


def test_runs_are_put_together(spark, tmp_path):
    def render(rows):
        return rows.select("key", F.col("text").alias("content"))

    e = Exports(spark, f"file://{tmp_path}/e")
    for k in range(4):
        e.refresh(spark.createDataFrame([(str(i), f"text {i} {k if i == k else ''}") for i in range(6)], "key string, text string"), ["text"], render, most_runs=2)
    assert {r.key: r.content for r in e.outputs().collect()} == {str(i): f"text {i} {3 if i == 3 else ''}" for i in range(6)}
    assert e.state().select("run").distinct().count() <= 2
