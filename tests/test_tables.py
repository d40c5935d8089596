"""Heads and group rows carried over between two engines' tables, with spans."""

from quire.operators import tables

KIND = "table int, row int, idx int, text string, down int, across int"


def cells(number, *rows):
    """Rows of texts or (text, down, across)."""
    return [(number, r, i, *(x if isinstance(x, tuple) else (x, 1, 1))) for r, row in enumerate(rows) for i, x in enumerate(row)]


def test_heads(spark):
    body = (["one", "1", "2"], ["two", "3", "4"])
    ours = cells(1, ["", "Speed", "Cost"], ["", "m/s", "EUR"], *body) + cells(2, ["", "Speed", "Cost"], ["", "m/s", "EUR"], *body) + cells(3, ["Name", "Speed", "Cost"], *body) + cells(4, ["", "Speed", "Cost"], *body)
    ours += cells(5, ["", "Speed", "Cost"], ["Group A", "", ""], *body) + cells(6, ["", "x"], ["a", "b"]) + cells(7, ["", ("Speed", 1, 2)], ["Model", "min", "max"], *body)
    theirs = cells(1, [("Name", 2, 1), "Speed", "Cost"], ["m/s", "EUR"], *body) + cells(2, [("Name", 2, 1), "Colour", "Taste"], ["red", "sweet"], *body) + cells(3, [("Label", 2, 1), "Speed", "Cost"], ["", ""], *body)
    theirs += cells(4, [("Name", 1, 1), "Speed", "Cost"], *body) + cells(5, [("Name", 1, 1), "Speed", "Cost"], [("Group  a", 1, 3)], *body) + cells(7, [("Model", 2, 1), ("Speed", 1, 2)], ["min", "max"], *body)
    out, changes = tables.with_heads(spark.createDataFrame(ours, KIND), spark.createDataFrame(theirs, KIND))
    got = {(r.table, r.row, r.idx): (r.text, r.down, r.across) for r in out.collect()}
    want = {c[:3]: c[3:] for c in ours}
    want[1, 0, 0] = ("Name", 2, 1)
    del want[1, 1, 0]
    want[5, 1, 0] = ("Group A", 1, 3)
    del want[5, 1, 1], want[5, 1, 2]
    want[7, 0, 0] = ("Model", 2, 1)
    del want[7, 1, 0]
    assert got == want
    assert {(r.table, r.row, r.operation, r.text) for r in changes.collect()} == {(1, 0, "head", "Name"), (2, 0, "unsure", "Name"), (5, 1, "group", "Group A"), (7, 0, "head", "Model")}
    none = spark.createDataFrame([], KIND)
    assert [x.count() for x in tables.with_heads(none, none)] == [0, 0] and tables.with_heads(spark.createDataFrame(ours, KIND), none)[0].count() == len(ours)


def test_width_is_that_of_most_rows(spark):
    grid = cells(1, [("a", 1, 3)], ["b", "c", "d"], [("e", 2, 1), "f", "g"], ["h", "i"]) + cells(2, ["x", "y"], ["z"])
    assert {r.table: r.width for r in tables.widths(spark.createDataFrame(grid, KIND)).collect()} == {1: 3, 2: 2}
