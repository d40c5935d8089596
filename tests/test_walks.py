"""Walks along hierarchies and numbers, longer than any fixed bound."""

import random
import time

from quire.operators import library, reconstruct, records
from quire.sources import sidecars


def test_ancestors_of_a_long_chain_and_of_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}" if i < 199 else None) for i in range(200)]
    got = {(r.folder_id, r.ancestor): r.distance for r in library.ancestors(spark.createDataFrame(chain, "folder_id string, parent_id string")).collect()}
    assert len(got) == 199 * 200 // 2 and got["n0", "n199"] == 199
    ring = [(f"r{i}", f"r{(i + 1) % 90}") for i in range(90)] + [("out", "r5"), ("self", "self"), ("none", None), ("lost", "nowhere")]
    folders = spark.createDataFrame(ring, "folder_id string, parent_id string")
    got = [(r.folder_id, r.ancestor, r.distance) for r in library.ancestors(folders).collect()]
    assert len(got) == 90 * 89 + 90 + 1 + 1 and ("self", "self", 1) in got and ("out", "r4", 90) in got and ("lost", "nowhere", 1) in got
    fixed = {r.folder_id: r.parent_id for r in reconstruct.repaired_hierarchy(folders).collect()}
    assert all(fixed[f"r{i}"] is None for i in range(90)) and fixed["self"] is None and fixed["out"] == "r5" and fixed["nowhere"] is None


def test_numbers_of_a_long_document(spark):
    draw = random.Random(1)
    rows = [(k, i, draw.choice([None, draw.randrange(1, 40), draw.randrange(1, 2000)])) for k in (1, 2) for i in range(900)]
    want = {}
    for k in (1, 2):
        used = set()
        for _, i, asked in [r for r in rows if r[0] == k]:
            number = asked if asked is not None and asked not in used else next(n for n in range(1, 10_000) if n not in used)
            used.add(number)
            want[k, i] = number
    got = records.numbered(spark.createDataFrame(rows, "doc int, pos int, wanted int"), "doc", "pos", "wanted").collect()
    assert {(r.doc, r.pos): r.number for r in got} == want
    began = time.time()
    assert records.numbered(spark.range(300_000).selectExpr("1 as doc", "cast(id as int) as pos", "cast(1 as int) as wanted"), "doc", "pos", "wanted").agg({"number": "max"}).first()[0] == 300_000
    assert time.time() - began < 30


def test_ceilings_of_sidecars(spark):
    deep = "[[" + '{"a":' * 6 + '"x"' + "}" * 6 + "]]"
    rows = [(1, '[[{"type":"p","c":["one",{"t":"two"}]},{"type":"h"}],[]]'), (2, "no json"), (3, None), (4, '{"a":1}'), (5, "[]"), (6, '[1]'), (7, "[[],[],[],[]]"), (8, "[[1,2,3,4,5,6]]"), (9, deep), (10, '[[["' + "y" * 50 + '"]]]'), (11, "[[[" + ",".join("0" * 30) + "]]]"), (12, "[" + " " * 400 + "]")]
    low = sidecars.Ceilings(size=300, pages=3, elements=5, nodes=25, chars=40, depth=6)
    found, elements = sidecars.scan(spark.createDataFrame(rows, "key int, json string"), ["key"], ceilings=low)
    got = {r.key: (r.status, r.pages, r.elements, r.nodes, r.depth, r.chars) for r in found.collect()}
    assert got[1] == ("ok", 2, 2, 11, 5, 4 + 1 + 1 + 3 + 1 + 3 + 4 + 1)
    assert {k: v[0] for k, v in got.items() if k > 1} == {2: "no json", 3: "no json", 4: "no pages", 5: "no pages", 6: "no pages", 7: "too many pages", 8: "too many elements", 9: "too deep", 10: "too many chars", 11: "too many nodes", 12: "too large"}
    assert {(r.key, r.page, r.element, r.type, r.text) for r in elements.collect()} == {(1, 0, 0, "p", "one two"), (1, 0, 1, "h", "")}
    none = spark.createDataFrame([], "key int, json string")
    assert [x.count() for x in sidecars.scan(none, ["key"])] == [0, 0]


def test_groups_of_boxes(spark):
    import numpy as np

    from quire.operators import layout

    draw = random.Random(3)
    for size, gap in ((8, 0), (20, 2), (40, 5.5), (5, 0)):
        n = 60
        x0, y0 = np.array([draw.randrange(200) for _ in range(n)], float), np.array([draw.randrange(200) for _ in range(n)], float)
        x1, y1 = x0 + np.array([draw.randint(0, size) for _ in range(n)]), y0 + np.array([draw.randint(0, size) for _ in range(n)])
        near = (np.maximum(x0[:, None] - x1, x0 - x1[:, None]) <= gap) & (np.maximum(y0[:, None] - y1, y0 - y1[:, None]) <= gap)
        want = np.arange(n)
        while True:
            low = np.where(near, want[None], n).min(axis=1)
            if (low == want).all():
                break
            want = low
        assert (layout._labels(x0, y0, x1, y1, gap) == want).all()
    rng = np.random.default_rng(1)
    x0, y0 = rng.integers(0, 100_000, 100_000).astype(float), rng.integers(0, 2000, 100_000).astype(float)
    began = time.time()
    assert len(layout._labels(x0, y0, x0 + 30, y0 + 10, 4.0)) == 100_000 and time.time() - began < 60
    boxes = spark.createDataFrame([(1, 2, 0, 0, 5, 5), (1, 1, 7, 0, 9, 5), (1, 3, 50, 0, 60, 5), (2, 4, 0, 0, 1, 1)], "page bigint, idx int, x0 int, y0 int, x1 int, y1 int")
    assert {(r.page, r.idx, r.group) for r in layout.box_groups(boxes, 2.0).collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 4, 4)}
    assert layout.box_groups(boxes.limit(0), 2.0).count() == 0
