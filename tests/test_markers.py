"""Markers of captions and paragraphs: what counts as one."""

from quire.operators import markers


def test_markers_need_a_line_and_a_shape(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    red, gray = 0xCC0000, 0x888888
    blocks = [(1, 1, "caption", "Figure 2: A line denotes x and indicates y", 50.0, 300.0, 400.0, 340.0), (1, 2, "paragraph", "It denotes nothing here", 50.0, 0.0, 400.0, 40.0), (1, 3, "paragraph", None, 0.0, 0.0, 1.0, 1.0), (2, 1, "caption", "Table 2 denotes z", 50.0, 300.0, 400.0, 340.0), (2, 2, "paragraph", "denotes z. Represents w", 50.0, 0.0, 400.0, 40.0)]
    spans = [(1, "Fig. 2 A line", 10.0, 50.0, 345.0, 90.0, 355.0), (1, "denotes x and", 10.0, 120.0, 345.0, 190.0, 355.0), (1, "Indicates y", 10.0, 60.0, 360.0, 120.0, 370.0), (1, "indicates far off", 10.0, 60.0, 600.0, 120.0, 610.0), (2, "denotes z.", 10.0, 60.0, 5.0, 90.0, 15.0), (2, "Represents w", 10.0, 120.0, 5.0, 180.0, 15.0)]

    def marked(page, n, x, y, shape, colour):
        return [(page, n, "l", colour, None, x - 14, y, x - 2, y + 1), (page, n + 1, shape, None, colour, x - 10, y - 2, x - 6, y + 2)]

    drawings = marked(1, 1, 120.0, 350.0, "cccc", red) + marked(1, 3, 60.0, 365.0, "llll", gray) + marked(2, 1, 60.0, 10.0, "cccc", red) + marked(2, 3, 120.0, 10.0, "cc", red)
    drawings += [(1, 9, "l", red, None, 10.0, 350.0, 118.0, 351.0)]

    def run(drawn):
        got = markers.recovered(spark.createDataFrame(blocks, f"page int, idx int, kind string, text string, {box}"), spark.createDataFrame(spans, f"page int, text string, size double, {box}"), spark.createDataFrame(drawn, f"page int, n int, commands string, line int, fill int, {box}"))
        return {(r.page, r.idx): (r.text, r.markers) for r in got.collect()}

    assert run(drawings) == {(1, 1): ("Figure 2: A line [circle red] denotes x and [square gray] indicates y", ["circle red", "square gray"])}
    assert run([d for d in drawings if d[:2] != (1, 4)]) == {} and run(drawings[:0]) == {}
    good = [(*d[:2], "ccc", *d[3:]) if d[:2] == (2, 4) else d for d in drawings]
    assert run(good)[2, 2] == ("[circle red] denotes z. [circle red] Represents w", ["circle red", "circle red"])
