"""Alignment of nodes of any width by one rule."""

import random

from quire.llm import wrapper_induction


def plain(left, right):
    """Most matching nodes, twice as many for equal classes, of two rows of leaves."""
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (1 + (x == y)))
    return best[-1][-1]


def test_wide_nodes_are_aligned_as_narrow_ones(monkeypatch):
    """more pairs of children than were compared one by one before."""
    draw = random.Random(5)
    names = [draw.choice("abcdef") for _ in range(320)]
    some = [x for x in names if draw.random() < 0.8]
    ours, theirs = ([[-1, "html", "", ""], *([0, "div", x, ""] for x in own)] for own in (names, some))
    found = wrapper_induction.align(ours, theirs)
    met = [(k, x) for k, x in enumerate(found) if x > 0]
    assert met == sorted(met, key=lambda p: p[1])
    assert sum(1 + (ours[k][2] == theirs[x][2]) for k, x in met) == plain(names, some)
    monkeypatch.setattr(wrapper_induction, "_TABLE", 500)
    monkeypatch.setattr(wrapper_induction, "_GAINS", 12)
    monkeypatch.setattr(wrapper_induction, "_KNOWN", 1)
    assert wrapper_induction.align(ours, theirs) == found
