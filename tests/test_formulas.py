"""Formulas: golden cases, and random trees against the characters they are made of."""

import random

import pytest

from quire.functions import formulas as f


def told(text):
    return [(a["text"], "".join(s[2] for s in a["scripts"]), a["role"]) for a in f.atoms(f.read(text))]


def glyphs(text, script=None, styles=(), role=None, accents=()):
    return [{"text": c, "script": script, "styles": list(styles), "role": role, "accents": list(accents)} for c in text]


@pytest.mark.parametrize("text,want", [
    ("x^2", [("x", "", None), ("2", "p", None)]), (r"\alpha_{ij}", [("α", "", None), ("i", "b", None), ("j", "b", None)]), (r"\frac{a}{b+c}", [("a", "", "numerator"), ("b", "", "denominator"), ("+", "", "denominator"), ("c", "", "denominator")]),
    (r"\frac12", [("1", "", "numerator"), ("2", "", "denominator")]), (r"\log x", [("l", "", "operator"), ("o", "", "operator"), ("g", "", "operator"), ("x", "", None)]), (r"\underset{x}{max}", [("m", "", None), ("a", "", None), ("x", "", None), ("x", "b", None)]),
    (r"\left( a \right]", [("(", "", None), ("a", "", None), ("]", "", None)]), (r"x\tag{3}", [("x", "", None)]), (r"\begin{cases}a&b\\c\end{cases}", [("a", "", None), ("b", "", None), ("c", "", None)]), ("", []),
])
def test_atoms(text, want):
    assert told(text) == want and not f.read(text).faults


@pytest.mark.parametrize("text,want", [
    ("{x", ["unclosed_group"]), ("x}", ["unexpected_closing_brace"]), ("x^", ["missing_argument"]), ("{x^}", ["missing_argument"]), ("x^1^2", ["duplicate_script"]), ("x^1_2", []), (r"\frac{1}", ["missing_argument"]), (r"\left(x", ["unclosed_left_delimiter"]),
    (r"x\right)", ["orphan_right_delimiter"]), (r"{\left(x}\right)", ["unclosed_left_delimiter", "orphan_right_delimiter"]), (r"\left q", ["invalid_math_delimiter"]), (r"\left", ["missing_math_delimiter"]), (r"\begin{cases}x", ["unclosed_environment"]),
    (r"x\end{cases}", ["orphan_end_environment"]), (r"\begin{cases}x\end{array}", ["mismatched_environment"]), (r"\begin x", ["invalid_environment_name"]), (r"\begin{tikz}\end{tikz}", ["unsupported_environment"] * 2), ("x\\", ["dangling_escape"]),
])
def test_faults(text, want):
    assert sorted(k for k, _ in f.read(text).faults) == sorted(want)


def test_unknown_commands_and_accents():
    assert f.read(r"\foo x \sqrt{y}").unknown == ["foo", "sqrt"]
    assert [a["accents"] for a in f.atoms(f.read(r"\hat{x}y"))] == [["hat"], []]
    assert [a["accents"] for a in f.atoms(f.read("x\u0302y"))] == [["hat"], []]
    assert [a["styles"] for a in f.atoms(f.read(r"\mathscr{L}\bm{x}"))] == [["mathcal"], ["mathbf"]]


def test_deep_and_broken_formulas_end():
    assert len(f.atoms(f.read("{" * 5000 + "x" + "}" * 5000))) == 1
    draw = random.Random(4)
    for _ in range(500):
        f.atoms(f.read("".join(draw.choice(["{", "}", "^", "_", "x", "\\frac", "\\left(", "\\right)", "\\begin{cases}", "\\end{cases}", " ", "\\"]) for _ in range(20))))


def test_random_trees_print_their_characters():
    draw = random.Random(5)

    def tree(depth):
        kind = draw.randrange(6) if depth else 0
        if kind == 0:
            c = draw.choice("abcxyz123+")
            return c, c
        if kind == 1:
            inner, printed = tree(depth - 1)
            return "x" + draw.choice("^_") + "{" + inner + "}", "x" + printed
        parts = [tree(depth - 1) for _ in range(2)]
        if kind == 2:
            return r"\frac{%s}{%s}" % (parts[0][0], parts[1][0]), parts[0][1] + parts[1][1]
        if kind == 3:
            return r"\left(%s\right) " % parts[0][0], "(" + parts[0][1] + ")"
        if kind == 4:
            return r"\mathbf{%s}" % parts[0][0], parts[0][1]
        return "{" + parts[0][0] + "}" + "{" + parts[1][0] + "}", parts[0][1] + parts[1][1]

    for _ in range(300):
        text, printed = tree(4)
        formula = f.read(text)
        assert "".join(a["text"] for a in f.atoms(formula)) == printed and not formula.faults, text


def test_repair_needs_proof():
    native = glyphs("x+") + glyphs("y") + glyphs("=1")
    assert f.repaired("x+v=1", native) == ("x+y=1", 1)
    assert f.repaired("x+7=1", native) == ("x+7=1", 0)
    assert f.repaired("ab", glyphs("zq")) == ("ab", 0)
    assert f.repaired("L=x+y", glyphs("L", styles=["mathcal"]) + glyphs("=x+y")) == (r"\mathcal{L}=x+y", 1)
    assert f.repaired("x2+y", glyphs("x") + glyphs("2", "sup") + glyphs("+y")) == ("x{}^{2}+y", 1)


def test_assessment_takes_the_candidate_that_is_proved():
    native = glyphs("x") + glyphs("2", "sup") + glyphs("=y")
    assert f.assess([("a", "x^2=y"), ("b", "x_2=y")], native)["engine"] == "a"
    got = f.assess([("a", "x_2=y"), ("b", "x^2=y")], native)
    assert (got["engine"], got["text"], got["status"], got["score"]) == ("b", "x^2=y", "confirmed", 0)
    got = f.assess([("a", "x2=y"), ("b", None)], native)
    assert (got["engine"], got["text"], got["status"]) == ("repair", "x{}^{2}=y", "confirmed")
    got = f.assess([("a", "q+r"), ("b", "s")], native)
    assert (got["engine"], got["text"], got["status"]) == ("a", "q+r", "unresolved") and f.assess([("a", "x")], [])["status"] == "unsupported"
    assert f.score(f.read("x^2=y"), native)["score"] == 0 and f.score(f.read("x^2=y}"), native)["score"] == 3 and f.score(f.read("x^2"), native)["score"] == 6
