"""Formulas in TeX: their tree, the atoms that are printed, and how these agree with glyphs.

A formula is read once into a tree of groups, scripts and commands; what is wrong with it is noted on
the way. The atoms are a walk over the tree, in which each printed character knows its place in the
source, the scripts, styles and side of a fraction it stands in, and its accents.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from .alignment import aligned

_TOKEN = re.compile(r"\\[A-Za-z]+\*?|\\.|\\\Z|\s+|.", re.S)

# Names of commands.
_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
SYMBOLS = {name: unicodedata.lookup(f"GREEK SMALL LETTER {name.upper().replace('LAMBDA', 'LAMDA')}") for name in _GREEK}
SYMBOLS |= {name.capitalize(): unicodedata.lookup(f"GREEK CAPITAL LETTER {name.upper().replace('LAMBDA', 'LAMDA')}") for name in _GREEK}
SYMBOLS |= {
    "times": "×", "cdot": "⋅", "ast": "∗", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "equiv": "≡", "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪", "cap": "∩",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑", "prod": "∏", "int": "∫", "forall": "∀", "exists": "∃", "circ": "∘", "ldots": "…", "cdots": "⋯", "dagger": "†", "ddagger": "‡",
    "{": "{", "}": "}", "%": "%", "#": "#", "&": "&", "_": "_", "$": "$", "|": "‖",
}
FUNCTIONS = frozenset("arg argmax argmin cos det exp lim ln log max min mod Pr sin sup inf tan tanh".split())
STYLES = {"mathcal": "mathcal", "mathscr": "mathcal", "mathbb": "mathbb", "mathbf": "mathbf", "boldsymbol": "mathbf", "bm": "mathbf", "textbf": "mathbf", "mathit": "mathit", "textit": "mathit", "mathrm": "mathrm", "text": "text", "textrm": "textrm", "operatorname": "operatorname"}
_UPRIGHT = frozenset(("mathrm", "text", "textrm", "operatorname"))
FRACTIONS = frozenset(("frac", "dfrac", "tfrac"))
DRAWN = frozenset("bar tilde vec overline underline sqrt".split())
SPACING = frozenset("quad qquad displaystyle textstyle limits nolimits nonumber big Big bigg Bigg , ; : ! \\".split()) | {" "}
DELIMITERS = frozenset(["(", ")", "[", "]", "|", "/", ".", "\\{", "\\}", "\\|", "\\langle", "\\rangle", "\\lfloor", "\\rfloor", "\\lceil", "\\rceil"])
ENVIRONMENTS = frozenset("aligned align array bmatrix cases equation gathered matrix pmatrix split".split())

#: Commands that take arguments, and how many.
_ARGUMENTS = dict.fromkeys(STYLES, 1) | dict.fromkeys(FRACTIONS, 2) | dict.fromkeys(DRAWN, 1) | {"hat": 1, "tag": 1, "label": 1, "underset": 2, "overset": 2}


@dataclass
class Part:
    """A node: a printed character, a group, a script, or a command, and where it stands."""

    kind: str
    name: str = ""
    start: int = 0
    end: int = 0
    parts: list[Part] = field(default_factory=list)
    wants: int = 0


@dataclass
class Formula:
    """A formula's tree, its faults as (kind, place), and the commands that aren't known."""

    tree: Part
    faults: list[tuple[str, int]]
    unknown: list[str]


def read(text: str) -> Formula:
    """The tree of a formula. Groups and parts that still want an argument are open; what is complete goes to the last open one."""
    root = Part("group", start=-1)
    open_: list[Part] = [root]
    faults: list[tuple[str, int]] = []
    unknown: list[str] = []
    fences: list[tuple[Part, int]] = []
    blocks: list[tuple[str, Part, int]] = []

    def give(part: Part) -> None:
        while open_[-1].wants:
            to = open_[-1]
            to.parts.append(part)
            if len(to.parts) < to.wants:
                return
            open_.pop()
            to.end = part.end
            part = to
        if part.kind == "script":
            beside = [p for p in _last_scripts(open_[-1].parts) if p.name == part.name]
            if beside:
                faults.append(("duplicate_script", part.start))
        open_[-1].parts.append(part)

    def starve() -> None:
        """Parts that wait for an argument at the end of a group don't get it."""
        while open_[-1].wants:
            part = open_.pop()
            faults.append(("missing_argument", part.start))
            part.wants = 0
            if open_[-1].wants:
                give(part)
            else:
                open_[-1].parts.append(part)

    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    k = 0
    while k < len(found):
        token, start, end = found[k]
        k += 1
        if token.isspace() or token in "$&~":
            continue
        group = next(p for p in reversed(open_) if not p.wants)
        if token == "{":
            open_.append(Part("group", start=start))
        elif token == "}":
            starve()
            if open_[-1] is root:
                faults.append(("unexpected_closing_brace", start))
                continue
            done = open_.pop()
            done.end = end
            give(done)
        elif token in "_^":
            open_.append(Part("script", "sub" if token == "_" else "sup", start, end, wants=1))
        elif token == "\u0302":
            last = open_[-1].parts[-1] if open_[-1].parts else None
            if last is not None and last.kind == "char" and last.name.isalpha():
                open_[-1].parts[-1] = Part("command", "hat", last.start, end, [last])
        elif token == "\\":
            faults.append(("dangling_escape", start))
        elif token[0] != "\\":
            give(Part("char", token, start, end))
        else:
            name = token[1:]
            if name.endswith("*") and len(name) > 1:
                name = name[:-1]
            if name in ("left", "right"):
                while k < len(found) and found[k][0].isspace():
                    k += 1
                fence = found[k] if k < len(found) else None
                if fence is None or fence[0] not in DELIMITERS:
                    faults.append(("missing_math_delimiter" if fence is None else "invalid_math_delimiter", end))
                    continue
                k += 1
                if name == "left":
                    fences.append((group, start))
                elif fences and fences[-1][0] is group:
                    fences.pop()
                else:
                    faults.append(("orphan_right_delimiter", start))
                if fence[0] != ".":
                    give(Part("char", {"\\langle": "⟨", "\\rangle": "⟩", "\\lfloor": "⌊", "\\rfloor": "⌋", "\\lceil": "⌈", "\\rceil": "⌉", "\\|": "‖"}.get(fence[0], fence[0][-1]), fence[1], fence[2]))
            elif name in ("begin", "end"):
                named = re.compile(r"\s*\{([A-Za-z]+)\*?\}").match(text, end)
                if not named:
                    faults.append(("invalid_environment_name", end))
                    continue
                while k < len(found) and found[k][1] < named.end():
                    k += 1
                if named[1] not in ENVIRONMENTS:
                    faults.append(("unsupported_environment", start))
                if name == "begin":
                    blocks.append((named[1], group, start))
                elif not blocks:
                    faults.append(("orphan_end_environment", start))
                else:
                    opened, within, _ = blocks.pop()
                    if opened != named[1] or within is not group:
                        faults.append(("mismatched_environment", start))
            elif name in _ARGUMENTS:
                open_.append(Part("command", name, start, end, wants=_ARGUMENTS[name]))
            elif name in SYMBOLS:
                give(Part("char", SYMBOLS[name], start, end))
            elif name in FUNCTIONS:
                give(Part("function", name, start, end))
            elif name not in SPACING:
                unknown.append(name)
    starve()
    while open_[-1] is not root:
        part = open_.pop()
        faults.append(("unclosed_group", part.start))
        part.end = len(text)
        give(part)
        starve()
    faults += [("unclosed_left_delimiter", at) for _, at in fences] + [("unclosed_environment", at) for _, _, at in blocks]
    return Formula(root, sorted(faults, key=lambda f: f[1]), unknown + [p.name for p in _commands(root) if p.name in DRAWN])


def _last_scripts(parts: list[Part]) -> list[Part]:
    out = []
    for part in reversed(parts):
        if part.kind != "script":
            break
        out.append(part)
    return out


def _commands(part: Part) -> list[Part]:
    out, todo = [], [part]
    while todo:
        at = todo.pop()
        out += [at] if at.kind == "command" else []
        todo += at.parts
    return out


def atoms(formula: Formula) -> list[dict]:
    """The printed characters in order: text, start, end, scripts, styles, role (numerator, denominator, operator or None) and accents."""
    out: list[dict] = []
    todo: list[tuple] = [(formula.tree, (), (), None, ())]
    while todo:
        part, scripts, styles, role, accents = todo.pop()
        if part.kind in ("char", "function"):
            role = "operator" if part.kind == "function" else role
            for char in unicodedata.normalize("NFKC", part.name):
                out.append({"text": char, "start": part.start, "end": part.end, "scripts": list(scripts), "styles": list(styles), "role": role, "accents": list(accents)})
            continue
        below = [(p, scripts, styles, role, accents) for p in part.parts]
        if part.kind == "script":
            below = [(p, (*scripts, part.name), styles, role, accents) for p in part.parts]
        elif part.name in STYLES:
            below = [(p, scripts, (*styles, STYLES[part.name]), "operator" if part.name in _UPRIGHT else role, accents) for p in part.parts]
        elif part.name in FRACTIONS:
            below = [(p, scripts, styles, side, accents) for p, side in zip(part.parts, ("numerator", "denominator"), strict=False)]
        elif part.name == "hat":
            below = [(p, scripts, styles, role, (*accents, "hat")) for p in part.parts]
        elif part.name in ("underset", "overset"):
            over = (*scripts, "sub" if part.name == "underset" else "sup")
            below = [(p, scripts, styles, role, accents) for p in part.parts[1:]] + [(p, over, styles, role, accents) for p in part.parts[:1]]
        elif part.name in ("tag", "label"):
            below = []
        todo += reversed(below)
    return out


_ALPHABETS = frozenset(("mathcal", "mathbb", "mathbf"))


def score(formula: Formula, glyphs: list[dict]) -> dict:
    """How a formula differs from glyphs (text, script, styles, role, accents): 3 for each character without a partner and each fault, 2 for each other difference of partners."""
    ours = atoms(formula)
    a, b = "".join(x["text"] for x in ours), "".join(g["text"] for g in glyphs)
    pairs = aligned(a, b)
    wrong = {"styles": [], "scripts": [], "structure": [], "accents": []}
    for i, j in pairs:
        x, g = ours[i], glyphs[j]
        if x["text"].isalpha() and set(x["styles"]) & _ALPHABETS != set(g["styles"] or ()) & _ALPHABETS:
            wrong["styles"].append((i, j))
        if (x["scripts"][0] if x["scripts"] else None) != g["script"]:
            wrong["scripts"].append((i, j))
        side = x["role"] if x["role"] in ("numerator", "denominator") else None
        if len(x["scripts"]) > 1 or side != g["role"]:
            wrong["structure"].append((i, j))
        if x["accents"] != list(g["accents"] or ()):
            wrong["accents"].append((i, j))
    lexical = len(a) + len(b) - 2 * len(pairs)
    total = 3 * lexical + 2 * sum(map(len, wrong.values())) + 3 * len(formula.faults)
    return {"score": total, "lexical": lexical, "pairs": pairs, "coverage": len(pairs) / max(1, len(a)), "source_coverage": len(pairs) / max(1, len(b)), **wrong}


def repaired(text: str, glyphs: list[dict]) -> tuple[str, int]:
    """A formula with what the glyphs prove otherwise put right, and how many places that were.

    A single letter between two partners that stands for another letter takes that one's place, if
    half of the formula has partners; letters of another alphabet get it, if four fifths have; and if
    nothing else differs, letters that are set as scripts become scripts.
    """
    formula = read(text)
    ours, told = atoms(formula), score(formula, glyphs)
    partner = dict(told["pairs"])
    back = {j: i for i, j in partner.items()}
    changes: list[tuple[int, int, str]] = []

    def alone(i: int) -> bool:
        return sum(x["start"] == ours[i]["start"] for x in ours) == 1

    if told["coverage"] >= 0.5 and len(ours) > 1:
        for i, x in enumerate(ours):
            if i in partner or (i > 0 and i - 1 not in partner) or (i + 1 < len(ours) and i + 1 not in partner):
                continue
            j = partner[i - 1] + 1 if i else partner[i + 1] - 1
            fits = 0 <= j < len(glyphs) and j not in back and (i + 1 == len(ours) and j + 1 == len(glyphs) or i + 1 < len(ours) and partner[i + 1] == j + 1)
            if fits and (i or j == 0) and alone(i) and x["text"].isalpha() and glyphs[j]["text"].isalpha():
                changes.append((x["start"], x["end"], glyphs[j]["text"]))
    if told["coverage"] >= 0.8:
        for i, j in told["styles"]:
            wanted = [s for s in glyphs[j]["styles"] if s in _ALPHABETS]
            if wanted and alone(i) and not set(ours[i]["styles"]) & _ALPHABETS:
                source = text[ours[i]["start"] : ours[i]["end"]]
                for style in wanted:
                    source = f"\\{style}{{{source}}}"
                changes.append((ours[i]["start"], ours[i]["end"], source))
    if not told["lexical"] and not formula.faults and not formula.unknown and not told["styles"] and not told["structure"]:
        for i, j in told["scripts"]:
            if not ours[i]["scripts"] and alone(i):
                changes.append((ours[i]["start"], ours[i]["end"], f"{{}}{'^' if glyphs[j]['script'] == 'sup' else '_'}{{{text[ours[i]['start'] : ours[i]['end']]}}}"))
    for start, end, new in sorted(changes, reverse=True):
        text = text[:start] + new + text[end:]
    return text, len(changes)


def assess(candidates: list[tuple[str, str | None]], glyphs: list[dict]) -> dict:
    """The candidate (engine, text) that differs least from the glyphs, or the first one where that proves too little; the first one's repair is a candidate too."""
    first = candidates[0][1] or ""
    better, changes = repaired(first, glyphs)
    listed = [(name, text) for name, text in candidates if text is not None] + ([("repair", better)] if changes else [])
    told = [(score(read(text), glyphs), k, name, text) for k, (name, text) in enumerate(listed)]
    best, _, engine, text = min(told, key=lambda x: (x[0]["score"], x[1]))
    formula = read(text)
    proved = bool(glyphs) and best["coverage"] >= 0.9 and best["source_coverage"] >= 0.85 and not (best["lexical"] or formula.faults or formula.unknown or best["structure"] or best["scripts"] or best["styles"] or best["accents"])
    if not proved:
        engine, text = candidates[0][0], first
    status = "confirmed" if proved else "unresolved" if glyphs else "unsupported"
    return {"engine": engine, "text": text, "status": status, "score": best["score"], "changes": changes, "faults": [kind for kind, _ in read(first).faults]}
