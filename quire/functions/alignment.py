"""Alignment of two texts: anchors first, then the longest common subsequence between them."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

#: Cells of a gap that is compared as a whole; a larger one is divided by anchors, or halved where it has none.
CELLS = 16_000_000
#: Lengths of anchors, tried in this order.
_GRAMS = (32, 16, 8, 4)


def common_subsequence(a: str, b: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. A row of the table is one number, in which a 0 marks each place of `b` where the length grows."""
    full = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for j, char in enumerate(b):
        places[char] = places.get(char, 0) | 1 << j
    rows = [full]
    for char in a:
        row = rows[-1]
        hit = row & places.get(char, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        mask = (1 << j) - 1
        if rows[i] >> (j - 1) & 1:
            j = (~rows[i] & mask).bit_length()
        elif (rows[i - 1] & mask).bit_count() == (rows[i] & mask).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _unique(text: str, k: int) -> dict[str, int]:
    """Places of the runs of k characters that occur once."""
    seen: dict[str, int] = {}
    for i in range(len(text) - k + 1):
        gram = text[i : i + k]
        seen[gram] = -1 if gram in seen else i
    return {gram: i for gram, i in seen.items() if i >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by their first places, whose second places rise."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        ends[n:], at[n:] = [j, *ends[n + 1 :]], [k, *at[n + 1 :]]
        before[k] = at[n - 1] if n else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _equal(a: str, i: int, a1: int, b: str, j: int, b1: int) -> int:
    """How many characters from `i` and `j` on are equal, within the ends."""
    most, n, step = min(a1 - i, b1 - j), 0, 16
    while n < most and a[i + n : i + min(n + step, most)] == b[j + n : j + min(n + step, most)]:
        n, step = min(n + step, most), step * 4
    if n == most:
        return n
    step = min(step, most - n)
    while step > 1:  # the first `step` characters from here on differ somewhere
        half = step // 2
        if a[i + n : i + n + half] == b[j + n : j + n + half]:
            n, step = n + half, step - half
        else:
            step = half
    return n


def _embedded(a: str, a0: int, a1: int, b: str, b0: int, b1: int) -> tuple[list[tuple[int, int, int]], int]:
    """Runs of the leftmost places at which the characters of `b` follow each other in `a`, up to the first that doesn't, and its place."""
    out = []
    while b0 < b1:
        a0 = a.find(b[b0], a0, a1)
        if a0 < 0:
            break
        n = _equal(a, a0, a1, b, b0, b1)
        out.append((a0, b0, n))
        a0, b0 = a0 + n, b0 + n
    return out, b0


def aligned_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs (place, place, length) of equal characters, rising on both sides; a longest such alignment where the texts' product is within CELLS."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if n := _equal(a, a0, a1, b, b0, b1):
            out.append((a0, b0, n))
            a0, b0 = a0 + n, b0 + n
        n = 0
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, n = a1 - 1, b1 - 1, n + 1
        if n:
            out.append((a1, b1, n))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= CELLS:
            # A text of which all but one character at the end follow each other in the other one has no longer alignment, and the table would find the leftmost one, too.
            runs, end = _embedded(a, a0, a1, b, b0, b1)
            out += runs if end >= b1 - 1 else [(a0 + i, b0 + j, 1) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        for k in _GRAMS:
            ours, theirs = _unique(a[a0:a1], k), _unique(b[b0:b1], k)
            anchors = _rising([(i, theirs[gram]) for gram, i in ours.items() if gram in theirs])
            if anchors:
                break
        else:
            middle = ((a0 + a1) // 2, (b0 + b1) // 2)
            todo += [(a0, middle[0], b0, middle[1]), (middle[0], a1, middle[1], b1)]
            continue
        # Anchors that overlap are thinned, so that each gap lies behind the one before.
        x, y = a0, b0
        for i, j in anchors:
            i, j = a0 + i, b0 + j
            if i < x or j < y:
                continue
            todo.append((x, i, y, j))
            out.append((i, j, k))
            x, y = i + k, j + k
        todo.append((x, a1, y, b1))
    return sorted(out)


def aligned(a: str, b: str) -> list[tuple[int, int]]:
    """Pairs of places of equal characters, as `aligned_runs` has them."""
    return [(i + d, j + d) for i, j, n in aligned_runs(a, b) for d in range(n)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _plain(text: str) -> tuple[str, np.ndarray]:
    """Characters as they are compared (compatible forms apart), and the place in `text` that each stems from."""
    apart = {c: n for c in set(text) if (n := unicodedata.normalize("NFKD", c)) != c}
    if not apart:
        return text, np.arange(len(text))
    codes, length = _codes(text), np.ones(len(text), dtype=np.int64)
    for c, n in apart.items():
        if len(n) != 1:
            length[codes == ord(c)] = len(n)
    at = np.repeat(np.arange(len(text)), length)
    if len(apart) > 100:
        return text.translate(str.maketrans(apart)), at
    for c, n in apart.items():  # none of what comes in is taken apart again
        text = text.replace(c, n)
    return text, at


def _are(text: str, codes: np.ndarray, test: str) -> np.ndarray:
    """For which characters str's `test` holds."""
    return np.isin(codes, [ord(c) for c in set(text) if getattr(c, test)()])


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def style_rows(texts: list[str], sources: list[str], counts: Sequence[int], lengths: Sequence[int], styles: np.ndarray, names: list[str], excluded: dict[int, list[tuple[int, int]]] | None = None) -> list[dict]:
    """`style_spans` of many texts at once.

    `sources`: the glyphs' text of each row, `counts`: its glyphs; `lengths`: characters of each glyph of
    all rows, and `styles`: its styles as bits of `names`. Texts are aligned one by one, the rest is
    done for all characters of the rows together.
    """
    whole, sizes = "".join(texts), np.array([len(t) for t in texts], dtype=np.int64)
    start = _starts(sizes)
    target, target_at = _plain(whole)
    source, source_at = _plain("".join(sources))
    t_start = np.searchsorted(target_at, start)
    s_start = np.searchsorted(source_at, _starts(np.array([len(x) for x in sources], dtype=np.int64)))
    t_ends, s_ends = t_start.tolist(), s_start.tolist()
    matched, runs = [], []
    for r in range(len(texts)):
        t0, s0 = t_ends[r], s_ends[r]
        own = aligned_runs(target[t0 : t_ends[r + 1]], source[s0 : s_ends[r + 1]])
        matched.append(sum(n for _, _, n in own))
        runs += [(t0 + i, s0 + j, n) for i, j, n in own]
    place = np.array(runs, dtype=np.int64).reshape(-1, 3)
    each = np.arange(place[:, 2].sum()) - np.repeat(_starts(place[:, 2])[:-1], place[:, 2])
    text_at = target_at[np.repeat(place[:, 0], place[:, 2]) + each]
    glyph_at = np.repeat(np.arange(len(lengths)), lengths)[source_at[np.repeat(place[:, 1], place[:, 2]) + each]]

    row_of, codes = np.repeat(np.arange(len(texts)), sizes), _codes(whole)
    blank = _are(whole, codes, "isspace")
    t_sizes = np.diff(t_start)
    told = np.array(matched) / np.maximum(1, t_sizes) >= 0.75
    mapped = np.zeros(len(whole), dtype=bool)
    mapped[text_at] = True
    left_out = np.zeros(len(whole), dtype=bool)
    for r, ranges in (excluded or {}).items():
        for a, b in ranges:
            left_out[start[r] + max(a, 0) : start[r] + min(max(b, 0), sizes[r])] = True
    own_style = np.zeros(len(whole), dtype=styles.dtype)
    if len(text_at):
        first = np.flatnonzero(np.diff(text_at, prepend=-1))
        own_style[text_at[first]] = np.bitwise_and.reduceat(styles[glyph_at], first)
    own_style[blank | left_out | ~told[row_of]] = 0
    # White space has what the nearest visible characters on both sides of it share.
    gaps = np.flatnonzero(blank & ~left_out)
    seen = np.flatnonzero(~blank)
    if len(gaps) and len(seen):
        k = np.searchsorted(seen, gaps)
        before, after = seen[np.maximum(k - 1, 0)], seen[np.minimum(k, len(seen) - 1)]
        inside = (k > 0) & (k < len(seen)) & (row_of[before] == row_of[gaps]) & (row_of[after] == row_of[gaps])
        own_style[gaps[inside]] = own_style[before[inside]] & own_style[after[inside]]
    spans: list[list[dict]] = [[] for _ in texts]
    if len(whole):
        begin = np.flatnonzero(np.concatenate([[True], (own_style[1:] != own_style[:-1]) | (row_of[1:] != row_of[:-1])]))
        end = np.append(begin[1:], len(whole))
        good = (own_style[begin] != 0) & np.logical_or.reduceat(_are(whole, codes, "isalnum"), begin) & np.logical_or.reduceat(mapped, begin)
        begin, end = begin[good], end[good]
        listed: dict[int, list[str]] = {}
        for r, a, b, bits in zip(row_of[begin].tolist(), begin.tolist(), end.tolist(), own_style[begin].tolist(), strict=True):
            if bits not in listed:
                listed[bits] = sorted(n for i, n in enumerate(names) if bits >> i & 1)
            spans[r].append({"start": a - int(start[r]), "end": b - int(start[r]), "styles": listed[bits]})
    s_sizes = np.diff(s_start).tolist()
    states = ["confirmed" if ok and n and n == m else "unresolved" if glyphs else "unsupported" for ok, n, m, glyphs in zip(told.tolist(), s_sizes, matched, counts, strict=True)]
    return [{"matched": m, "target_chars": n, "source_chars": o, "status": state, "spans": x} for m, n, o, state, x in zip(matched, t_sizes.tolist(), s_sizes, states, spans, strict=True)]


def bits(listed: Sequence[Sequence[str]], names: list[str]) -> np.ndarray:
    """Each list of styles as bits of `names`; more than 62 names take Python's numbers."""
    at = {n: 1 << i for i, n in enumerate(names)}
    return np.array([sum(at[n] for n in set(x)) for x in listed], dtype=np.int64 if len(names) <= 62 else object)


def style_spans(text: str, glyphs: list[dict], excluded: list[tuple[int, int]] = ()) -> dict:
    """Coverage of both sides, status, and spans of `text` that carry the styles of the glyphs (text, styles) they stand for.

    A character has the styles that all its glyphs share; white space has what both visible
    neighbours agree in; a span needs a letter or digit. Below three quarters of the text nothing is told.
    """
    names = sorted({n for g in glyphs for n in g["styles"] or ()})
    styles = bits([g["styles"] or () for g in glyphs], names)
    return style_rows([text], ["".join(g["text"] for g in glyphs)], [len(glyphs)], [len(g["text"]) for g in glyphs], styles, names, {0: list(excluded)})[0]
