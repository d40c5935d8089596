"""Detectors on random texts made of awkward pieces, against plain patterns."""

import random
import re

from test_operators import plain_spans

from quire.llm import pii, secret_scan

PIECES = ["0", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", ".", "..", "+", "-", " ", "  ", "(", ")", "@", "a", "b.c", "_d", "%", "é", "😀", "\n", "1.2.3.4", "x@y.z", "+44 20 7946 0958", "9" * 15]
WORDS = ["token", "TOKEN", "Secret", "api_key", "apikey", "password", "passwd", "ſecret", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "abcdef12", "short", "deadbeef" * 4, "0123456789abcdef" * 2, ".", "-", "_", "é", "😀", "\n", "ghp_" + "a" * 40, "eyJ"]


def texts(pieces, seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(n)]


def test_personal_data(spark):
    sample = texts(PIECES, 1)
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id bigint, text string")
    got = {r.doc_id: sorted((s.start, s.k, s.end) for s in r.spans if s.kind != "term") for r in pii.find(df).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(sample)}


def plain_secrets(text):
    out = []
    for k, (p, keep) in enumerate((
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text, re.ASCII) if keep(m)]
    return sorted(out)


def test_secrets(spark):
    sample = texts(WORDS, 2)
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id bigint, text string")
    got = {r.doc_id: sorted((s.start, s.k, s.end) for s in r.spans if s.k < 3) for r in secret_scan.scan(df).collect()}
    assert got == {i: plain_secrets(t) for i, t in enumerate(sample)}
