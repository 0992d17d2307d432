"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from tradewind.llm import word_runs as x


def brute_runs(words):
    """All maximal stretches by their smallest period, straight from the definition."""
    out = []
    n = len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - a
            if length >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(a, a + length - q)) for q in range(1, p)):
                out.append((a, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [v for v in w if v]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    listing = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    rest = " ".join(v for i, v in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listing), sha(rest), rest)


def corpus():
    r = random.Random(4)
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a\x0bb\x0c" * 9, "A a " * 8, "x y \x1c " * 9, "é ü " * 400, "end " + "p q r " * 50 + "p q"]
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(1, 7)):
            unit = [r.choice("abcd") for _ in range(r.randrange(1, 7))]
            parts += unit * r.randrange(1, 9) + unit[: r.randrange(len(unit) + 1)]
            parts += [r.choice("abcdefgh") for _ in range(r.randrange(0, 4))]
        texts.append(" ".join(parts))
    for _ in range(150):
        texts.append(" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 200))))
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9), (None, None), (3, "z " * 7), (3, "z " * 7)]


def test_find_runs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, start int, period string").repartition(3)
    got = sorted(map(tuple, x.find_runs(docs, plant=True, collapsed=True).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[2] for r in got) > 300 and x.find_runs(docs.limit(0)).count() == 0
    plain = x.find_runs(docs)
    assert plain.columns[-1] == "collapsed_sha256" and plain.count() == len(rows)


def test_strings_of_two_letters():
    """Dense runs of all shapes, alone and several texts together."""
    r = random.Random(9)
    texts = [[r.randrange(2 + k % 2) for _ in range(r.randrange(1, 90))] for k in range(500)] + [[0] * 300, [0, 1] * 200, [0, 1, 1] * 70 + [1] * 9]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1] * 4, fib[-1]]
    ids, text = np.array([v for t in texts for v in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = {}
    for k, run in x.word_runs(ids, text):
        got.setdefault(k, []).append(run)
    for k, t in enumerate(texts):
        assert got.get(k, []) == brute_runs(t), t


def test_a_very_long_text():
    words = [f"w{i}" for i in range(1000)] * 300  # one run of 300 periods
    assert x.word_runs(np.array([int(w[1:]) for w in words]), np.zeros(len(words), np.int64)) == [(0, (0, 300_000, 1000))]
