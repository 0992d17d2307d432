"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from tradewind.llm import phrases as x


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        kept = []
        for p, a in often.items():
            if inside.get(p, -1) >= a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed=11):
    r = random.Random(seed)
    names = "a b c The of und x\x1cy é Z".split(" ")
    rows = [(None, None), ("en", ""), ("en", " \t.,;"), ("en", "One lonely text"), ("xx", "a b. a b")]
    lines = [" ".join(r.choice(names) for _ in range(r.randrange(4, 9))) for _ in range(3)]
    for i in range(400):
        words = []
        for _ in range(r.randrange(1, 25)):
            words.append(r.choice(names) if r.random() < 0.8 else r.choice(lines))
            if r.random() < 0.15:
                words[-1] += r.choice([".", ",", ";", ":", "!", "?", "\n", "\r\n", "\x0b", "\t", "  "])
        rows.append((r.choice(["en", "de", None]), " ".join(words)))
    return rows + rows[50:60]


@pytest.mark.parametrize(("least", "split", "chunk", "top"), [(5, 10**6, 10**6, 2000), (5, 60, 300, 50), (8, 10, 700, 7)])
def test_collocations(spark, least, split, chunk, top):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, node int, n int").repartition(4)
    got = sorted(map(tuple, x.collocations(docs, least=least, split=split, chunk=chunk, top=top).collect()))
    want = brute(rows, least, top)
    assert got == want and len(want) > 20


def test_nothing(spark):
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert x.collocations(docs).count() == 0
    assert x.collocations(docs.limit(0), split=1).count() == 0


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", ["p"], 10**12), ("en", ["q"], 3 * 10**12), ("en", ["p", "q"], 10**12 - 7)], "lang string, words array<string>, n long")
    totals = spark.createDataFrame([("en", 10**17 + 3)], "lang string, total long")
    row = x.scored(phrases, totals).first()
    assert row.score == 1000 * (10**12 - 7) * (10**17 + 3) // (3 * 10**24)
