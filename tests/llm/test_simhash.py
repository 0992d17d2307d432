"""SimHash fingerprints, tiles and components against brute force."""

import random
import re

import numpy as np
import xxhash

from tradewind.llm import simhash
from tradewind.llm.components import stars

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=3):
    n = len(fps)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def texts():
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi".split()) + str(r.randrange(40))
    out = [None, "", " \n ", "One", "one", "one two", "One TWO", "one two three", "É é ß x y", "w " * 2000]
    for _ in range(40):
        base = [word() for _ in range(r.randrange(5, 900))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            base[r.randrange(len(base))] = word()
            out.append("\n".join(base))
    return out


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_LEAST", 8)
    monkeypatch.setattr(simhash, "PIECE", 4)
    rows = [(500 - i, t, "x") for i, t in enumerate(texts())] + [(None, "one", "y"), (None, "nobody else at all here", "y"), (3, "One", "z"), (3, "One", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    fps = [brute_fp(t) for _, t, _ in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _, _), f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows]), strict=True)), key=repr)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_tiles_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_LEAST", 64)
    monkeypatch.setattr(simhash, "PIECE", 16)
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(600)]
    for _ in range(900):
        f = r.choice(fps)
        for _ in range(r.randrange(1, 4)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(4)
    star = {x.u: x.v for x in stars(simhash.links(nodes)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    assert [star.get(s, s) for s in signed] == brute_components(fps, signed)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 400)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.u: r.v for r in stars(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 200 for i in range(201, 400)}, 500: 499}
    assert stars(spark.createDataFrame([], "u long, v long")).count() == 0
