"""MinHash near duplicates against brute force over all pairs."""

import random

import numpy as np

from tradewind.llm import minhash_join as x


def brute(rows, k=2):
    """(doc_id, n_shingles, component_id, kept) over all pairs of rows, sets by plain strings."""
    sets = []
    for _, t in rows:
        w = [v.lower() for v in (t or "").split(" ") if v]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), c := least.get(find(i)) if sets[i] else d, d == c) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    """Near copies around the threshold, chains of them, a large group, and texts of a template that aren't linked."""
    r = random.Random(7)
    word = lambda: r.choice("Alpha beta gamma delta".split()) + str(r.randrange(300))
    texts = []
    for _ in range(50):
        words = [word() for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(1, 6)):
            texts.append(" ".join(words))
            for _ in range(r.randrange(0, max(1, len(words) // 14) + 1)):
                words[r.randrange(len(words))] = word()
    base = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(80)] = word()
        texts.append(" ".join(copy))
    frame = [word() for _ in range(70)]
    texts += [" ".join(frame + [word() for _ in range(30)]) for _ in range(40)]
    texts += ["one", "ONE", "two words", "Two  words", "", None, " ", texts[0].upper()]
    ids = r.sample(range(5000), len(texts))
    return [*zip(ids, texts, strict=True), (None, texts[3]), (None, "alone without id"), (None, ""), (7001, texts[9]), (7001, texts[9]), (7002, "same id here"), (7002, "other text of it")]


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5, "n") for r in rows], "doc_id long, text string, size int, node string").repartition(5)
    got = sorted(map(tuple, x.near_duplicates(docs).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert sum(not r[3] for r in want) > 100
    assert x.near_duplicates(docs.limit(0)).count() == 0


def test_templates_make_few_pairs(spark, monkeypatch):
    """1,000 texts with 70 of 100 words in common (0.5) aren't linked and mostly never compared."""
    r = random.Random(3)
    frame = " ".join(f"f{i}" for i in range(70))
    docs = spark.createDataFrame([(i, frame + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(1000)], "doc_id long, text string").repartition(4)
    seen = []
    whole = x.checked
    monkeypatch.setattr(x, "checked", lambda pairs, *a: (seen.append(pairs.count()), whole(pairs, *a))[1])
    assert x.near_duplicates(docs, words=5).filter("kept").count() == 1000
    assert len(seen) == 3 and sum(seen) < 10_000  # of 499,500


def test_the_exact_join_finds_all_that_hubs_miss(spark, monkeypatch):
    """Without any link from the lists' ends and from pairs all links come from the sets' rarest shingles."""
    monkeypatch.setattr(x, "FEW", 1)
    monkeypatch.setattr(x, "against_least", lambda lists: lists.select(x.F.col("node").alias("u"), x.F.col("node").alias("v")).limit(0))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, x.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_signatures():
    """Collisions estimate the similarity, whatever the sizes; blocks don't change a signature."""
    r = np.random.default_rng(5)
    for n, both in ((10, 8), (100, 80), (50_000, 40_000)):
        u = r.integers(0, 1 << 63, n).astype(np.uint64)
        shares = []
        for _ in range(10 if n < 1000 else 2):
            u = r.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = np.unique(u[: both + (n - both) // 2]), np.unique(np.concatenate([u[:both], u[both + (n - both) // 2 :]]))
            s = x.signatures([a, b, np.zeros(0, np.uint64)])
            assert (s == np.concatenate([x.signatures([a]), x.signatures([b]), np.zeros((1, x.COORDS))])).all()
            shares.append((s[0] == s[1]).mean())
        assert abs(np.mean(shares) - 0.8) < 0.08
