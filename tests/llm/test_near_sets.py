"""Near duplicates by shingle sets against brute force."""

import random

import corpus_pipeline
from tradewind.llm import near_sets as x


def brute(rows):
    """Component of each row over all pairs at similarity 0.8 or more; row sets by plain strings."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((rows[i][0], min(ids, default=None)))
    return sorted(out, key=repr)


def corpus():
    """Near copies at similarities around 0.8 and chains of them."""
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta".split()) + str(r.randrange(300))
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.randrange(3, 200))]
        for k in range(r.randrange(1, 6)):
            rows.append((997 * (len(rows) + 1) % 1009, " ".join(words)))
            for _ in range(r.randrange(0, max(1, len(words) // 25) + 1)):
                words[r.randrange(len(words))] = word()
    return [*rows, (None, rows[0][1].upper()), (2000, None), (2001, ""), (None, "alone with no id")]


def test_near_sets(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").repartition(5)
    want = brute(rows)
    assert sum(d != c for d, c in want) > 40
    assert sorted(map(tuple, x.near_sets(docs).collect()), key=repr) == want
    assert x.near_sets(docs.limit(0)).count() == 0


def test_pipeline_stage_links_what_fingerprints_miss(spark):
    from tradewind.llm.simhash import near_duplicates

    r = random.Random(8)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    copy = list(words)
    for i in (40, 120, 200, 280):  # 20 of 296 shingles differ
        copy[i] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "something else altogether here now")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {d.doc_id for d in near_duplicates(docs).filter("doc_id = component_id").collect()} == {1, 2, 3}
    assert {d.doc_id for d in stage(spark, docs, "").collect()} == {1, 3}
