"""The language model: base counts by brute force, a true distribution, and held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from tradewind.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def corpus():
    """Two invented languages; the words before tell which."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        lang = r.choice(["ka", "ro"])
        fun = {"ka": ["the", "of", "and"], "ro": ["der", "und", "zu"]}[lang]
        end = {"ka": ["ing", "tion", "ed"], "ro": ["ung", "keit", "lich"]}[lang]
        rows.append((i, " ".join(r.choice(fun) if r.random() < 0.4 else f"{lang}{r.randrange(60)}{r.choice(end)}" for _ in range(r.randrange(5, 120)))))
    return [*rows, (1000, None), (1001, ""), (1002, "É é A a " * 3000), (None, "the of"), (5, rows[5][1]), (1003, "x\x1cy\xa0z")]


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, block int, held boolean").repartition(5)
    got = lm.lm_scores(docs, rounds=6).collect()
    count = Counter(w for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # closer to nought: a likelier text
    assert all(r.score < 0 for r in got)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def model_of(docs, rounds=3):
    table = lm.blocks(docs)
    counted = lm.count_words(table)
    return table, counted, lm.fit(table, counted, rounds)


def test_it_is_a_distribution(spark):
    table, _, m = model_of(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4))
    at = np.arange(0, lm.HISTORIES, 997)
    r = np.random.default_rng(1)
    table_, history = lm.class_shares(m.weights, at)
    share, total = lm.shares(table_, m.ratios, history, r.integers(0, len(m.ratios), (len(at), lm.WORD_FEATURES)))
    assert np.abs((share.astype(float) / total[:, None]).sum(axis=1) - 1).max() < 1e-9 and np.abs(np.log(m.ratios)).max() > 0.01
    seen = {}
    for row in table.collect():
        h, s, c = np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.signatures, np.uint16), np.frombuffer(row.counts, np.int64)
        for a, k, x in zip(h.tolist(), m.classes.of(h, s).tolist(), c.tolist(), strict=True):
            seen[a] = (k, seen.get(a, (k, 0))[1] + x)
    inner = np.zeros(lm.CLASSES)
    for k, x in seen.values():
        if x:
            inner[k] += (x + 1) / (m.class_tokens[k] + m.class_types[k] + 1)
    inner += 1 / (m.class_tokens + m.class_types + 1)  # the unknown word of each class
    assert np.abs(inner - 1)[m.class_types > 0].max() < 1e-9
    assert m.types == sum(x > 0 for _, x in seen.values()) and m.class_tokens.sum() == m.tokens


def test_score_by_brute_force(spark):
    """Each text's score word by word, from the weights, with features and counts told anew."""
    rows = [(i, t) for i, t in corpus() if i is not None and (t is None or len(t) < 2000)][:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table, counted, m = model_of(docs)
    hashed = lambda w: lm._END if w is None else xxhash.xxh64_intdigest(w.encode(), 0)
    kind = lambda w: 0 if w is None else int(m.classes.of(np.array([hashed(w)], np.uint64), np.array([lm.signature(w.encode())]))[0])
    count = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    size, types = Counter(), Counter()
    for w, c in count.items():
        size[kind(w)] += c
        types[kind(w)] += 1

    def log_p(w, before):
        a, b, c = map(kind, before)
        logit = np.zeros(lm.CLASSES)
        for f in lm.features(np.array([a + b * lm.CLASSES + c * lm.CLASSES**2]))[0]:
            logit += m.weights[f]
        ends = [None] * 3 if before[0] is None else [*reversed([x for x in before if x is not None])]
        text = [x for x in ends if x is not None] + [w]
        for f in lm.word_rows(np.array([hashed(x) for x in text], np.uint64), np.zeros(len(text), int), len(m.ratios) // lm.WORD_FEATURES)[-1]:
            logit += np.log(m.ratios[f])
        k = kind(w)
        return logit[k] - math.log(sum(math.exp(x) for x in logit)) + math.log((count[w] + 1) / (size[k] + types[k] + 1))

    want = {}
    for d, t in rows:
        text = [None, None, None, *words(t)]
        want[d] = sum(log_p(text[i], (text[i - 1], text[i - 2], text[i - 3])) for i in range(3, len(text))) / math.log(10)
    got = {r.doc_id: r.score for r in lm.score(table, counted, m).collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-4 * max(1, -want[d]) for d in want)


def test_word_weights_by_brute_force(spark):
    """One row's weights from the texts: what was seen after its words, less what is expected after their classes."""
    docs = [(i, t) for i, t in corpus() if i is not None and (t is None or len(t) < 2000)]
    _, _, m = model_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    rows = len(m.ratios) // lm.WORD_FEATURES
    hashed = lambda w: np.uint64(lm._END if w is None else xxhash.xxh64_intdigest(w.encode(), 0))
    kind = lambda w: 0 if w is None else int(m.classes.of(np.array([hashed(w)]), np.array([lm.signature(w.encode())]))[0])
    row = lambda w: int(lm.word_rows(np.array([hashed(w), 0], np.uint64), np.zeros(2, int), rows)[1, 0])
    seen, before, pairs = np.zeros((rows, lm.CLASSES)), np.zeros((rows, lm.CLASSES)), np.ones((lm.CLASSES, lm.CLASSES))
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            text = [None, *words(t)]
            for a, b in zip(text, text[1:]):
                seen[row(a), kind(b)] += 1
                before[row(a), kind(a)] += 1
                pairs[kind(a), kind(b)] += 1
    n = seen.sum(axis=1, keepdims=True)
    share = np.where(n > 0, before @ (pairs / pairs.sum(axis=1, keepdims=True)) / np.maximum(n, 1), 1 / lm.CLASSES)
    want = ((seen + lm.PRIOR * share) / ((n + lm.PRIOR) * share)) ** lm.WORD_STEP
    assert np.allclose(m.ratios[:rows], want, rtol=1e-5)


def test_word_features_grow_and_learn(spark):
    """The word before the last decides; its class doesn't tell."""
    r = random.Random(6)
    pairs = {f"q{i}ab": f"z{i}{r.choice(['ing', 'ung'])}" for i in range(40)}
    texts = [" ".join(x for _ in range(60) for x in (lambda w: (w, pairs[w]))(r.choice([*pairs]))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    _, _, m = model_of(rows)
    assert len(m.ratios) >= lm.WORD_FEATURES * m.tokens**0.5
    table, counted, m = model_of(rows)
    flat = lm.Model(**{**m.__dict__, "ratios": np.ones_like(m.ratios)})
    score = lambda model: sum(x.score for x in lm.score(table, counted, model).collect() if x.held_out)
    assert score(m) > score(flat)


def test_histories_stop_at_texts():
    cls, doc = np.array([5, 6, 0, 7, 0]), np.array([0, 0, 0, 1, 1])
    c = lm.CLASSES
    assert lm.histories(cls, doc).tolist() == [0, 5, 6 + 5 * c, 0, 7]
