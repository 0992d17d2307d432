"""Exact dedup against brute force."""

import hashlib

import numpy as np
import pytest

from tradewind.llm import exact_dedup as x

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        k = (t or "").translate(LOWER)
        keep = max((v for v in groups[k] if v is not None), default=None)
        out.append((d, keep, len(groups[k]), d == keep, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_hash_is_perfect_and_minimal(n):
    d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), "V32")
    import pyarrow as pa

    seeds, slots = x._slots(d, pa.array(range(n), pa.int64()), np.ones(n, np.int64))
    at = x.lookup(d, seeds, slots)
    assert sorted(at.tolist()) == list(range(n)) and slots["winner"][at].tolist() == list(range(n))
    other = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(n)), "V32")
    assert (x.lookup(other, seeds, slots) == -1).all()


def test_exact_dedup(spark, monkeypatch):
    rows = [(i, ["A b", "a B", None, "", "É", "é", f"only {i}", "Z" * 70_000][i % 8]) for i in range(400)] + [(7, "a b"), (7, "a b"), (None, "nobody"), (None, "a b"), (5000, "hot"), *((6000 + i, "HOT") for i in range(700))]
    docs = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, digest string, kept int").repartition(5)
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got(x.exact_dedup(docs)) == brute(rows)
    monkeypatch.setattr(x, "BUCKET_DIGESTS", 4)
    assert got(x.exact_dedup(docs)) == brute(rows)
    assert x.exact_dedup(docs.limit(0)).count() == 0


def test_history(spark):
    old = spark.createDataFrame([(100, "a"), (90, "A"), (80, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "C"), (100, "a"), (80, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in x.exact_dedup(new, x.text_digests(old)).collect()}
    assert got == {(1, 100, False), (2, 3, False), (3, 3, True), (100, 100, True), (80, 80, True)}
