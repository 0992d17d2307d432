"""Exact dedup by a minimal perfect hash over the distinct digests seen so far.

The index is cut into buckets by digest prefix. Each bucket holds a minimal perfect hash
(displacement seeds) and slots with the full 32-byte digest, the winner's locator and the
group's size. A lookup hashes a digest to one slot and compares all 32 bytes: a member finds
its winner, anything else is told apart for certain.

Rows travel as 40 bytes (id and digest). Digests that many rows share (more than 1/1024 of
all rows, so at most 1024 of them) form a bucket of their own that every task has; so no
group of copies, however large, meets in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import map_arrow, narrow, small_batches, stash

#: Digests in a bucket, on average: a bucket takes about 2 MB.
BUCKET_DIGESTS = 32_768
#: Most digests that go to all tasks.
HOT_DIGESTS = 1024
_LOAD = 4  # keys for each displacement seed
_GOLD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
_INDEX = "bucket long, seeds binary, slots binary"
_SLOT = np.dtype([("digest", "V32"), ("winner", "<i8"), ("has_winner", "u1"), ("size", "<i8")])


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; null text counts as empty."""
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> dict:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        return {"doc_id": b.column("doc_id"), "digest": pa.array([hashlib.sha256(t.lower()).digest() for t in texts], pa.binary())}

    return map_arrow(narrow(docs, id_col, text_col), f, "doc_id long, digest binary")


def _words(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)


def _place(words: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key under its seed."""
    x = words[:, 1] ^ ((seed.astype(np.uint64) + np.uint64(1)) * _GOLD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)  # a splitmix64 multiplier
    x ^= x >> np.uint64(32)
    x += words[:, 2]
    x ^= x >> np.uint64(31)
    return (x % np.uint64(n)).astype(np.int64)


def build_hash(digests: np.ndarray) -> np.ndarray:
    """Displacement seeds of a minimal perfect hash of distinct digests (V32).

    Keys are dealt into groups; the largest groups choose first the least seed that sends
    all their keys to free slots.
    """
    n = len(digests)
    words = _words(digests)
    groups = max(1, -(-n // _LOAD))
    group = (words[:, 0] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seeds, used = np.zeros(groups, "<u4"), np.zeros(n, bool)
    tries = 256
    for g in np.argsort(-sizes, kind="stable"):
        m = sizes[g]
        if not m:
            break
        keys = words[order[starts[g] : starts[g + 1]]]
        first = 0
        while True:
            cand = np.arange(first, first + tries, dtype=np.uint64)
            at = _place(np.repeat(keys, tries, axis=0), np.tile(cand, m), n).reshape(m, tries)
            ok = ~used[at].any(axis=0)
            if m > 1 and ok.any():
                s = np.sort(at, axis=0)
                ok &= (s[1:] != s[:-1]).all(axis=0)
            hit = np.flatnonzero(ok)
            if len(hit):
                seeds[g] = first + hit[0]
                used[at[:, hit[0]]] = True
                break
            first += tries
            tries = min(tries * 2, 65_536)
        tries = 64 if m > 1 else 1024
    return seeds


def lookup(digests: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1 where the slot's 32 bytes differ."""
    if not len(digests) or not len(slots):
        return np.full(len(digests), -1, np.int64)
    words = _words(digests)
    seed = seeds[(words[:, 0] % np.uint64(len(seeds))).astype(np.int64)]
    at = _place(words, seed, len(slots))
    return np.where((_words(np.ascontiguousarray(slots["digest"][at])) == words).all(axis=1), at, -1)


def _slots(digest: np.ndarray, winner: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seeds = build_hash(digest)
    out = np.zeros(len(digest), _SLOT)
    words = _words(digest)
    at = _place(words, seeds[(words[:, 0] % np.uint64(len(seeds))).astype(np.int64)], len(digest))
    out["digest"][at], out["size"][at] = digest, size
    out["winner"][at] = winner.fill_null(0).to_numpy(zero_copy_only=False)
    out["has_winner"][at] = winner.is_valid().to_numpy(zero_copy_only=False)
    return seeds, out


def _v32(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "V32")


class DigestIndex:
    """buckets: DataFrame of _INDEX, written; hot: one bucket that goes to all tasks."""

    def __init__(self, buckets: DataFrame, n_buckets: int, hot: tuple[bytes, bytes], rows: int):
        self.buckets, self.n_buckets, self.hot, self.rows = buckets, n_buckets, hot, rows


def build_index(digests: DataFrame) -> DigestIndex:
    """The index of all distinct digests of (doc_id, digest); the winner is the largest id, null where all are null."""
    groups = stash(digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size")), "digests")
    n, rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(n / BUCKET_DIGESTS))
    most = max(256, math.ceil(rows / HOT_DIGESTS))  # at most rows / most <= HOT_DIGESTS digests exceed it
    hot_rows = groups.filter(F.col("size") > most).orderBy("digest").toArrow().combine_chunks()
    hot = (b"", b"")
    if hot_rows.num_rows:
        seeds, slots = _slots(_v32(hot_rows["digest"]), hot_rows["winner"].combine_chunks(), hot_rows["size"].to_numpy())
        hot = (seeds.tobytes(), slots.tobytes())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket is held at a time."""

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            seeds, slots = _slots(_v32(t["digest"]), t["winner"].combine_chunks(), t["size"].to_numpy())
            return pa.RecordBatch.from_pydict({"bucket": pa.array([t["bucket"][0].as_py()], pa.int64()), "seeds": [seeds.tobytes()], "slots": [slots.tobytes()]})

        held: list[pa.RecordBatch] = []
        for b in batches:
            ids = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and held[0].column("bucket")[0].as_py() != ids[lo]:
                        yield done(held)
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield done(held)

    dealt = groups.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return DigestIndex(stash(dealt.mapInArrow(build, _INDEX), "digest-index"), buckets, hot, rows)


def _bucket(n: int):
    """Bucket of a digest, by its last eight bytes."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 26, 7)), 16, 10).cast("long"), F.lit(n))


def probe(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """(doc_id, digest, member, winner, size) of every row of (doc_id, digest).

    The rows and the index's buckets meet sorted, so that a task holds one bucket and one
    batch of rows at a time; rows of hot digests never leave their partition.
    """
    seeds, slots = np.frombuffer(index.hot[0], "<u4"), np.frombuffer(index.hot[1], _SLOT)

    def answer(b: pa.RecordBatch, seeds: np.ndarray, slots: np.ndarray, at: np.ndarray | None = None) -> pa.RecordBatch:
        at = lookup(_v32(b.column("digest")), seeds, slots) if at is None else at
        found = slots[np.maximum(at, 0)] if len(slots) else np.zeros(len(at), _SLOT)
        member = at >= 0
        return pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "digest": b.column("digest"), "member": member,
            "winner": pa.array(found["winner"], pa.int64(), mask=~(member & (found["has_winner"] > 0))),
            "size": pa.array(found["size"], pa.int64(), mask=~member),
        })

    answered = "doc_id long, digest binary, member boolean, winner long, size long"
    cold = digests
    hot = None
    if len(slots):
        hot = map_arrow(digests, lambda b: answer(b, seeds, slots), answered).filter("member")

        def rest(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(lookup(_v32(b.column("digest")), seeds, slots) < 0))

        cold = map_arrow(digests, rest, "doc_id long, digest binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, own_seeds, own_slots = None, np.zeros(0, "<u4"), np.zeros(0, _SLOT)
        for b in batches:
            ids, is_row = b.column("bucket").to_numpy(), b.column("is_row").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if not is_row[lo]:
                    bucket = ids[lo]
                    own_seeds, own_slots = np.frombuffer(b.column("seeds")[lo].as_py(), "<u4"), np.frombuffer(b.column("slots")[lo].as_py(), _SLOT)
                else:
                    if bucket != ids[lo]:
                        bucket, own_seeds, own_slots = ids[lo], np.zeros(0, "<u4"), np.zeros(0, _SLOT)
                    yield answer(b.slice(lo, hi - lo), own_seeds, own_slots)

    rows = cold.select(_bucket(index.n_buckets).alias("bucket"), F.lit(True).alias("is_row"), "doc_id", "digest", F.lit(None).cast("binary").alias("seeds"), F.lit(None).cast("binary").alias("slots"))
    entries = index.buckets.select("bucket", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "seeds", "slots")
    met = rows.unionByName(entries).repartition(max(index.n_buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "is_row").mapInArrow(meet, answered)
    return met if hot is None else met.unionByName(hot)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. history:
    (doc_id, digest) of rows seen before, by default docs itself. Rows whose digest history
    has follow its winner (they are kept only if they are the winner); the others are grouped
    among themselves, the largest id stays. Ids are identities: rows that repeat an id are the
    same document and share its verdict. A null id stays only if no equal text has an id. No
    rows in, no rows out; other columns of docs are ignored.
    """
    mine = stash(text_digests(docs, id_col, text_col), "text-digests")
    found = probe(mine, build_index(mine if history is None else history))
    if history is not None:
        found = stash(found, "probed")
        new = found.filter("not member").select("doc_id", "digest")
        fresh = probe(new, build_index(new))
        found = found.filter("member").unionByName(fresh)
    return found.select("doc_id", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
