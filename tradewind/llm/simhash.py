"""SimHash near-duplicates: exact comparison of all distinct fingerprints in tiles.

Documents become fingerprints of 64 bits; only distinct fingerprints are compared. They are
sorted by the population counts of their quarters and cut into tiles. Two fingerprints that
differ in r bits differ by at most r in the sum of their quarters' counts, so a pair of tiles
whose ranges of counts lie further apart is skipped whole, first as a pair of rows, then in
pieces inside a task. The rest are compared by exclusive-or and bit counts in numpy. A task
reports a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import forget, map_arrow, narrow, small_batches, stash
from tradewind.llm.components import stars

RADIUS = 3
SEED = 42
#: Fingerprints in a tile: the corpus is cut into TILES tiles, as long as they hold this many.
TILE_LEAST, TILE_MOST, TILES = 1024, 131_072, 32
#: Tiles are dealt in blocks, BLOCKS or more of them, of BLOCK_MOST tiles at most.
BLOCKS, BLOCK_MOST = 64, 16
#: Fingerprints in a piece of a tile.
PIECE = 512
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, k: int = 3) -> list[int]:
    """XXH64 of each shingle of k words (ASCII white space parts words, A-Z lower-cased); of all words if fewer."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: bits set in over half of them; 0 without any.

    Eight bits of a hash at a time are added in the bytes of a 64-bit lane, at most 255 hashes
    before the bytes are widened.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    starts = np.cumsum(n) - n
    parts = -(-n // 255)
    part_ends = np.cumsum(parts)
    first = part_ends - parts
    cuts = np.repeat(starts, parts) + (np.arange(part_ends[-1]) - np.repeat(first, parts)) * 255
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for j in range(8):
            out[some] |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, from the whole text; null is empty, an empty text has 0."""
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> dict:
        forget()
        flat: list[np.ndarray] = []
        counts: list[int] = []
        fps: list[np.ndarray] = []
        held = 0
        for t in b.column("text").to_pylist():
            h = shingle_hashes(t)
            flat.append(np.array(h, np.uint64))
            counts.append(len(h))
            held += len(h)
            if held > 1_000_000:
                fps.append(majority(np.concatenate(flat), np.array(counts)))
                flat, counts, held = [], [], 0
        if counts:
            fps.append(majority(np.concatenate(flat), np.array(counts)))
        return {"doc_id": b.column("doc_id"), "fp": np.concatenate(fps).view(np.int64)}

    return map_arrow(narrow(docs, id_col, text_col), f, "doc_id long, fp long")


def quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Disjoint sets of 0 .. n-1, united by arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that span all pairs of a and b (of a alone if same) within radius bits."""
    forest = Forest(len(a) if same else len(a) + len(b))

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, cuts = quarters(x), np.arange(0, len(x), PIECE)
        return np.minimum.reduceat(q, cuts), np.maximum.reduceat(q, cuts)

    (alo, ahi), (blo, bhi) = boxes(a), boxes(b)
    for i in range(len(alo)):
        gap = np.maximum(0, np.maximum(blo - ahi[i], alo[i] - bhi)).sum(axis=1)
        x = a[i * PIECE : (i + 1) * PIECE, None]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            u, v = np.nonzero(np.bitwise_count(x ^ b[None, j * PIECE : (j + 1) * PIECE]) <= radius)
            u, v = u + i * PIECE, v + j * PIECE
            if same:
                forest.unite(u, v)
            else:
                forest.unite(u, v + len(a))
    both = a if same else np.concatenate([a, b])
    roots = forest.find(np.arange(len(both)))
    low = np.flatnonzero(roots != np.arange(len(both)))
    return both[low], both[roots[low]]


def tiles(nodes: DataFrame, n: int) -> DataFrame:
    """Rows (tile, lo, hi, fps) of the distinct fingerprints of nodes, written; lo and hi bound the quarters' counts."""
    size = min(TILE_MOST, max(TILE_LEAST, math.ceil(n / TILES)))
    q = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"q{k}") for k in range(4)]
    ordered = nodes.select("fp", *q).repartitionByRange(max(1, math.ceil(n / size)), "q0", "q1", "q2", "q3", "fp").sortWithinPartitions("q0", "q1", "q2", "q3", "fp").select("fp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def tile(fps: np.ndarray) -> pa.RecordBatch:
            q = quarters(fps)
            return pa.RecordBatch.from_pydict({"tile": pa.array([base + k], pa.int64()), "lo": [q.min(axis=0).tolist()], "hi": [q.max(axis=0).tolist()], "fps": pa.array([fps.tobytes()], pa.binary())}, pa.schema([("tile", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("fps", pa.binary())]))

        for b in batches:
            held.append(b.column("fp").to_numpy().astype("<i8"))
            count += b.num_rows
            while count >= size:
                flat = np.concatenate(held)
                yield tile(flat[:size])
                k, held, count = k + 1, [flat[size:]], count - size
        if count:
            yield tile(np.concatenate(held))

    return stash(ordered.mapInArrow(cut, "tile long, lo array<int>, hi array<int>, fps binary"), "tiles")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that span the components of the distinct fingerprints of nodes under distances up to radius."""
    cut = tiles(nodes, nodes.count())
    n_tiles = cut.count()
    bounds = cut.select("tile", "lo", "hi")
    a = bounds.select(F.col("tile").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("q"))
    b = bounds.select(F.col("tile").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("q"))
    gap = sum((F.greatest(F.lit(0), F.col("blo")[k] - F.col("ahi")[k], F.col("alo")[k] - F.col("bhi")[k]) for k in range(4)), F.lit(0))
    pairs = a.join(b, "q").filter((F.col("a") <= F.col("b")) & (F.col("q") == F.greatest(F.col("alo")[0] - radius, F.col("blo")[0])) & (gap <= radius)).select("a", "b")
    # a block of tiles meets another once, whatever number of its pairs are left: a tile is sent once a block
    side = min(BLOCK_MOST, max(1, n_tiles // BLOCKS))
    block = lambda c: F.floor(F.shiftright(c, 32) / side)
    pairs = stash(pairs.select("a", "b", block("a").alias("g"), block("b").alias("h")), "tile-pairs")
    sent = pairs.select("g", "h", F.explode(F.array("a", "b")).alias("tile")).distinct().join(cut.select("tile", "fps"), "tile")
    null = lambda kind: F.lit(None).cast(kind)
    work = sent.select("g", "h", "tile", "fps", null("long").alias("b")).unionByName(pairs.select("g", "h", F.col("a").alias("tile"), null("binary").alias("fps"), "b"))
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(max(shuffles, 2 * n_tiles), "g", "h").sortWithinPartitions("g", "h", F.col("b").isNotNull(), "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                g, h, tile, fps, b = (batch.column(c)[i].as_py() for c in ("g", "h", "tile", "fps", "b"))
                if (g, h) != now:
                    now, held = (g, h), {}
                if fps is not None:
                    held[tile] = np.frombuffer(fps, "<u8")
                else:
                    u, v = compare(held[tile], held[b], tile == b, radius)
                    yield pa.RecordBatch.from_pydict({"u": u.view(np.int64), "v": v.view(np.int64)})

    return work.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest id reachable over links between fingerprints that differ in
    at most radius bits. Null and empty texts have fingerprint zero and are linked like any
    other; rows that repeat an id are one document; a null id is in a component but never its
    id, unless all its ids are null; other columns are ignored; no rows in, no rows out.
    """
    rows = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    star = stars(links(nodes, radius))
    root = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    members = stash(root.join(nodes, "fp").select("fp", "root", "first"), "members")
    least = stash(members.groupBy("root").agg(F.min("first").alias("component_id")), "least-members")  # written: Spark can split a giant component's join
    linked = members.join(least, "root").select("fp", "component_id")
    shared = nodes.filter("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    found = rows.join(linked.unionByName(shared).withColumn("found", F.lit(True)), "fp", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
