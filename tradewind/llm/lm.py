"""A hashed maximum-entropy language model with class-factored softmax.

    P(word | history) = P(class | history) * P(word | class)

The class factor is a softmax over CLASSES classes with two groups of features. One sees the
classes of the three words before: n-grams (one, two and three of them) and skips (the second,
the third, and pairs with a gap), hashed into FEATURES rows of weights. The other sees the words
themselves: the word before, the one before that (a skip), and both as an n-gram, hashed into
rows of weights whose number grows with the square root of the training tokens, as vocabularies
do. The word factor is the maximum-entropy model with the class as its only feature, whose
solution is the smoothed share of the word in its class; one unknown word a class makes it a
distribution.

The most frequent words are classes of their own, the end of a text is one, and the other
words are classed by the way they end: endings are hashed into SIGNATURES, and signatures that
stand after the same frequent words are clustered.

The corpus is read once and kept as blocks of integers with a list of distinct words each;
only hashed words and their counts are shuffled against each other. Class features train on
counts of (history, class), a table bounded by the number of histories: each round, tasks compute
gradients on their share of histories; sums of gradients are cut into slices that are added up in
a tree of tasks, and the driver gets one array of weights' size. Word features take one step of
iterative scaling: the class features already make the expected counts of each class before
equal to those seen, so a word's rows are the log ratio of what was seen after it to what the
class features expect after its class.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import narrow, small_batches, stash

CLASSES, TOP, SIGNATURES, FEATURES = 64, 31, 4096, 1 << 13
CLUSTERS = CLASSES - TOP - 1
#: Histories are three classes; the table of counts is cut into so many parts.
HISTORIES, PARTS = CLASSES**3, 64
ROUNDS = 6
#: Words before that are features, rows of weights for each by the root of the tokens, and the share of a full step.
WORD_FEATURES, ROWS_BY_ROOT, WORD_STEP = 2, 1.0, 0.5
#: Tokens or histories at a time.
CHUNK = 4096
#: Share of a full step, for features that are active together; strength of the Gaussian prior.
STEP, PRIOR = 0.2, 30.0
BLOCK_CHARS = 2_000_000
#: Hashes that one task of the word count holds, about.
RANGE_WORDS = 400_000
#: Of seven shares of documents by crc32 of the id, this one is held out.
SHARES, HELD = 7, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
_END = xxhash.xxh64_intdigest(b"\n", 0)  # no word has a line end in it

BLOCK = "block long, doc_ids array<long>, held binary, ends binary, tokens binary, hashes binary, signatures binary, counts binary, n_words long"


def is_held(doc_id: int | None) -> bool:
    """Held out of training; a null id counts as empty text and isn't."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % SHARES == HELD


def signature(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SIGNATURES


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of BLOCK, written: texts as integers into the block's own list of distinct words (0: the end)."""
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0

        def fresh():
            local: defaultdict[bytes, int] = defaultdict()
            local.default_factory = local.__len__
            local[b"\n"] = 0
            return [], array("I"), array("I"), local, 0

        def done(ids, tokens, ends, local) -> pa.RecordBatch:
            words, flat, stops = list(local), np.frombuffer(tokens, np.uint32), np.frombuffer(ends, np.uint32)
            held = np.array([is_held(d) for d in ids], bool)
            train = np.repeat(~held, np.diff(np.concatenate([[0], stops])))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + n], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": [held.tobytes()], "ends": [stops.tobytes()], "tokens": [flat.tobytes()],
                "hashes": [np.array([_END] + [xxhash.xxh64_intdigest(w, 0) for w in words[1:]], np.uint64).tobytes()],
                "signatures": [np.array([signature(w) for w in words], np.uint16).tobytes()],
                "counts": [np.bincount(flat[train], minlength=len(words)).astype(np.int64).tobytes()], "n_words": pa.array([len(words)], pa.int64()),
            })

        ids, tokens, ends, local, size = fresh()
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens.extend(map(local.__getitem__, t.encode().lower().split()))
                tokens.append(0)
                ids.append(d)
                ends.append(len(tokens))
                size += len(t)
                if size >= BLOCK_CHARS:
                    yield done(ids, tokens, ends, local)
                    n += 1
                    ids, tokens, ends, local, size = fresh()
        if ids:
            yield done(ids, tokens, ends, local)

    return stash(narrow(docs, id_col, text_col).mapInArrow(build, BLOCK), "lm-blocks")


COUNTED = "range int, block long, locals binary, counts binary, n long, v long, top_hash array<long>, top_count array<long>, top_signature array<int>, types binary"


def count_words(table: DataFrame) -> DataFrame:
    """Rows of COUNTED, written: global training counts, sent back to each block, and a summary of each range of hashes.

    A range's distinct words meet in one task; ranges are as many as keep them near RANGE_WORDS.
    """
    total = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // RANGE_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, c, s = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in (("hashes", np.uint64), ("counts", np.int64), ("signatures", np.uint16)))
                at = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(ranges + 1))
                rows = [(r, order[cuts[r] : cuts[r + 1]]) for r in range(ranges) if cuts[r] < cuts[r + 1]]
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([r for r, _ in rows], pa.int32()), "block": pa.array([b.column("block")[i].as_py()] * len(rows), pa.int64()),
                    "locals": pa.array([x.astype(np.uint32).tobytes() for _, x in rows], pa.binary()), "hashes": pa.array([h[x].tobytes() for _, x in rows], pa.binary()),
                    "counts": pa.array([c[x].astype(np.uint32).tobytes() for _, x in rows], pa.binary()), "signatures": pa.array([s[x].tobytes() for _, x in rows], pa.binary()),
                })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("locals", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("top_hash", pa.list_(pa.int64())), ("top_count", pa.list_(pa.int64())), ("top_signature", pa.list_(pa.int32())), ("types", pa.binary())])

        def done(r: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x[2] for x in held])
            words, inverse = np.unique(h, return_inverse=True)
            count = np.zeros(len(words), np.int64)
            np.add.at(count, inverse, np.concatenate([x[3] for x in held]).astype(np.int64))
            sig = np.zeros(len(words), np.int64)
            sig[inverse] = np.concatenate([x[4] for x in held])
            known = count > 0
            top = np.lexsort((words, -count))[: TOP + 1]
            top = top[known[top] & (words[top] != _END)]
            types = np.bincount(sig[known & (words != _END)], minlength=SIGNATURES).astype(np.int64)
            summary = {"range": r, "block": None, "locals": None, "counts": None, "n": int(count.sum()), "v": int(known.sum()), "top_hash": words[top].view(np.int64).tolist(), "top_count": count[top].tolist(), "top_signature": sig[top].tolist(), "types": types.tobytes()}
            yield pa.RecordBatch.from_pylist([summary], schema)
            at = 0
            for block, local, own, _, _ in held:
                c = count[inverse[at : at + len(own)]]
                at += len(own)
                yield pa.RecordBatch.from_pylist([{"range": r, "block": block, "locals": local.tobytes(), "counts": c.tobytes()}], schema)

        held: list[tuple] = []
        now = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.column("range")[i].as_py()
                if r != now and held:
                    yield from done(now, held)
                    held = []
                now = r
                held.append((b.column("block")[i].as_py(), *(np.frombuffer(b.column(k)[i].as_py(), t) for k, t in (("locals", np.uint32), ("hashes", np.uint64), ("counts", np.uint32), ("signatures", np.uint16)))))
        if held:
            yield from done(now, held)

    dealt = table.select("block", "hashes", "counts", "signatures").mapInArrow(deal, "range int, block long, locals binary, hashes binary, counts binary, signatures binary")
    return stash(dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(merge, COUNTED), "lm-counts")


def fan_out(df: DataFrame) -> int:
    """Tasks that share a part of a sum before its last addition: as many as the session's shuffles can use."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS)


def sum_arrays(df: DataFrame, parts: int, fan: int = 1) -> DataFrame:
    """(part, data) of rows (part, data): int64 arrays in bytes, added up by part.

    fan: so many tasks add up shares of a part first, for sums with a row from every block.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                k, x = b.column("part")[i].as_py(), np.frombuffer(b.column("data")[i].as_py(), np.int64)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.copy()
        if sums:
            share = pa.array([TaskContext.get().partitionId() % fan] * len(sums), pa.int32())
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "data": pa.array([x.tobytes() for x in sums.values()], pa.binary()), "share": share})

    schema = "part int, data binary, share int"
    some = df.select("part", "data").mapInArrow(add, schema)
    if fan > 1:
        some = some.repartition(parts * fan, "part", "share").mapInArrow(add, schema)
    return some.repartition(parts, "part").mapInArrow(add, schema).drop("share")


@dataclass
class Classes:
    """What a word's class follows from."""

    top: np.ndarray  # hashes of the words that are classes, sorted
    top_class: np.ndarray
    cluster: np.ndarray  # class of each signature

    def of(self, hashes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
        out = self.cluster[signatures]
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[at] == hashes, self.top_class[at], out)
        return np.where(hashes == _END, 0, out).astype(np.uint8)


def _each(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, signature, document, held, hashed word) of each token of each block; held is by document."""
    for b in batches:
        for i in range(b.num_rows):
            h, s, t, ends, held = (np.frombuffer(b.column(k)[i].as_py(), kind) for k, kind in (("hashes", np.uint64), ("signatures", np.uint16), ("tokens", np.uint32), ("ends", np.uint32), ("held", bool)))
            doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            yield classes.of(h, s)[t], s[t], doc, held, h[t]


def histories(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The three classes before each token as one number, nearest first; before a text stands its end (0)."""
    out = np.zeros(len(cls), np.int64)
    for k in (1, 2, 3):
        if len(cls) > k:
            prev = np.where(doc[k:] == doc[:-k], cls[:-k], 0).astype(np.int64)
            out[k:] += prev * CLASSES ** (k - 1)
    return out


def cluster_signatures(table: DataFrame, classes: Classes) -> np.ndarray:
    """The class of each signature: k-means of the frequent words that stand before it, by direction."""
    width = TOP + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((SIGNATURES, width), np.int64)
        for cls, sig, doc, held, _ in _each(batches, classes):
            for k in (1, 2, 3):
                use = (doc[k:] == doc[:-k]) & ~held[doc[k:]] & (cls[k:] > TOP) & (cls[:-k] <= TOP)
                m += np.bincount(sig[k:][use].astype(np.int64) * width + cls[:-k][use], minlength=SIGNATURES * width).reshape(m.shape)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "data": [x.tobytes() for x in np.split(m, PARTS)]})

    rows = sum_arrays(table.select("hashes", "signatures", "tokens", "ends", "held").mapInArrow(count, "part int, data binary"), PARTS, fan_out(table)).collect()  # PARTS rows
    m = np.zeros((PARTS, SIGNATURES // PARTS, width))
    for r in rows:
        m[r["part"]] = np.frombuffer(r["data"], np.int64).reshape(-1, width)
    m = m.reshape(SIGNATURES, width)
    weight = m.sum(axis=1)
    share = m / np.maximum(m.sum(axis=0), 1)  # a frequent word's own frequency says nothing
    unit = np.sqrt(share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12))
    order = np.argsort(-weight, kind="stable")
    centers = unit[order[:1]]
    for _ in range(CLUSTERS - 1):  # the next center: heavy and far from the others
        gap = weight**0.5 * np.maximum(0, 1 - (unit @ centers.T).max(axis=1))
        centers = np.vstack([centers, unit[gap.argmax()]])
    for _ in range(12):
        near = (unit @ centers.T).argmax(axis=1)
        new = np.zeros_like(centers)
        np.add.at(new, near, unit * weight[:, None])
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        centers = np.where(norm > 0, new / np.maximum(norm, 1e-12), centers)
    near = (unit @ centers.T).argmax(axis=1)
    near = np.where(weight > 0, near, np.arange(SIGNATURES) % CLUSTERS)
    return near + TOP + 1


def features(history: np.ndarray) -> np.ndarray:
    """Rows of weights of each history: a bias (row 0, its own), n-grams and skips of the classes before, hashed."""
    a, b, c = history % CLASSES, history // CLASSES % CLASSES, history // CLASSES**2
    keys = (a, b, c, a * CLASSES + b, a * CLASSES + c, b * CLASSES + c, history)
    out = np.zeros((len(history), len(keys) + 1), np.int64)
    for k, x in enumerate(keys):
        h = (x.astype(np.uint64) * np.uint64(len(keys)) + np.uint64(k + 1)) * _MIX
        out[:, k + 1] = (h >> np.uint64(40)) % np.uint64(FEATURES - 1) + np.uint64(1)
    return out


def words_before(word: np.ndarray, doc: np.ndarray, fill: int) -> list[np.ndarray]:
    """word moved on by one, two, ...: what stands before each token in its text; before a text stands fill."""
    out = []
    for k in range(1, WORD_FEATURES + 1):
        x = np.full(len(word), fill, word.dtype)
        if len(word) > k:
            x[k:] = np.where(doc[k:] == doc[:-k], word[:-k], word.dtype.type(fill))
        out.append(x)
    return out


def word_rows(word: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Rows of word weights of each token, a column for each feature; rows: of each feature, a power of two."""
    out = np.empty((len(word), WORD_FEATURES), np.int64)
    for k, x in enumerate(words_before(word, doc, _END)):
        x = x * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
        out[:, k] = (x >> np.uint64(65 - rows.bit_length())).astype(np.int64) + k * rows
    return out


def logits(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    """A row of class logits for each history."""
    out = np.empty((len(history), CLASSES), np.float32)
    for lo in range(0, len(history), CHUNK):
        at = features(history[lo : lo + CHUNK])
        x = weights[at[:, 0]].copy()
        for k in range(1, at.shape[1]):
            x += weights[at[:, k]]
        out[lo : lo + CHUNK] = x
    return out


def normal(x: np.ndarray) -> np.ndarray:
    """Log-softmax of rows, in double precision."""
    x = x.astype(np.float64)
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_classes(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    """log P(class | history) by the class features alone, a row for each history."""
    return normal(logits(weights, history))


def shares(table: np.ndarray, ratios: np.ndarray, history: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a share for each class, their sum) for each token by all features; P(class | history) is their quotient.

    table, history: see class_shares(); ratios: exponentials of the word weights.
    """
    x = table[history]
    for k in range(WORD_FEATURES):
        x *= ratios[rows[:, k]]
    return x, x.sum(axis=1, dtype=np.float64)


def add_rows(to: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """to[rows[i]] += x[i], also where rows repeat."""
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[cut]] += np.add.reduceat(x[order], cut)


def sparse_counts(table: DataFrame, classes: Classes, keys_of, size: int, finish=None, schema: str = "part int, at binary, n binary") -> DataFrame:
    """Counts of keys 0 .. size-1 in training texts, cut into PARTS runs of keys; a task sends no key it hasn't seen.

    keys_of(class, document, hashed word, trained) gives a block's keys; finish(part, counts) a
    part's row, by default the keys seen and their counts.
    """
    step, fan = size // PARTS, fan_out(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId() % fan
        keys, sums, held_size = [], [], 0

        def merge() -> None:
            nonlocal held_size
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            keys[:], sums[:] = [k], [np.bincount(inverse, np.concatenate(sums)).astype(np.int64)]
            held_size = len(k)

        for cls, _, doc, held, word in _each(batches, classes):
            own = keys_of(cls, doc, word, ~held[doc])
            if size <= 4 * len(own):  # few keys: counting in place is cheaper than sorting
                n = np.bincount(own, minlength=size)
                k = np.flatnonzero(n)
                n = n[k]
            else:
                k, n = np.unique(own, return_counts=True)
            keys.append(k)
            sums.append(n)
            held_size += len(k)
            if held_size > 500_000:
                merge()
        if keys:
            merge()
            cuts = np.searchsorted(keys[0], np.arange(PARTS + 1) * step)
            for p in range(PARTS):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "at": [(keys[0][a:b] - p * step).astype(np.uint32).tobytes()], "n": [sums[0][a:b].tobytes()], "share": pa.array([share], pa.int32())})

    def added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                p = b.column("part")[i].as_py()
                if p not in held:
                    held[p] = np.zeros(step, np.int64)
                held[p][np.frombuffer(b.column("at")[i].as_py(), np.uint32)] += np.frombuffer(b.column("n")[i].as_py(), np.int64)
        return held

    def seen(p: int, x: np.ndarray) -> dict:
        at = np.flatnonzero(x)
        return {"part": pa.array([p], pa.int32()), "at": [at.astype(np.uint32).tobytes()], "n": [x[at].tobytes()]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x in added(batches).items():
            yield pa.RecordBatch.from_pydict(seen(p, x) | {"share": pa.array([0], pa.int32())})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, x in added(batches).items():
            yield pa.RecordBatch.from_pydict((finish or seen)(p, x))

    sparse = "part int, at binary, n binary, share int"
    counted = table.select("hashes", "signatures", "tokens", "ends", "held").mapInArrow(count, sparse)
    some = counted.repartition(PARTS * fan, "part", "share").mapInArrow(add, sparse)  # so many tasks add up shares of a part first
    return stash(some.repartition(PARTS, "part").mapInArrow(last, schema), "lm-counts-by-key")


def history_counts(table: DataFrame, classes: Classes) -> DataFrame:
    """(part, at, n), written: counts of each history and class in training texts, a share of the histories a row."""
    return sparse_counts(table, classes, lambda cls, doc, word, trained: (histories(cls, doc) * CLASSES + cls)[trained], HISTORIES * CLASSES)


def slices(x: np.ndarray) -> pa.RecordBatch:
    """A sum's rows for sum_arrays: the array, in 1024ths, cut into PARTS."""
    flat = np.rint(x * 1024).astype(np.int64).reshape(PARTS, -1)
    return pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "data": pa.array([r.tobytes() for r in flat], pa.binary())})


def gathered(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what slices() gave in df's rows; the driver gets PARTS rows, one array of the shape."""
    out = np.zeros((PARTS, int(np.prod(shape)) // PARTS))
    for r in sum_arrays(df, PARTS, fan_out(df)).collect():
        out[r["part"]] = np.frombuffer(r["data"], np.int64) / 1024
    return out.reshape(shape)


def train(counts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the class features, training tokens of each class) by rounds of gradients summed over tasks.

    A weight moves by its gradient (observed less expected count, and a Gaussian prior's pull)
    over its expected count, damped since features are active together.
    """
    step = HISTORIES // PARTS * CLASSES

    def gradient(weights: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, any_rows = np.zeros((FEATURES, CLASSES)), False
            for b in batches:
                for i in range(b.num_rows):
                    any_rows = True
                    at = np.frombuffer(b.column("at")[i].as_py(), np.uint32).astype(np.int64) + b.column("part")[i].as_py() * step
                    n = np.frombuffer(b.column("n")[i].as_py(), np.int64)
                    own, inverse = np.unique(at // CLASSES, return_inverse=True)
                    for lo in range(0, len(own), CHUNK):
                        h = own[lo : lo + CHUNK]
                        use = (inverse >= lo) & (inverse < lo + len(h))
                        y = np.bincount((inverse[use] - lo) * CLASSES + at[use] % CLASSES, n[use], len(h) * CLASSES).reshape(len(h), CLASSES)
                        p = y if weights is None else y.sum(axis=1, keepdims=True) * np.exp(log_classes(weights, h))
                        f = features(h)
                        for k in range(f.shape[1]):
                            add_rows(total, f[:, k], p)
            if any_rows:
                yield slices(total)

        return gathered(counts.mapInArrow(run, "part int, data binary"), (FEATURES, CLASSES))

    seen = gradient(None)
    tokens = seen[0].copy()  # the bias has a row of its own
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    weights[0] = np.log((tokens + 1) / (tokens + 1).sum())
    for _ in range(rounds):
        expected = gradient(weights)
        pull = PRIOR * weights
        pull[0] = 0
        weights += np.clip(STEP * (seen - expected - pull) / (expected + PRIOR), -1, 1).astype(np.float32)
    return weights, tokens


def class_shares(weights: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(class | class history) of the distinct histories, which of them each token has): no table of all histories is held."""
    own, inverse = np.unique(history, return_inverse=True)
    out = np.empty((len(own), CLASSES), np.float32)
    for lo in range(0, len(own), CHUNK):
        out[lo : lo + CHUNK] = np.exp(log_classes(weights, own[lo : lo + CHUNK]))
    return out, inverse


def after_class(counts: DataFrame) -> list[np.ndarray]:
    """For each word feature, the smoothed share of each class after each class that far before."""
    step = HISTORIES // PARTS * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORD_FEATURES, CLASSES, CLASSES))
        for b in batches:
            for i in range(b.num_rows):
                at = np.frombuffer(b.column("at")[i].as_py(), np.uint32).astype(np.int64) + b.column("part")[i].as_py() * step
                n = np.frombuffer(b.column("n")[i].as_py(), np.int64)
                for k in range(WORD_FEATURES):
                    before = at // CLASSES ** (k + 1) % CLASSES
                    total[k] += np.bincount(before * CLASSES + at % CLASSES, n, CLASSES**2).reshape(CLASSES, CLASSES)
        yield slices(total)

    n = gathered(counts.mapInArrow(run, "part int, data binary"), (WORD_FEATURES, CLASSES, CLASSES)) + 1
    return [x / x.sum(axis=1, keepdims=True) for x in n]


def train_words(table: DataFrame, classes: Classes, counts: DataFrame, tokens: int) -> np.ndarray:
    """Exponentials of the word weights, WORD_FEATURES times a power of two of rows.

    For each row: what was seen after its words by class, and the classes of those words. Its
    weights are a part of the log ratio of the counts seen to those expected, both smoothed by
    PRIOR times what is expected.
    """
    rows = max(PARTS, 1 << int(np.ceil(np.log2(ROWS_BY_ROOT * max(1, tokens) ** 0.5))))
    expected = after_class(counts)

    def keys_of(cls, doc, word, trained):
        at, before = word_rows(word, doc, rows)[trained], words_before(cls, doc, 0)
        own = cls[trained].astype(np.int64)
        out = []
        for k in range(WORD_FEATURES):
            out += [at[:, k] * (2 * CLASSES) + own, at[:, k] * (2 * CLASSES) + CLASSES + before[k][trained]]
        return np.concatenate(out)

    step = WORD_FEATURES * rows // PARTS

    def finish(p: int, x: np.ndarray) -> dict:
        x = x.reshape(step, 2, CLASSES)
        feature = (p * step + np.arange(step)) // rows
        share = np.empty((step, CLASSES))
        for k in range(WORD_FEATURES):
            here = feature == k
            share[here] = x[here, 1] @ expected[k]
        n = x[:, 0].sum(axis=1, keepdims=True)
        share = np.where(n > 0, share / np.maximum(n, 1), 1 / CLASSES)
        ratio = (x[:, 0] + PRIOR * share) / ((n + PRIOR) * share)
        return {"part": pa.array([p], pa.int32()), "data": [(ratio**WORD_STEP).astype(np.float32).tobytes()]}

    out = np.ones((PARTS, step * CLASSES), np.float32)
    for r in sparse_counts(table, classes, keys_of, WORD_FEATURES * rows * 2 * CLASSES, finish, "part int, data binary").collect():  # PARTS rows, one array of weights
        out[r["part"]] = np.frombuffer(r["data"], np.float32)
    return out.reshape(WORD_FEATURES * rows, CLASSES)


@dataclass
class Model:
    classes: Classes
    weights: np.ndarray
    ratios: np.ndarray  # of the word features
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int  # N
    types: int  # V


def fit(table: DataFrame, counted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Train on all texts of the blocks that aren't held out. No training texts: a model of unknown words only."""
    summary = counted.filter("block is null")
    n, v = summary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    best = summary.select(F.explode(F.arrays_zip("top_hash", "top_count", "top_signature")).alias("x")).select("x.*").orderBy(F.desc("top_count"), "top_hash").limit(TOP).collect()
    top = np.array([r["top_hash"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(top)
    flat = np.full(SIGNATURES, TOP + 1)
    first = Classes(top[order], (order + 1).astype(np.int64), flat)
    classes = Classes(first.top, first.top_class, cluster_signatures(table, first))
    types_rows = sum_arrays(summary.select(F.lit(0).cast("int").alias("part"), F.col("types").alias("data")), 1, fan_out(table)).collect()  # one array of SIGNATURES
    types = np.frombuffer(types_rows[0]["data"], np.int64).copy() if types_rows else np.zeros(SIGNATURES, np.int64)
    class_types = np.zeros(CLASSES, np.int64)
    for r in best:
        types[r["top_signature"]] -= 1
    np.add.at(class_types, classes.cluster, types)
    class_types[: len(best) + 1] = 1
    counts = history_counts(table, classes)
    weights, class_tokens = train(counts, rounds)
    return Model(classes, weights, train_words(table, classes, counts, int(n)), class_tokens, class_types, int(n), int(v))


def score(table: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts of the blocks.

    A block meets the counts of its words, in sorted order, so that a task holds one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_counts, now = [], None
        for b in batches:
            for i in range(b.num_rows):
                block = b.column("block")[i].as_py()
                if block != now:
                    held_counts, now = [], block
                if b.column("locals")[i].as_py() is not None:
                    held_counts.append((np.frombuffer(b.column("locals")[i].as_py(), np.uint32), np.frombuffer(b.column("counts")[i].as_py(), np.int64)))
                    continue
                h, s, t, ends, held = (np.frombuffer(b.column(k)[i].as_py(), kind) for k, kind in (("hashes", np.uint64), ("signatures", np.uint16), ("tokens", np.uint32), ("ends", np.uint32), ("held", bool)))
                count = np.zeros(len(h), np.int64)
                for local, c in held_counts:
                    count[local] = c
                word_class = model.classes.of(h, s)
                base = np.log10((count + 1) / (model.tokens + model.types + 1))
                inner = np.log10((count + 1) / (model.class_tokens + model.class_types + 1)[word_class])
                n = np.diff(np.concatenate([[0], ends]))
                doc = np.repeat(np.arange(len(ends)), n)
                cls = word_class[t]
                of_class, history = class_shares(model.weights, histories(cls, doc))
                at, outer = word_rows(h[t], doc, len(model.ratios) // WORD_FEATURES), np.empty(len(t))
                for lo in range(0, len(t), CHUNK):
                    some = slice(lo, lo + CHUNK)
                    share, total = shares(of_class, model.ratios, history[some], at[some])
                    outer[some] = np.log10(share[np.arange(len(share)), cls[some]] / total)
                add = lambda x, doc=doc, m=len(ends): np.bincount(doc, x, m)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(b.column("doc_ids")[i].as_py(), pa.int64()), "held_out": held, "n_tokens": n.astype(np.int64), "n_known": add(count[t] > 0).astype(np.int64),
                    "train_tokens": np.full(len(ends), model.tokens, np.int64), "base_score": add(base[t]), "score": add(inner[t] + outer),
                })

    null = lambda kind: F.lit(None).cast(kind)
    texts = table.select("block", F.lit(True).alias("is_text"), "doc_ids", "held", "ends", "tokens", "hashes", "signatures", null("binary").alias("locals"), null("binary").alias("counts"))
    words = counted.filter("block is not null").select("block", F.lit(False).alias("is_text"), null("array<long>").alias("doc_ids"), *[null("binary").alias(c) for c in ("held", "ends", "tokens", "hashes", "signatures")], "locals", "counts")
    n_blocks = max(1, table.count())
    met = texts.unionByName(words).repartition(n_blocks, "block").sortWithinPartitions("block", "is_text")
    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the texts that aren't held out and score all, a row for each row of docs.

    Null and empty texts are the end alone; null ids are in training; rows that repeat an id
    count and score as often as they stand; other columns are ignored; no rows in, no rows out.
    """
    table = blocks(docs, id_col, text_col)
    counted = count_words(table)
    return score(table, counted, fit(table, counted, rounds))
