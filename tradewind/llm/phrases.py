"""Phrase collocations by contiguous pattern growth.

Texts become chunks of about CHUNK words of one language, as integers. Frequent words are the
first prefixes. A prefix's projection is the words that follow each of its occurrences, and a
prefix grows to the right by those that follow often enough, depth first, inside one task (which
may have several prefixes, one after the other) with nothing but that projection. A prefix with more than SPLIT occurrences isn't sent to one task: its
projection stays in the chunks, its extensions are counted over all chunks (summed
in each chunk, then before the shuffle), and the frequent ones are prefixes of their own, one
word longer. So no task holds more than SPLIT occurrences, whatever word a third of all are.

Counts go to the frequent words and extensions only by joins on chunks or prefixes; nothing that
grows with the corpus is broadcast. Words, not hashes, are counted: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import quoted, ship, small_batches, stash

#: Words in a phrase at most, and its least number of occurrences.
LONGEST, LEAST = 5, 100
#: Words in a chunk, about (a text is never cut), and occurrences in a projection at most.
CHUNK, SPLIT = 4_000_000, 4_000_000
#: Occurrences of the prefixes that share a bucket, about; a task grows them one after the other.
BUCKET = 1_000_000
#: Phrases of a language that are returned, and parts in which they are ranked first.
TOP, PARTS = 2000, 64
#: Ends of pieces, as bytes; each is read as a word of its own.
STOPS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(STOPS, b"." * len(STOPS))
#: Numbers of prefixes: their length stands above the others' bits.
DEPTH_AT = 56


class _Builder:
    """Texts of one language as integers; 0 ends a piece."""

    def __init__(self):
        self.known: dict[bytes, int] = {b".": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        known = self.known
        ids = [known.setdefault(w, len(known)) for w in text.encode().lower().translate(_TABLE).replace(b".", b" . ").split()]
        if ids:
            ids.append(0)
            self.parts.append(np.array(ids, np.int32))
            self.size += len(ids)

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.known))[1:]
        words = [w.decode() for w in self.known][1:]
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([chunk]), "lang": pa.array([lang]), "words": pa.array([words], pa.list_(pa.string())),
            "counts": pa.array([counts], pa.list_(pa.int64())), "total": pa.array([int(counts.sum())]), "ids": pa.array([ids.tobytes()], pa.binary()),
        })


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, lang, words, counts, total, ids) of rows (lang, text): each distinct word with its count, and all words as places in words + 1."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        open_: dict[str, _Builder] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                open_.setdefault(lang, _Builder()).add(text.as_py())
                if sum(x.size for x in open_.values()) >= size:  # the largest goes, so many languages don't add up
                    lang = max(open_, key=lambda k: open_[k].size)
                    yield open_.pop(lang).row(first + made, lang)
                    made += 1
        for lang, x in open_.items():
            if x.size:
                yield x.row(first + made, lang)
                made += 1

    return docs.mapInArrow(run, "chunk long, lang string, words array<string>, counts array<long>, total long, ids binary")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with numbers from 0 without gaps."""
    rows = stash(df.withColumn("__row", F.monotonically_increasing_id()), name)
    part = F.shiftright("__row", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task that wrote
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    met = rows.withColumn("__part", part).join(before, "__part")
    return met.withColumn("number", F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__row", "__before")


def _ints(x, dtype="<i8") -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype)


def encoded(made: DataFrame, frequent: DataFrame) -> DataFrame:
    """(chunk, ids, marks): words by their numbers, -1 for others and piece ends; marks: 1 where a prefix of one word begins that is projected, 2 where one is split."""
    each = made.select("lang", "chunk", F.posexplode("words").alias("at", "word"))
    # both sides grow with the corpus, so they are merged at every size
    met = each.join(frequent.select("lang", "word", "number", "hot").hint("merge"), ["lang", "word"], "left")
    known = met.groupBy("chunk").agg(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "number", "hot"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                known = b.column("known")[k].values
                at, number, hot = (known.field(c).to_numpy(zero_copy_only=False) for c in ("at", "number", "hot"))
                ids = _ints(b.column("ids")[k], "<i4")
                to, mark = np.full(int(ids.max()) + 1, -1, np.int32), np.zeros(int(ids.max()) + 1, np.uint8)
                to[at + 1], mark[at + 1] = number, 1 + hot
                out, marks = to[ids], mark[ids]
                grows = np.zeros(len(out), bool)
                grows[:-1] = out[1:] >= 0
                used = grows | np.concatenate([[False], grows[:-1] & (out[:-1] >= 0)])  # others stand alone
                gone = ~used
                gone[1:] &= ~used[:-1]  # of what isn't used one place stays, as an end
                out = np.where(used, out, -1)[~gone]
                yield pa.RecordBatch.from_pydict({"chunk": b.column("chunk")[k : k + 1], "ids": pa.array([out.astype("<i4").tobytes()], pa.binary()), "marks": pa.array([np.where(grows, marks, 0)[~gone].tobytes()], pa.binary())})

    return made.select("chunk", "ids").join(known, "chunk").mapInArrow(run, "chunk long, ids binary, marks binary")


def _suffixes(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The width words from each place on; -1 from the end of the piece on."""
    padded = np.concatenate([ids, np.full(width, -1, ids.dtype)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    return np.where(np.logical_and.accumulate(out >= 0, axis=1), out, -1)


PROJECTIONS = "bucket int, nodes binary, follows binary"


def _projection(node: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """PROJECTIONS: a row for each bucket of prefixes with their occurrences and what follows these."""
    some = rows[:, 0] >= 0
    node, rows = node[some], rows[some]
    bucket = (((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((node, bucket))
    node, rows, bucket = node[order], rows[order], bucket[order]
    rows = np.pad(rows, ((0, 0), (0, LONGEST - 1 - rows.shape[1])), constant_values=-1).astype("<i4")
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(node) else np.zeros(0, np.int64)
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=False):
        yield pa.RecordBatch.from_pydict({"bucket": bucket[i : i + 1], "nodes": pa.array([node[i:j].astype("<i8").tobytes()], pa.binary()), "follows": pa.array([rows[i:j].tobytes()], pa.binary())})


def _of_words(b: pa.RecordBatch, k: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, what follows) of the occurrences of a chunk's prefixes of one word with a mark."""
    ids, marks = _ints(b.column("ids")[k], "<i4"), _ints(b.column("marks")[k], "u1")
    at = np.flatnonzero(marks == mark)
    return (1 << DEPTH_AT) + ids[at].astype(np.int64), _suffixes(ids, at + 1, LONGEST - 1)


def projected_words(coded: DataFrame, buckets: int) -> DataFrame:
    """PROJECTIONS of the words that aren't split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from _projection(*_of_words(b, k, 1), buckets)

    return coded.mapInArrow(run, PROJECTIONS)


#: A chunk's occurrences of frequent prefixes of one length: each one's prefix, what follows it, and whether the prefix is split.
OCCURRENCES = "chunk long, node binary, follows binary, hot binary"


def _occurrences(chunk: int, node: np.ndarray, follows: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk]), **{c: pa.array([v.astype(t).tobytes()], pa.binary()) for c, v, t in (("node", node, "<i8"), ("follows", follows, "<i4"), ("hot", hot, "u1"))}})


def split_words(coded: DataFrame) -> DataFrame:
    """OCCURRENCES of the words that are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                node, follows = _of_words(b, k, 2)
                if len(node):
                    yield _occurrences(b.column("chunk")[k].as_py(), node, follows, np.ones(len(node)))

    return coded.mapInArrow(run, OCCURRENCES)


def _rows(b: pa.RecordBatch, k: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, what follows) of a chunk's occurrences whose prefix is split, or isn't, if a word follows."""
    node, own = _ints(b.column("node")[k]), _ints(b.column("hot")[k], "u1") == hot
    follows = _ints(b.column("follows")[k], "<i4").reshape(len(node), -1)
    own = own & (follows[:, 0] >= 0)
    return node[own], follows[own]


def extensions(occurrences: DataFrame) -> DataFrame:
    """(chunk, node, word, n): how often each word follows each split prefix in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                node, follows = _rows(b, k, 1)
                both, n = np.unique(np.stack([node, follows[:, 0].astype(np.int64)], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(n), b.column("chunk")[k].as_py(), np.int64)), "node": both[:, 0], "word": both[:, 1], "n": n})

    return occurrences.mapInArrow(run, "chunk long, node long, word long, n long")


def extended(occurrences: DataFrame) -> DataFrame:
    """OCCURRENCES one word longer, of ones with known (node, word, grown, hot), the frequent extensions of their split prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                node, follows = _rows(b, k, 1)
                known = b.column("known")[k].values
                a, w, grown, hot = (known.field(c).to_numpy(zero_copy_only=False) for c in ("node", "word", "grown", "hot"))
                _, code = np.unique(np.concatenate([np.stack([a, w], 1), np.stack([node, follows[:, 0].astype(np.int64)], 1)]), axis=0, return_inverse=True)
                code = code.reshape(-1)
                to, is_hot = np.full(int(code.max()) + 1, -1, np.int64), np.zeros(int(code.max()) + 1, np.uint8)
                to[code[: len(a)]], is_hot[code[: len(a)]] = grown, hot
                own = code[len(a) :]
                some = to[own] >= 0
                yield _occurrences(b.column("chunk")[k].as_py(), to[own[some]], follows[some, 1:], is_hot[own[some]])

    return occurrences.mapInArrow(run, OCCURRENCES)


def projected(occurrences: DataFrame, buckets: int) -> DataFrame:
    """PROJECTIONS of the prefixes that aren't split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from _projection(*_rows(b, k, 0), buckets)

    return occurrences.mapInArrow(run, PROJECTIONS)


def grow(rows: np.ndarray, least: int, place: int = 0, prefix: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], int]]:
    """(words, occurrences) of all frequent extensions, depth first; rows: what follows each occurrence from place on, in order."""
    column = rows[:, place]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    for k in np.flatnonzero((sizes >= least) & (column[starts] >= 0)).tolist():
        words = (*prefix, int(column[starts[k]]))
        yield words, int(sizes[k])
        if place + 1 < rows.shape[1]:
            yield from grow(rows[starts[k] : starts[k] + sizes[k]], least, place + 1, words)


def grown(projections: DataFrame, least: int) -> DataFrame:
    """(node, more, n): all frequent extensions of each projected prefix; a bucket's rows meet in one task, which grows its prefixes one after the other."""

    def patterns(nodes: list, follows: list) -> Iterator[tuple[int, tuple[int, ...], int]]:
        node, rows = np.frombuffer(b"".join(nodes), "<i8"), np.frombuffer(b"".join(follows), "<i4").reshape(-1, LONGEST - 1)
        _, at = np.unique(node, return_inverse=True)
        _, kind, n = np.unique(at * (int(rows[:, 0].max()) + 1) + rows[:, 0], return_inverse=True, return_counts=True)
        keep = n[kind] >= least  # what can grow at all
        node, rows = node[keep], rows[keep]
        if not len(node):
            return
        order = np.lexsort((*rows.T[::-1], node))
        node, rows = node[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])).tolist()
        for i, j in zip(starts, [*starts[1:], len(node)], strict=True):
            for words, count in grow(rows[i:j], least):
                yield int(node[i]), words, count

    def batch(found: list) -> pa.RecordBatch:
        node, more, n = zip(*found, strict=True)
        return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "more": pa.array(map(list, more), pa.list_(pa.int64())), "n": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, follows, found = None, [], [], []
        for b in batches:
            for k, bucket in enumerate(b.column("bucket").to_pylist()):
                if last is not None and bucket != last:
                    found += patterns(nodes, follows)
                    nodes, follows = [], []
                last = bucket
                nodes.append(b.column("nodes")[k].as_py())
                follows.append(b.column("follows")[k].as_py())
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        if nodes:
            found += patterns(nodes, follows)
        if found:
            yield batch(found)

    return projections.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, more array<long>, n long")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, split: int = SPLIT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, words, n) of all frequent phrases of 1 to LONGEST words, (lang, total) of all words).

    A-Z are lower-cased, texts cut into pieces at STOPS, and those into words at spaces and
    tabs. A null language is und, a null text empty.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    made = stash(chunks(texts, chunk), "phrase-chunks")
    totals = stash(made.groupBy("lang").agg(F.sum("total").alias("total")), "phrase-totals")
    each = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = stash(numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent-words").withColumn("hot", F.col("n") > split), "words")
    if words.agg(F.max("number")).first()[0] is not None and words.count() >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    coded = stash(encoded(made, words), "phrase-ids")
    buckets = 1 + (words.agg(F.sum("n")).first()[0] or 0) // BUCKET
    projections = [projected_words(coded, buckets)]
    nodes = words.select((F.col("number") + F.lit(1 << DEPTH_AT)).alias("node"), F.array("number").alias("numbers"), "n")
    levels = [nodes]
    occurrences = stash(split_words(coded), "split-words") if words.filter("hot").limit(1).count() else None
    depth = 1
    while occurrences is not None and depth < LONGEST:
        depth += 1
        counts = stash(extensions(occurrences), "extensions")
        often = counts.groupBy("node", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        often = often.join(nodes.select("node", "numbers"), "node").withColumns({"numbers": F.array_append("numbers", F.col("word")), "grown": F.monotonically_increasing_id() + F.lit(depth << DEPTH_AT), "hot": F.col("n") > split})
        often = stash(often, "frequent-extensions")
        nodes = often.select(F.col("grown").alias("node"), "numbers", "n")
        levels.append(nodes)
        if depth == LONGEST:
            break
        known = counts.join(often.select("node", "word", "grown", "hot"), ["node", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("node", "word", "grown", "hot")).alias("known"))
        occurrences = stash(extended(occurrences.join(known, "chunk")), "occurrences")
        projections.append(projected(occurrences, buckets))
        occurrences = occurrences if often.filter("hot").limit(1).count() else None
    whole = reduce(DataFrame.unionByName, levels)
    found = grown(reduce(DataFrame.unionByName, projections), least)
    longer = found.join(whole.select("node", "numbers"), "node").select(F.concat("numbers", "more").alias("numbers"), "n")
    numbers = stash(whole.select("numbers", "n").unionByName(longer).withColumn("id", F.monotonically_increasing_id()), "patterns")
    spelled = numbers.select("id", "n", F.posexplode("numbers").alias("at", "number")).join(words.select("lang", "word", "number"), "number")
    back = spelled.groupBy("id", "n", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return stash(back.select("lang", F.col("w.word").alias("words"), "n"), "phrases"), totals


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of all phrases of two words or more, by their lowest-scoring cut."""
    counts = phrases.select("lang", _text(F.col("words")).alias("phrase"), "n")
    cut = phrases.filter(F.size("words") > 1).select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", _text(F.col("words")).alias("phrase"), F.size("words").alias("size"), "a", "k", _text(F.expr("slice(words, 1, k)")).alias("left"), _text(F.expr("slice(words, k + 1, size(words))")).alias("right"))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    met = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals.select("lang", F.col("total").alias("n")), "lang")
    met = met.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(16,0)) * cast(n as decimal(18,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = met.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to LONGEST words.

    a: occurrences of the phrase, l and r of its parts at the lowest-scoring cut, n of all words;
    score: floor(1000 * a * n / (l * r)). A phrase that stands in a longer frequent one as often
    as by itself is left out. Ranked by score, occurrences, then the phrase's bytes. Rows that
    repeat count again; null languages are und, null and empty texts have no words, other columns
    are ignored; no rows in, no rows out. Exact while a < 10**16 and n < 10**18.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, **limits)
    # counts can't rise with length, so a longer phrase as frequent is there with one word more
    longer = phrases.filter(F.size("words") > 2).select("lang", F.col("n").alias("a"), F.explode(F.array(_text(F.expr("slice(words, 1, size(words) - 1)")), _text(F.expr("slice(words, 2, size(words) - 1)")))).alias("phrase")).distinct()
    kept = stash(scored(phrases, totals).join(longer, ["lang", "phrase", "a"], "left_anti"), "collocations")
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
