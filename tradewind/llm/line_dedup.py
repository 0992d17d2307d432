"""Substring dedup by hashing lines.

Units are lines (or paragraphs), the sentences in them, and windows of WINDOW words chosen by
their hashes alone (winnowing): of each FOUND words in a row, wherever they stand, the window
with the least hash is a unit, so any FOUND words that come back share one, also in the middle
of a longer line. Where a script has no spaces, each character counts as a word. Normalised
units (words in lower case, white space left out) become 128-bit digests, which are grouped
globally: the least document is a minimum made before the shuffle, so a line that a third of
all documents share is no large group. The occurrence in the smallest document, first in it,
stays.

What goes are passages: units that stood before and touch or overlap are one run of words, and
a run goes if one of its units has `least` words or more. So short lines that many texts share
in passing stay, unless they lengthen such a run; least=1 cuts every line that stood before.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import fresh_name, map_arrow, narrow, quoted, small_batches, stash

#: Words in a window, in a row of words that surely has one, and in the shortest unit that makes a run go.
WINDOW, FOUND, LEAST = 20, 50, 20
#: Sentences of fewer words only count as parts of lines and windows, unless runs as short as that are to go.
SENTENCE = 5
#: Characters hashed at a time, about.
GROUP_CHARS = 1_000_000
#: Kinds of characters: in words, sentence ends, closing quotes; white space, line ends; those that are words by themselves, and end sentences.
PLAIN, END, CLOSER, SPACE, LINE, DENSE, DENSE_END = range(7)
#: Letters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, Tai, kana, Han.
DENSE_RANGES = [
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
]
_CHAR_BASE, _BASE0, _BASE1 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_FAR = (1 << 63) - 1
#: words: first word << 32 | words << 1 | again; span: first character << 32 | end. Spark keeps eight bytes a column whatever its type.
UNITS = "doc_id long, text_key long, words long, span long, d0 long, d1 long"
U = np.uint64


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, simple lower case) of each code point."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for a, b in DENSE_RANGES:
        kinds[a : b + 1] = DENSE
    for chars, kind in ((".!?…", END), ("\"'”’)]»", CLOSER), ("。！？", DENSE_END), ("\n", LINE)):
        kinds[[ord(c) for c in chars]] = kind
    for c in range(0x1F000):
        x = chr(c)
        if c < 0x3001 and x.isspace() and x != "\n":
            kinds[c] = SPACE
        if len(x.lower()) == 1:
            lower[c] = ord(x.lower())
    return kinds, lower


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, GROUP_CHARS + 1), x, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = both[0], both[1]
    a, b = _POWERS[base]
    return a[:n], b[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)  # a splitmix64 multiplier
    return h ^ (h >> U(29))


def spans_of(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of values[start:stop] for each span, the same wherever it stands."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[stop] - sums[start]) * down[start]


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each width values in a row."""
    have = 1
    while have * 2 <= width:
        x, have = f(x[:-have], x[have:]), have * 2
    return x if have == width else f(x[: len(x) - (width - have)], x[width - have :])


def picked(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the windows chosen: the least of each FOUND words of a text. h: hash of the window at each word; of equal ones that overlap, one in WINDOW words is."""
    if len(text) < FOUND:
        return np.zeros(0, np.int64)
    width = FOUND - WINDOW + 1
    least = np.where(text[: len(text) - FOUND + 1] == text[FOUND - 1 :], sliding(np.minimum, h, width), U(0))
    pad = np.zeros(width - 1, U)
    at = np.flatnonzero(h == sliding(np.maximum, np.concatenate([pad, least, pad]), width))
    at = at[h[at] > 0]
    order = np.lexsort((at, h[at]))
    x, same = at[order], np.zeros(len(at), bool)
    same[1:] = (h[x[1:]] == h[x[:-1]]) & (x[1:] - x[:-1] < WINDOW)
    chain = np.cumsum(~same) - 1  # equal windows that overlap: of each WINDOW words the first
    step = (x - x[~same][chain]) // WINDOW
    first = ~same
    first[1:] |= step[1:] != step[:-1]
    return np.sort(x[first])


def words_of(text: str) -> tuple[np.ndarray, ...]:
    """(first character, end, hash, sentence, line) of each word; texts are parted by line ends."""
    kinds, lower = tables()
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds[chars]
    inside = k <= CLOSER
    edge = np.zeros(1, bool)
    start = np.flatnonzero((inside & ~np.concatenate([edge, inside[:-1]])) | (k >= DENSE))
    stop = np.flatnonzero((inside & ~np.concatenate([inside[1:], edge])) | (k >= DENSE)) + 1
    h = mix(spans_of(lower[chars].astype(U) + U(1), _CHAR_BASE, start, stop))
    space_next = np.concatenate([(k[1:] == SPACE) | (k[1:] == LINE), ~edge])
    after_end = np.concatenate([edge, k[:-1] == END])
    ends = (k == LINE) | (k == DENSE_END) | (((k == END) | (k == CLOSER) & after_end) & space_next)
    return start, stop, h, (np.cumsum(ends) - ends)[start], np.cumsum(k == LINE)[start]


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run of equal keys."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])


def units(texts: list[str], unit: str = "line", least_sentence: int = 1) -> dict[str, np.ndarray]:
    """Units of texts: number of the text, first word, words, first character, end, digest (d0, d1), whether it stood before in the text.

    unit: what lines are: line, or paragraph (parted by empty lines); least_sentence: words of a sentence that is a unit.
    """
    first_char = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, stop, h, sentence, line = words_of("\n".join(texts))
    if not len(start):
        empty = np.zeros(0, np.int64)
        return {c: empty for c in ("text", "word", "n_words", "start", "stop", "d0", "d1")} | {"again": np.zeros(0, bool)}
    text = np.searchsorted(first_char, start, "right") - 1
    if unit == "paragraph":
        line = np.cumsum(np.concatenate([[False], (np.diff(line) > 1) | (np.diff(text) > 0)]))
    n = len(start)
    i = np.arange(max(0, n - WINDOW + 1))
    at = picked(mix(spans_of(h, _BASE0, i, i + WINDOW)), text)
    first, end = runs(sentence)
    long = end - first >= least_sentence
    parts = [(first[long], end[long]), runs(line), (at, at + WINDOW)]
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    once = np.unique(a * (n + 1) + b)  # a line of one sentence is one unit
    a, b = once // (n + 1), once % (n + 1)
    length = (b - a).astype(U)
    d0, d1 = mix(spans_of(h, _BASE0, a, b) + length), mix(spans_of(mix(h ^ U(_BASE1)), _BASE1, a, b) + length)
    order = np.lexsort((a, d1, d0, text[a]))
    again = np.zeros(len(a), bool)
    x, y = order[1:], order[:-1]
    again[x] = (text[a[x]] == text[a[y]]) & (d0[x] == d0[y]) & (d1[x] == d1[y])
    first_word = np.searchsorted(start, first_char)
    return {
        "text": text[a], "word": a - first_word[text[a]], "n_words": b - a, "start": start[a] - first_char[text[a]], "stop": stop[b - 1] - first_char[text[a]],
        "d0": d0.view(np.int64), "d1": d1.view(np.int64), "again": again,
    }


def key_of(text: Column) -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def unit_table(docs: DataFrame, unit: str = "line", least_sentence: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of UNITS; again: the unit has stood before in the same text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= GROUP_CHARS or i == len(texts) - 1:
                    x = units(texts[lo : i + 1], unit, least_sentence)
                    rows = pa.array(x["text"] + lo)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": b.column("doc_id").take(rows), "text_key": b.column("text_key").take(rows), "words": x["word"] << 32 | x["n_words"] << 1 | x["again"],
                        "span": x["start"] << 32 | x["stop"], "d0": x["d0"], "d1": x["d1"],
                    })
                    lo, size = i + 1, 0

    return narrow(docs, id_col, text_col).withColumn("text_key", key_of(F.col("text"))).mapInArrow(run, UNITS)


def repeats(docs: DataFrame, least: int = LEAST, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, n_words, keep_id, text_key): a row for each passage that goes.

    start and stop count characters of the text; keep_id is the smallest document in which one
    of its units stays. Null and empty texts have no units. A null id ranks last; rows that
    repeat an id rank alike, so each keeps its first occurrence. Other columns are ignored; no
    rows in, no rows out.
    """
    table = stash(unit_table(docs, unit, min(SENTENCE, least), id_col, text_col), "units")
    rank = F.coalesce("doc_id", F.lit(_FAR))
    # written, so that the join deals both sides anew and Spark can split a line that very many texts share
    groups = stash(table.groupBy("d0", "d1").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-units")
    gone = table.join(groups, ["d0", "d1"]).filter((F.col("words").bitwiseAND(1) == 1) | (rank > F.col("first"))).drop("d0", "d1")
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    gone = gone.select("doc_id", "text_key", high("words").alias("word"), F.shiftright(low("words"), 1).cast("int").alias("n_words"), high("span").alias("start"), low("span").cast("int").alias("stop"), "first")
    gone = gone.withColumn("end", F.col("word") + F.col("n_words"))
    # a text's units are as many as its words at most, so a window over one text is bounded by it
    before = Window.partitionBy("doc_id", "text_key").orderBy("word", "end")
    marked = gone.withColumn("reach", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("run", F.count_if(F.col("word") > F.col("reach")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("word")).alias("n_words"), F.min("first").alias("first"), F.max("n_words").alias("longest"))
    return whole.filter(F.col("longest") >= least).select("doc_id", "start", "stop", "n_words", F.nullif("first", F.lit(_FAR)).alias("keep_id"), "text_key")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space after a span goes with it, and its line if nothing is left there."""
    out: list[str] = []
    at, fresh = 0, True  # fresh: what is left so far ends at a line's start
    for start, stop in sorted(spans):
        between = text[at:start]
        if between:
            out.append(between)
            fresh = between.rstrip(" \t\r").endswith("\n") or fresh and not between.strip(" \t\r")
        while stop < len(text) and text[stop] in " \t\r":
            stop += 1
        if fresh and stop < len(text) and text[stop] == "\n":
            stop += 1
        at = max(at, stop)
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, least: int = LEAST, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, in text_col what stays; a text that loses everything is empty, a null text stays null.

    Texts without repeats come back as they were. The spans of one text meet in one row.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    id_, key, spans = (fresh_name(names, c) for c in ("id", "key", "spans"))
    gone = repeats(docs, least, unit, id_col, text_col)
    found = stash(gone.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.collect_list(F.struct("start", "stop")).alias(spans)), "spans")
    met = docs.join(found, quoted(id_col).cast("long").eqNullSafe(F.col(id_)) & (key_of(quoted(text_col)) == F.col(key)), "left")

    def f(b: pa.RecordBatch) -> dict:
        texts = [t if s is None else cut(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(b.column(text_col).to_pylist(), b.column(spans).to_pylist(), strict=True)]
        return {c: pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names}

    return map_arrow(met.select(*[quoted(c) for c in names], spans), f, docs.schema)
