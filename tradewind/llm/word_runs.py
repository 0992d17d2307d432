"""Runs of repeated words by the runs theorem.

A run is a longest stretch of words with a period; each run holds a Lyndon word as long as its
smallest period, and from the places where such a word stands as the longest Lyndon word, under
the words' order or the reversed one, the whole run follows by two extensions. Longest Lyndon
words come from the next smaller value in the inverse suffix array, extensions from the array
of longest common prefixes and range minima over it in a sparse table.

Texts are independent, so nothing is shuffled. Those of an Arrow batch are worked on together,
some hundred thousand words at a time: a word that occurs fewer than POWER times in its stretch
cannot lie in a run that counts, so such words cut a text into stretches first, and suffixes are
sorted by doubling, of which only those not yet told apart take part in the next round.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.common import map_arrow, narrow, small_batches

#: A run counts with POWER periods and SHORTEST words at least.
POWER, SHORTEST = 4, 6
#: Words of several texts that are worked on together; a longer text is alone.
GROUP_WORDS = 200_000
#: (start, length, period) of a run.
Run = tuple[int, int, int]


class Suffixes:
    """Suffixes of a sequence of stretches, each ordered within its own stretch; the shorter of two comes first if it begins the other.

    values: integers; part: ascending number of each value's stretch.
    """

    def __init__(self, values: np.ndarray, part: np.ndarray):
        n = self.n = len(values)
        self.part = part
        self.ends = np.searchsorted(part, part, "right")
        self.levels: list[np.ndarray] = []
        order = np.lexsort((values, part))
        new = np.ones(n, bool)
        new[1:] = (values[order[1:]] != values[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
        self.rank = self._ranks(order, new, np.arange(n))
        width = 1
        while True:
            count = np.bincount(self.rank, minlength=n)
            open_ = np.flatnonzero(count[self.rank] > 1)
            self.levels.append(self.rank.astype(np.int32 if n < 1 << 31 else np.int64))
            if not len(open_):
                break
            after = open_ + width
            inside = after < self.ends[open_]
            second = np.where(inside, self.rank[np.minimum(after, n - 1)] + 1, 0)
            first = self.rank[open_]
            by = np.lexsort((second, first))
            order, f, s = open_[by], first[by], second[by]
            group = np.ones(len(by), bool)
            group[1:] = f[1:] != f[:-1]
            new = group.copy()
            new[1:] |= s[1:] != s[:-1]
            begin = np.maximum.accumulate(np.where(group, np.arange(len(by)), 0))
            place = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
            rank = self.rank.copy()
            rank[order] = f + place - begin  # a rank is the place of the first of its group, so finished ones stay
            self.rank, width = rank, 2 * width
        self.lcp = self._lcp()
        self.table = self._minima()

    def _ranks(self, order: np.ndarray, new: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        return rank

    def _lcp(self) -> np.ndarray:
        """Of each suffix in order and the one before it; 0 across stretches."""
        order = np.empty(self.n, np.int64)
        order[self.rank] = np.arange(self.n)
        i, j = order[1:].copy(), order[:-1].copy()
        same = self.part[i] == self.part[j]
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):  # equal ranks of a level are equal for 2**k values, as no other suffix is as short
            a, b = i + got, j + got
            fits = same & (a < self.ends[i]) & (b < self.ends[j])
            level = self.levels[k]
            got[fits] += (level[a[fits]] == level[b[fits]]).astype(np.int64) << k
        return np.concatenate([[0], got])

    def _minima(self) -> list[np.ndarray]:
        out = [self.lcp]
        while 2 << (len(out) - 1) <= self.n:
            x, half = out[-1], 1 << (len(out) - 1)
            out.append(np.minimum(x[:-half], x[half:]))
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (i < j, one stretch); 0 where j is the stretch's end."""
        out = np.zeros(len(i), np.int64)
        some = np.flatnonzero(j < self.ends[i])
        a, b = self.rank[i[some]], self.rank[j[some]]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            x = self.table[level]
            out[some[at]] = np.minimum(x[lo[at]], x[hi[at] - (1 << level) + 1])
        return out


def next_smaller(rank: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each place the next one in its stretch with a smaller rank, or the stretch's end: where its longest Lyndon word ends."""
    out = ends.copy()
    values, stops = rank.tolist(), ends.tolist()
    found: list[tuple[int, int]] = []
    stack: list[int] = []
    stop = -1
    for i, v in enumerate(values):
        if stops[i] != stop:
            stack, stop = [], stops[i]
        while stack and values[stack[-1]] > v:
            found.append((stack.pop(), i))
        stack.append(i)
    if found:
        at = np.array(found)
        out[at[:, 0]] = at[:, 1]
    return out


def stretches(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of words that may lie in a run that counts, and the number of each one's stretch: (place, stretch) columns."""
    at = np.arange(len(ids))
    part = text.astype(np.int64)
    while len(at):
        _, kind = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True)
        keep = np.bincount(kind)[kind] >= POWER
        left, old = at[keep], part[keep]
        fresh = np.ones(len(left), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (left[1:] != left[:-1] + 1)
        number = np.cumsum(fresh) - 1
        long = np.bincount(number, minlength=1)[number] >= SHORTEST if len(number) else np.zeros(0, bool)
        if keep.all() and long.all():
            return np.stack([left, number], 1)
        at, part = left[long], number[long]
    return np.zeros((0, 2), np.int64)


def word_runs(ids: np.ndarray, text: np.ndarray) -> list[tuple[int, Run]]:
    """(text, (start, length, period)) of all runs that count; ids: the words of several texts, text: ascending number of each word's text."""
    kept = stretches(ids, text)
    if not len(kept):
        return []
    place, part = kept[:, 0], kept[:, 1]
    values = ids[place]
    found: set[Run] = set()
    for order in (values, -values):
        s = Suffixes(order, part)
        end = next_smaller(s.rank, s.ends)
        i = np.arange(s.n)
        period = end - i
        # the first root of a run stands in its first period, so POWER - 2 more periods follow it at least
        some = np.flatnonzero((period * (POWER - 1) <= s.ends - i) & (end < s.ends))
        ahead = s.common(some, end[some])
        some = some[ahead >= period[some] * (POWER - 2)]
        if len(some):
            stop = end[some] + s.common(some, end[some])
            key = np.lexsort((some, stop, period[some]))
            first = np.ones(len(key), bool)
            first[1:] = (period[some][key[1:]] != period[some][key[:-1]]) | (stop[key[1:]] != stop[key[:-1]])
            at = some[key[first]]
            found |= set(zip(at.tolist(), stop[key[first]].tolist(), period[at].tolist(), strict=True))
    if not found:
        return []
    roots = np.array(sorted(found))
    # backwards in the stretches that have roots, by the suffixes of their words in reverse
    used = np.isin(part, part[roots[:, 0]])
    where = np.flatnonzero(used)[::-1]
    back = Suffixes(values[where], -part[where])
    to = np.full(len(values), -1)
    to[where] = np.arange(len(where))
    i, period = roots[:, 0], roots[:, 2]
    before = (i > 0) & (part[i - 1] == part[i])
    left = np.zeros(len(roots), np.int64)
    if before.any():
        a = i[before] - 1
        left[before] = back.common(to[a + period[before]], to[a])
    start, length = i - left, roots[:, 1] - i + left
    ok = (length >= POWER * period) & (length >= SHORTEST)
    first = np.searchsorted(text, np.arange(int(text[-1]) + 1))
    out = {(int(text[place[a]]), (int(place[a] - first[text[place[a]]]), int(n), int(p))) for a, n, p in zip(start[ok], length[ok], period[ok], strict=True)}
    return sorted(out, key=lambda r: (r[0], r[1][0], r[1][2]))


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) by which a tenth of the documents repeat their words from a on with period p; by the crc32 of the id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact exponent; of ties the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The text without what a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


COLUMNS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, collapsed: bool = False) -> DataFrame:
    """Each document's runs of words: COLUMNS, a row for each row of docs.

    Words are parted by ASCII white space and compared as they are. start, length, period and
    exponent_milli are those of the strongest run, null without one; runs_sha256 is over all runs,
    collapsed_sha256 over the words that no run repeats. plant rewrites a tenth of the documents
    into repetitions first (by id; a null id is never rewritten), collapsed adds the collapsed text.
    Null and empty texts have no words and no runs; rows that repeat are treated alike; other
    columns are ignored; no rows in, no rows out.
    """
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> dict:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        out: list[tuple] = []
        group: list[tuple] = []
        held = 0
        for k, doc_id in enumerate(ids):
            words = texts[k].as_py().encode().split()
            if at := planted(doc_id, len(words)):
                a, p = at
                words = [*words[:a], *(words[a : a + p] * (1 + (len(words) - a) // p))[: len(words) - a]]
            group.append((doc_id, words))
            held += len(words)
            if held >= GROUP_WORDS or k == len(ids) - 1:
                out += described(group, collapsed)
                group, held = [], 0
        columns = zip(*out, strict=True)
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["text"] * collapsed
        return {c: pa.array(v, pa.string() if c in ("runs_sha256", "collapsed_sha256", "text") else pa.int64()) for c, v in zip(names, columns, strict=True)}

    return map_arrow(narrow(docs, id_col, text_col), f, COLUMNS + ", text string" * collapsed)


def described(group: list[tuple[int | None, list[bytes]]], collapsed: bool) -> list[tuple]:
    """The result's rows of some documents."""
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for _, words in group for w in words), np.int64)
    text = np.repeat(np.arange(len(group)), [len(words) for _, words in group])
    runs: dict[int, list[Run]] = {}
    for k, run in word_runs(flat, text):
        runs.setdefault(k, []).append(run)
    out = []
    for k, (doc_id, words) in enumerate(group):
        own = runs.get(k, [])
        best = strongest(own)
        rest = collapse(words, own)
        listing = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        out.append((
            doc_id, len(words), len(own), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), *([rest.decode()] if collapsed else []),
        ))
    return out
