"""Packing token sequences by non-negative least squares on the histogram of lengths.

A document's whole windows are sequences of their own; its tail, shorter than the window,
waits for others. Tails count only by length: the histogram has fewer than WINDOW bins at
any size of the corpus, and all planning is done on it. Shallow combinations (two to four
lengths that fill the window exactly) are the columns of a matrix; non-negative least
squares finds how often to use each, so that the columns add up to the histogram. Rounded
down and held to what is there, these make full sequences of uncut tails. What they leave
is packed greedily end to end, cut where a window is full. The last window, which may stay
part empty, is cut at powers of two, and such sequences need no padding.

Where a tail goes follows from its length and its number among the tails of that length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import id_lists, json_encoder, map_arrow, narrow, small_batches, stash

WINDOW = 4096
#: Lengths that combinations of three and four are made of, and combinations of each depth, at most.
COMMON, COLUMNS = 64, 4096
#: Sweeps of coordinate descent.
SWEEPS = 30

TOKENS = "doc_id long, part int, n_tokens long, tail int, windows_before long, nth long, ids binary"


def combinations(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Exact fills of the window by two lengths (all) and by three or four (whose first ones are common)."""
    there = np.flatnonzero(hist)
    have = set(there.tolist())
    out = [(a, window - a) for a in there.tolist() if 2 * a <= window and window - a in have]
    common = np.sort(there[np.argsort(-hist[there], kind="stable")][:COMMON]).tolist()
    threes = [(a, b, window - a - b) for i, a in enumerate(common) for b in common[i:] if window - a - b >= b and window - a - b in have]
    fours = [(a, b, c, window - a - b - c) for i, a in enumerate(common[:24]) for j, b in enumerate(common[i:24], i) for c in common[j:24] if window - a - b - c >= c and window - a - b - c in have]
    weight = lambda c: -min(hist[x] / c.count(x) for x in c)
    return out + sorted(threes, key=weight)[:COLUMNS] + sorted(fours, key=weight)[:COLUMNS]


def solve(columns: list[tuple[int, ...]], hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, by coordinate descent."""
    left = hist.astype(float)
    x = np.zeros(len(columns))
    parts = [np.unique(c, return_counts=True) for c in columns]
    norms = [float((n * n).sum()) for _, n in parts]
    for _ in range(SWEEPS):
        moved = 0.0
        for k, (at, n) in enumerate(parts):
            new = max(0.0, x[k] + float((n * left[at]).sum()) / norms[k])
            if new != x[k]:
                left[at] -= n * (new - x[k])
                moved = max(moved, abs(new - x[k]))
                x[k] = new
        if moved < 0.25:
            break
    return x


@dataclass
class Plan:
    """Where tails go. For length L, runs begin[L] .. begin[L+1]-1: the tails from number first[r] on go to sequences base[r], base[r]+1, ..., at offset[r]."""

    window: int
    begin: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    fitted: np.ndarray  # tails of each length in combinations
    stream: np.ndarray  # where each length's other tails begin, end to end
    stream_base: int  # first sequence of the stream
    last_cuts: np.ndarray  # where the stream's last, part empty window is cut

    def tail(self, length: int, nth: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a tail."""
        if nth < self.fitted[length]:
            lo, hi = self.begin[length], self.begin[length + 1]
            r = lo + int(np.searchsorted(self.first[lo:hi], nth, "right")) - 1
            return [(0, length, int(self.base[r] + nth - self.first[r]), int(self.offset[r]))]
        at = int(self.stream[length] + (nth - self.fitted[length]) * length)
        out, done = [], 0
        cuts = self.last_cuts
        last = cuts[0] if len(cuts) else None
        while done < length:
            pos = at + done
            if last is not None and pos >= last:
                k = int(np.searchsorted(cuts, pos, "right")) - 1
                seq, off, end = self.stream_base + last // self.window + k, pos - cuts[k], cuts[k + 1]
            else:
                seq, off, end = self.stream_base + pos // self.window, pos % self.window, (pos // self.window + 1) * self.window
            n = min(length - done, int(end) - pos)
            out.append((done, n, int(seq), int(off)))
            done += n
        return out


def make_plan(hist: np.ndarray, first_sequence: int, window: int = WINDOW) -> Plan:
    """The plan for tails by length (hist[L] tails of L, 0 < L < window); sequences count from first_sequence."""
    left = hist.astype(np.int64).copy()
    columns = combinations(left, window)
    x = solve(columns, left)
    uses = np.zeros(len(columns), np.int64)
    for rounds in (np.floor(x + 1e-9).astype(np.int64), None):  # the rounded counts, then what still fits whole
        for k in np.argsort(-x, kind="stable"):
            at, n = np.unique(columns[k], return_counts=True)
            m = int((left[at] // n).min())
            m = m if rounds is None else min(m, int(rounds[k]))
            left[at] -= m * n
            uses[k] += m
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
    used = np.zeros(window, np.int64)
    seq = first_sequence
    for k in np.flatnonzero(uses):
        off = 0
        for length in columns[k]:
            runs[length].append((int(used[length]), seq, off))
            used[length] += uses[k]
            off += length
        seq += int(uses[k])
    flat = [r for rs in runs for r in rs]
    begin = np.concatenate([[0], np.cumsum([len(rs) for rs in runs])])
    lengths = np.arange(window)
    tokens = left * lengths
    stream = np.cumsum(tokens) - tokens
    total = int(tokens.sum())
    rest, at, cuts = total % window, total - total % window, []
    if rest:
        cuts = [at]
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
    a = np.array(flat, np.int64).reshape(-1, 3)
    return Plan(window, begin, a[:, 0], a[:, 1], a[:, 2], used, stream, seq, np.array(cuts, np.int64))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Rows of TOKENS, written: ids with end_id after each text, and each tail's number among those of its length in its part."""
    small_batches(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        part, windows, encoder = TaskContext.get().partitionId(), 0, json_encoder(vocabulary, added)
        seen = np.zeros(window, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            counts, ids = id_lists(*encoder.encode(b.column("text").to_pylist()), end_id)
            raw, ends = ids.astype("<u2" if end_id < 65536 and (not len(ids) or ids.max() < 65536) else "<u4"), np.concatenate([[0], np.cumsum(counts)])
            tails = counts % window
            nth = np.zeros(len(counts), np.int64)
            for i, t in enumerate(tails.tolist()):
                nth[i] = seen[t]
                seen[t] += 1
            full = counts // window
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "part": pa.array(np.full(b.num_rows, part, np.int32)), "n_tokens": counts, "tail": pa.array(tails, pa.int32()),
                "windows_before": windows + np.cumsum(full) - full, "nth": nth, "ids": pa.array([raw[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary()),
            })
            windows += int(full.sum())

    return stash(narrow(docs, id_col, text_col).mapInArrow(encode, TOKENS), "packed-tokens")


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row a piece; ids: little-endian unsigned 32-bit integers.

    tokens: written rows of TOKENS. What the driver gathers is the histogram of tails (fewer
    than window rows); what each part adds to numbers of windows and tails is joined as a table.
    """
    bins = stash(tokens.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).cast("long").alias("windows")), "packing-bins")
    hist = np.zeros(window, np.int64)
    for r in bins.groupBy("tail").agg(F.sum("n").alias("n")).collect():  # at most window rows
        hist[r["tail"]] = r["n"]
    hist[0] = 0
    whole = bins.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    plan = make_plan(hist, int(whole), window)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = bins.groupBy("part").agg(F.sum("windows").alias("windows")).select("part", before("windows", Window.orderBy("part")).alias("part_windows"))
    starts = bins.select("part", "tail", before("n", Window.partitionBy("tail").orderBy("part")).alias("nth_before")).join(parts, "part")
    placed = tokens.join(starts, ["part", "tail"])

    def place(b: pa.RecordBatch) -> dict:
        doc_id, n_tokens, tail = b.column("doc_id"), b.column("n_tokens").to_numpy(), b.column("tail").to_numpy()
        nth = (b.column("nth").to_numpy() + b.column("nth_before").to_numpy()).tolist()
        sequence = (b.column("windows_before").to_numpy() + b.column("part_windows").to_numpy()).tolist()
        rows, pieces, out = [], [], []
        for i, raw in enumerate(b.column("ids").to_pylist()):
            n, t = int(n_tokens[i]), int(tail[i])
            flat = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            own = [(k * window, window, sequence[i] + k, 0) for k in range(n // window)]
            own += [(n - t + s, m, q, o) for s, m, q, o in (plan.tail(t, nth[i]) if t else [])]
            rows += [i] * len(own)
            pieces += own
            out += [flat[s : s + m].tobytes() for s, m, _, _ in own]
        at = np.array(rows, np.int64)
        cols = np.array(pieces, np.int64).reshape(-1, 4)
        return {
            "doc_id": doc_id.take(pa.array(at)), "start": cols[:, 0], "length": cols[:, 1], "ids_crc32": pa.array([zlib.crc32(x) for x in out], pa.int64()),
            "doc_tokens": n_tokens[at], "sequence_id": cols[:, 2], "offset": cols[:, 3], "ids": pa.array(out, pa.binary()),
        }

    return map_arrow(placed, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Encode whole texts and pack them; a row a piece, as pack() gives them.

    A null or empty text is end_id alone; rows that repeat an id are packed like any others;
    null ids stay null; other columns are ignored; no rows in, no rows out. A sequence is full
    but for those of the last window, whose lengths are powers of two.
    """
    return pack(encode_documents(docs, vocabulary, end_id, window, id_col, text_col, added), window)
