"""Byte-level BPE by a file of ranks: the tokenizers library encodes, a byte table decodes.

A rank file names byte strings by rank. Each byte becomes a character of the byte-level
alphabet, and every pair of known parts of a known string becomes a merge at that string's
rank, which is what merging by rank means. Decoding looks ids up in the table of byte
strings; a character whose bytes are split over ids comes together again in the bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.common import Encoder, byte_chars, map_arrow, narrow, ragged, small_batches

_CODECS: dict[str, RankCodec] = {}


class RankCodec:
    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        table = byte_chars()
        shown = lambda b: b.decode("latin-1").translate(table)
        merges = [(shown(t[:k]), shown(t[k:])) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.encoder = Encoder(BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges), pattern)
        n = max(ranks.values()) + 1
        strings = [b""] * n
        for t, r in ranks.items():
            strings[r] = t
        strings.append(b"")  # of ids that aren't in the table
        self.lens = np.array([len(t) for t in strings], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.names = [str(i) for i in range(n)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; an id that isn't in the table has none."""
        ids = np.where((ids >= 0) & (ids < len(self.lens) - 1), ids, len(self.lens) - 1)
        lens = self.lens[ids]
        flat = self.bytes[ragged(self.starts[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def offsets(self, counts: np.ndarray, ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each id in characters of its text; a split character belongs to all its ids."""
        first, last = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate(texts):
            lens = self.lens[ids[ends[i] : ends[i + 1]]]
            if len(lens):
                char = np.cumsum((np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
                to = np.cumsum(lens)
                first.append((char[to - lens] - 1).astype(np.int32))
                last.append(char[to - 1].astype(np.int32))
        return np.concatenate(first), np.concatenate(last)


def codec(path: str, pattern: str) -> RankCodec:
    if path not in _CODECS:
        _CODECS[path] = RankCodec(path, pattern)
    return _CODECS[path]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): ids of whole texts and their character offsets.

    Null and empty texts give empty lists; repeated rows and null ids stay as they are; other
    columns are ignored; no rows in, no rows out.
    """
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> dict:
        c, texts = codec(ranks, pattern), b.column("text").to_pylist()
        counts, ids = c.encode(texts)
        first, last = c.offsets(counts, ids, texts)
        at = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return {"doc_id": b.column("doc_id"), **{k: pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for k, v in (("ids", ids), ("starts", first), ("ends", last))}}

    return map_arrow(narrow(docs, id_col, text_col), f, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, text_bytes, text) of (doc_id, ids); bytes that aren't whole characters become U+FFFD in text. Null ids are no ids, ids that aren't in the table have no bytes."""

    def f(b: pa.RecordBatch) -> dict:
        lists = [x or [] for x in b.column("ids").to_pylist()]
        raw = codec(ranks, pattern).decode(np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.int64))
        return {"doc_id": b.column("doc_id"), "text_bytes": pa.array(raw, pa.binary()), "text": [x.decode("utf-8", "replace") for x in raw]}

    return map_arrow(tokens.select("doc_id", "ids"), f, "doc_id long, text_bytes binary, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> dict:
        c = codec(ranks, pattern)
        counts, ids = c.encode(b.column("text").to_pylist())
        ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
        names, flat = c.names, ids.tolist()
        return {
            "doc_id": b.column("doc_id"), "n_tokens": counts,
            "ids_sha256": [hashlib.sha256(" ".join([names[k] for k in flat[i:j]]).encode()).hexdigest() for i, j in zip(ends, ends[1:], strict=False)],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in c.decode(counts, ids)],
        }

    return map_arrow(narrow(docs, id_col, text_col), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
