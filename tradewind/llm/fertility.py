"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback cuts each word into pieces. Characters per token, the
share of tokens that are fallback bytes, and the entropy of a text's tokens are held against
bands for its language, or for its script where the language is unknown. The lower bound on
characters per token gives way by SLACK / sqrt(tokens) + SHORT / tokens, since short texts vary
more and a number or an address weighs more in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import KEPT, WORD, Pool, flat, quoted, ragged, small_batches

#: Language or script: least characters per token, largest share of fallback bytes, least token entropy in bits.
BANDS = {
    "en": (2.10, 0.15, 2.5),
    "de": (2.10, 0.15, 2.5),
    "fr": (1.85, 0.15, 2.5),
    "es": (1.83, 0.15, 2.5),
    "latin": (1.60, 0.25, 2.5),
    "greek": (0.80, 0.40, 2.5),
    "cyrillic": (1.20, 0.30, 2.5),
    "other": (0.25, 1.00, 2.0),
}
SLACK, SHORT = 5.0, 30.0
#: Token entropy says little below so many tokens.
ENTROPY_TOKENS = 30
#: First code points of scripts, for texts without a known language.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"))
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
_SYMBOLS = "#*$%&|<>"
_POOLS: dict[str, tuple] = {}
KEPT.append(_POOLS)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


def _pool(model: str) -> tuple[Pool, np.ndarray]:
    if model not in _POOLS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        _POOLS[model] = Pool(lambda words: flat(sp.encode(words, num_threads=1)), 400_000), np.array([sp.is_byte(i) for i in range(sp.vocab_size())])
    return _POOLS[model]


def script(text: str) -> str:
    """The script of most letters."""
    letters = np.array([ord(c) for c in text if c.isalpha()], np.int64)
    if not len(letters):
        return "latin"
    kinds = np.searchsorted([a for a, _ in SCRIPTS], letters, "right") - 1
    return SCRIPTS[int(np.bincount(np.maximum(kinds, 0)).argmax())][1]


def repeat_words(slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a five-word window found twice or more in it; slots: an integer for each word."""
    docs, n = len(ends) - 1, len(slots)
    out = np.zeros(docs, np.int64)
    if n < 5:
        return out
    doc = np.repeat(np.arange(docs), np.diff(ends))
    x = (slots.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)  # a splitmix64 multiplier
    x ^= x >> np.uint64(29)
    h = np.zeros(n - 4, np.uint64)
    for k in range(5):
        h = h * np.uint64(0x100000001B3) + x[k : n - 4 + k]  # the FNV prime
    inside = doc[: n - 4] == doc[4:]
    at = np.flatnonzero(inside)
    h = h[at] + doc[at].astype(np.uint64) * _MIX
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + 5, -1)
    np.add.at(out, doc[np.cumsum(marks[:-1]) > 0], 1)
    return out


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def measure(texts: list[str], langs: list[str | None], model: str) -> dict:
    """Columns of SCHEMA but doc_id, for one batch."""
    pool, is_byte = _pool(model)
    words: list[str] = []
    ends = [0]
    for t in texts:
        words += WORD.findall(t)
        ends.append(len(words))
    slots, runs, ids = pool.at(words)
    end = np.array(ends)
    lens = runs[slots + 1] - runs[slots]
    tokens = np.diff(np.concatenate([[0], np.cumsum(lens)])[end])
    chars = np.diff(np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])[end])
    flat_bytes, entropy = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    step = max(1, len(texts) * 1_000_000 // max(1, int(tokens.sum())))
    for lo in range(0, len(texts), step):  # a million tokens at a time
        hi = min(lo + step, len(texts))
        a, b = end[lo], end[hi]
        pieces = ids[ragged(runs[slots[a:b]], lens[a:b])].astype(np.int64)
        doc = np.repeat(np.arange(lo, hi), tokens[lo:hi])
        flat_bytes[lo:hi] = np.bincount(doc - lo, is_byte[pieces], hi - lo).astype(np.int64)
        key = np.sort((doc - lo) * len(is_byte) + pieces)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count, of = np.diff(np.append(cut, len(key))), key[cut] // len(is_byte)
        n = np.maximum(tokens[lo:hi], 1)
        p = count / n[of]
        entropy[lo:hi] = np.bincount(of, -p * np.log2(p), hi - lo)
    n_words, repeats = np.diff(end), repeat_words(slots, end)
    symbols = np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64)
    dup = np.array([_dup_lines(t) for t in texts], np.int64)
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)
    full = np.maximum(tokens, 1)
    per_token, share = chars / full, flat_bytes / full
    band = np.array([BANDS[lang] if lang in BANDS else BANDS[script(t)] for t, lang in zip(texts, langs, strict=True)], float).reshape(-1, 3)
    kept = ~failed & (per_token >= band[:, 0] - SLACK / np.sqrt(full) - SHORT / full) & (share <= band[:, 1]) & ((entropy >= band[:, 2]) | (tokens < ENTROPY_TOKENS))
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats, "base_failed": failed, "kept": kept,
        "n_tokens": tokens, "chars_per_token": per_token, "byte_share": share, "token_entropy": entropy,
    }


def fertility(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns of SCHEMA, a row for each row of docs, from whole texts.

    Null and empty texts have no words and fail the base rules; null, unknown or absent
    languages are judged by script; repeated rows and null ids stay as they are; other columns
    are ignored; no rows in, no rows out.
    """
    small_batches(docs.sparkSession)
    lang = quoted(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))

    def run(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 4_000_000 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(lo, i + 1 - lo)} | measure(texts[lo : i + 1], langs[lo : i + 1], model))
                    lo, size = i + 1, 0

    return rows.mapInArrow(run, SCHEMA)


def keep_fertile(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that fertility() keeps; no shuffle, as each row is judged alone."""
    small_batches(docs.sparkSession)
    has_lang = lang_col in docs.columns

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            langs = b.column(lang_col).cast(pa.string()).to_pylist() if has_lang else [None] * len(texts)
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= 4_000_000 or i == len(texts) - 1:
                    yield b.slice(lo, i + 1 - lo).filter(pa.array(measure(texts[lo : i + 1], langs[lo : i + 1], model)["kept"]))
                    lo, size = i + 1, 0

    return docs.mapInArrow(run, docs.schema)
