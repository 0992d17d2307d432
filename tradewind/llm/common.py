"""Shared parts: scratch folders, written tables, Arrow mapping and exact cached tokenizers."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import shared_folder, ship

#: Characters that separate words in the contracts' word pattern.
WORD = re.compile(r"[^ \t-\r]+")
#: Unicode White_Space, fixed by the standard.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Rows of text that go to Python at a time.
BATCH_ROWS = 1024
#: Characters that an encoder handles at a time, so that long texts don't add up.
BATCH_CHARS = 2_000_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the application's shared folder, which goes when the application ends."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only; null text is empty, other columns can't clash."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(names: list[str], name: str) -> str:
    """A column name like name that isn't among names, whatever their case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds; workers find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema) -> DataFrame:
    """mapInArrow of a function from a batch to columns by name."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(b)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1 of all i, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Runs:
    """Keys with their runs of integers in one array: key k has ids[ends[slots[k]] : ends[slots[k] + 1]]."""

    __slots__ = ("slots", "ends", "ids", "chars")

    def __init__(self):
        self.slots: dict[str | int, int] = {}
        self.ends, self.ids, self.chars = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def add(self, keys: list, lens: np.ndarray, ids: np.ndarray) -> None:
        self.slots.update(zip(keys, range(len(self.ends) - 1, len(self.ends) - 1 + len(keys)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, ids])
        self.chars += sum(len(k) for k in keys if isinstance(k, str))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each run, all runs one after the other) of slots."""
        starts = self.ends[at]
        lens = self.ends[at + 1] - starts
        return lens, self.ids[ragged(starts, lens)]


class Pool:
    """Values of keys as runs of integers; make(keys) gives new keys' (lengths, runs), all those of a batch at once.

    Two generations bound it: when the young one is full (limit keys, or KEY_CHARS characters a
    key of it) it becomes the old one, and keys still in use come back from there without
    being made again.
    """

    KEY_CHARS = 24

    def __init__(self, make: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.make, self.limit, self.young, self.old = make, limit, Runs(), Runs()

    def at(self, keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of each key, ends of all runs, all runs)."""
        if len(self.young.slots) > self.limit or self.young.chars > self.limit * self.KEY_CHARS:
            self.young, self.old = Runs(), self.young
        young = self.young
        slots = np.fromiter(map(young.slots.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            lost = [keys[i] for i in missing.tolist()]
            self._fetch(list(dict.fromkeys(lost)))
            slots[missing] = np.fromiter(map(young.slots.__getitem__, lost), np.int64, len(lost))
        return slots, young.ends, young.ids

    def _fetch(self, keys: list) -> None:
        found = np.fromiter(map(self.old.slots.get, keys, repeat(-1)), np.int64, len(keys))
        if (found >= 0).any():
            self.young.add([k for k, f in zip(keys, found.tolist(), strict=True) if f >= 0], *self.old.take(found[found >= 0]))
            keys = [k for k, f in zip(keys, found.tolist(), strict=True) if f < 0]
        if keys:
            self.young.add(keys, *self.make(keys))

    def take(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(length of each key's run, all runs one after the other)."""
        at, _, _ = self.at(keys)
        return self.young.take(at)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all of them one after the other)."""
    return np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.int32)


def plain_pattern(pattern: str) -> str:
    """A pattern of Unicode classes for the re module; the same where no number is other than a decimal digit."""
    for a, b in (
        ("[^\\s\\p{L}\\p{N}]", f"(?:[^\\w{SPACE}]|_)"), ("[\\p{L}]", "[^\\W\\d_]"), ("[\\p{N}]", "\\d"), ("\\p{L}", "[^\\W\\d_]"), ("\\p{N}", "\\d"),
        ("(?!\\S)", f"(?![^{SPACE}])"), ("\\s", f"[{SPACE}]"),
    ):
        pattern = pattern.replace(a, b)
    # runs of common letters first, as a run of letters is a piece wherever it begins
    return f"{' ?' if ' ?[^' in pattern else ''}[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af]++(?![^\\W\\d_])|{pattern}"


def char_class(codes) -> str:
    """A pattern of one of the characters of some code points."""
    at = np.unique(np.fromiter(codes, np.int64))
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return "[" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs) + "]"


def odd_codes() -> Iterator[int]:
    """Code points on which the re module and a pattern of Unicode classes can part: numbers that aren't decimal digits, and those Python's tables don't know."""
    return (c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn"))


_ODD_LATIN = re.compile(char_class(c for c in range(0x80, 0x100) if unicodedata.category(chr(c)) in ("No", "Nl", "Cn")))


def strange_marks(normalizer) -> set[str]:
    """Marks that a library's normaliser, whose tables aren't Python's, orders or composes in another way."""
    out = set()
    for c in map(chr, range(0x300, 0x110000)):
        apart = f"a\u0345{c}" if 0 < unicodedata.combining(c) < 240 else unicodedata.normalize("NFD", c) if unicodedata.decomposition(c)[:1] not in ("", "<") else ""
        if apart and normalizer.normalize_str(apart) != unicodedata.normalize("NFC", apart).lower():
            out.add(apart[-1])
    return out


class Encoder:
    """Whole-text encoding by a vocabulary of the tokenizers library, exact, with a bounded cache.

    The vocabulary's pattern cuts a text into pieces that no merge crosses, so a piece's ids
    don't depend on its neighbours, and a process gives the library each piece once while it
    stays in the cache. Cutting is done by the re module where it equals the pattern. Literals
    in added (content: id) are cut out of the text before anything else, the longest first. A
    text with a character on which Python and the library can part goes whole to library, if
    that is given, else it is cut by the pattern itself.
    """

    def __init__(self, model, pattern: str, normalizer=None, limit: int = 400_000, added: dict[str, int] | None = None, library: Callable[[str], list[int]] | None = None):
        self.model, self.normalizer, self.added, self.library = model, normalizer, added or {}, library
        self.literals = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.odd = re.compile(char_class(chain(odd_codes(), map(ord, () if normalizer is None else strange_marks(normalizer))))).search
        self.full, self.plain = regex.compile(pattern).findall, re.compile(plain_pattern(pattern)).findall
        self.chars = byte_chars()
        self.pool = Pool(self.make, limit)

    def is_odd(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.odd(text) is not None
        return _ODD_LATIN.search(text) is not None

    def make(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; an integer is an added token's id."""
        tokenize, chars = self.model.tokenize, self.chars
        return flat([[p] if isinstance(p, int) else [t.id for t in tokenize(p.encode().decode("latin-1").translate(chars))] for p in pieces])

    def normal(self, text: str) -> str:
        if "\u03a3" in text:  # the library lower-cases sigma alike everywhere in a word
            return self.normalizer.normalize_str(text)
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def pieces(self, text: str) -> list[str | int]:
        odd = self.is_odd(text)
        if odd and self.library is not None:
            return self.library(text)
        if self.literals is None or not (found := list(self.literals.finditer(text))):
            return self.between(text, odd)
        out: list[str | int] = []
        at = 0
        for m in found:
            out += self.between(text[at : m.start()], odd)
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.between(text[at:], odd)

    def between(self, text: str, odd: bool) -> list[str]:
        if self.normalizer is not None:
            text = self.normal(text)
        return self.full(text) if odd else self.plain(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other)."""
        counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        group: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                n, ids = self._group(group)
                counts.append(n)
                parts.append(ids)
                group, size = [], 0
        return np.concatenate(counts), np.concatenate(parts)

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        keys: list[str | int] = []
        ends = [0]
        for t in texts:
            keys += self.pieces(t)
            ends.append(len(keys))
        lens, ids = self.pool.take(keys)
        total = np.concatenate([[0], np.cumsum(lens)])
        return np.diff(total[np.array(ends)]), ids


_ENCODERS: dict[tuple, Encoder] = {}
#: What a process keeps from one step to the next.
KEPT: list[dict] = [_ENCODERS]


def forget() -> None:
    """Drop the encoders and their caches of earlier steps: a worker goes on to steps that need the memory."""
    for held in KEPT:
        held.clear()


def json_encoder(path: str, added: bool = False) -> Encoder:
    """Encoder of a tokenizers JSON file; one per process and file.

    added: the file's added tokens in a text have their own ids, as the library has it unless
    encode_special_tokens is set; otherwise they are text like any other.
    """
    if (path, "json", added) not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        spec = json.load(open(path))
        pre = spec["pre_tokenizer"]
        tokens = spec["added_tokens"] if added else []
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in tokens):
            raise ValueError(f"{path}: added tokens that aren't plain literals")
        ids = {x["content"]: x["id"] for x in tokens}
        t.encode_special_tokens = not added
        library = lambda text: t.encode(text, add_special_tokens=False).ids
        if pre["type"] == "ByteLevel":
            import public_tokenizers

            e = Encoder(t.model, public_tokenizers.PATTERN, added=ids, library=library)
        else:
            e = Encoder(t.model, pre["pretokenizers"][0]["pattern"]["Regex"], t.normalizer, added=ids, library=library)
        _ENCODERS[path, "json", added] = e
    return _ENCODERS[path, "json", added]


def id_lists(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after each text's."""
    ends = np.cumsum(counts)
    return counts + 1, np.insert(ids, ends, end_id).astype(np.int32)
