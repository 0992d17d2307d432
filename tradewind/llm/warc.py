"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records.
After the frames come two skippable frames, which any Zstandard reader passes over: the
record index (record identifier, frame, offset and length in the unpacked frame), and the
seek table of the public seekable format (packed and unpacked size of each frame). A reader
fetches the footer, then only the frame that holds the record it wants.

Tasks write bundles under names of their own and report them; only reported bundles are in
the manifest, so what a lost attempt left is never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import map_arrow, quoted, scratch, small_batches, stash

#: Payloads below so many bytes are always responses.
LEAST_REVISIT = 100
#: Unpacked bytes after which a frame, and packed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 128 << 20
#: Fixed values of the public formats.
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "bundle string, n_frames int, n_records long, packed_bytes long, unpacked_bytes long"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(identifier: str) -> int | None:
    name = identifier.rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """(header, start and end of the block) of the record at a position."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return header, stop + 4, stop + 4 + int(header["content-length"])


class BundleWriter:
    def __init__(self, base: str):
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.fs, where = fs.FileSystem.from_uri(self.path)
        self.out = self.fs.open_output_stream(where, compression=None)  # by default the name decides
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.packed = 0

    def add(self, identifier: str, data: bytes) -> None:
        self.index.append((identifier, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.packed += len(frame)
            self.held, self.size = [], 0

    def close(self) -> dict:
        self.flush()
        index = self.packer.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<I", len(self.frames)) + b"\0" + struct.pack("<I", SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return {"bundle": self.path, "n_frames": len(self.frames), "n_records": len(self.index), "packed_bytes": self.packed, "unpacked_bytes": sum(x[1] for x in self.frames)}


class BundleReader:
    """Random access to a bundle by its footer."""

    def __init__(self, path: str):
        where_fs, where = fs.FileSystem.from_uri(path)
        self.file = where_fs.open_input_file(where)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self._at(end - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, unpacked = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, unpacked))
            at += packed
        self.index_at, self.unpacker = at, zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def index(self) -> list[list]:
        """[record identifier, frame, offset, length] of all records."""
        _, n = struct.unpack("<II", self._at(self.index_at, 8))
        return json.loads(self.unpacker.decompress(self._at(self.index_at + 8, n)))

    def frame(self, k: int) -> bytes:
        at, packed, unpacked = self.frames[k]
        return self.unpacker.decompress(self._at(at, packed), max_output_size=unpacked)

    def record(self, identifier: str) -> bytes | None:
        """A record by identifier: reads the footer and one frame."""
        for name, k, at, n in self.index():
            if name == identifier:
                return self.frame(k)[at : at + n]
        return None


def write_warc(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages under the folder base; the manifest, a row for each bundle.

    Payload: the html in UTF-8, null counts as empty. Of equal payloads of LEAST_REVISIT bytes
    or more the smallest id is a response and the others revisit it; rows that repeat an id are
    the same page and get the same type; a null id is a response only if no equal payload has
    an id. Null urls become about:blank. Other columns are ignored; an empty table gives an
    empty manifest.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    light = stash(rows.select("page_id", "digest", "size").distinct(), "payloads")
    # written, so that the join deals both sides anew and Spark can split a payload that very many pages share
    groups = stash(light.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-payloads")
    revisits = light.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    dealt = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "digest", F.col("r_digest").isNotNull().alias("revisit"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "first", "revisit")]
            for page_id, url, html, digest, first, revisit in zip(*cols, strict=True):
                w = w or BundleWriter(base)
                w.add(record_id(page_id), record(page_id, url, html.encode(), digest, first, revisit))
                if w.packed >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist([w.close()], pa.schema([("bundle", pa.string()), ("n_frames", pa.int32()), ("n_records", pa.int64()), ("packed_bytes", pa.int64()), ("unpacked_bytes", pa.int64())]))
                    w = None
        if w:
            yield pa.RecordBatch.from_pylist([w.close()], pa.schema([("bundle", pa.string()), ("n_frames", pa.int32()), ("n_records", pa.int64()), ("packed_bytes", pa.int64()), ("unpacked_bytes", pa.int64())]))

    _make_folder(base)
    return stash(dealt.mapInArrow(write, MANIFEST), "warc-manifest")


def _make_folder(base: str) -> None:
    where_fs, where = fs.FileSystem.from_uri(base)
    where_fs.create_dir(where, recursive=True)


#: Frames that a reading task takes at a time.
READ_FRAMES = 32


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset, record_bytes) of all records.

    A task seeks to its own run of frames, unpacks them one after the other and checks each
    response's payload against its digest. There are as many tasks as runs of READ_FRAMES.
    """
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_frames") / READ_FRAMES))).first()[0]
    runs = manifest.select("bundle", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames") - 1, F.lit(0)), F.lit(READ_FRAMES))).alias("first"))
    runs = runs.repartition(max(1, tasks or 0), "bundle", "first")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset", "record_bytes")}
        for path, first in zip(b.column("bundle").to_pylist(), b.column("first").to_pylist(), strict=True):
            reader = BundleReader(path)
            for k in range(first, min(first + READ_FRAMES, len(reader.frames))):
                data, at = reader.frame(k), 0
                while at < len(data):
                    header, start, end = parse(data, at)
                    body = data.index(b"\r\n\r\n", start) + 4
                    digest = header["warc-payload-digest"].partition(":")[2]
                    n = int(re.search(rb"Content-Length: (\d+)", data[start:body])[1])
                    if header["warc-type"] == "response":
                        payload = data[body:end]
                        n, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"{path}, frame {k}: the payload of {header['warc-record-id']} is damaged")
                    refers = header.get("warc-refers-to")
                    for name, v in zip(out, (page_of(header["warc-record-id"][1:-1]), n, digest, header["warc-type"], page_of(refers[1:-1]) if refers else None, path, k, at, end + 4 - at), strict=True):
                        out[name].append(v)
                    at = end + 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_pydict({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    return map_arrow(runs, f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long, record_bytes long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to new bundles in the shared folder and read them back."""
    return read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), id_col, url_col, html_col))
