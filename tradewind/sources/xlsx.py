"""XLSX as a Spark data source, by the zip and XML formats alone.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx").option("path", ...).load()

Rows come as (sheet, row_number, cells): a cell has its text and how it was stored, so long
identifiers never pass through a float. One partition a worksheet.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Namespaces of the public format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_KIND = {"s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error", "d": "date"}


def _open(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    where_fs, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with where_fs.open_input_file(where) as f:
        return zipfile.ZipFile(io.BytesIO(f.read()))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the worksheets in order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + links[s.get(_REL)].lstrip("/").removeprefix("xl/")) for s in book.iter(f"{_MAIN}sheet")]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def rows(z: zipfile.ZipFile, name: str, file: str) -> Iterator[tuple]:
    """Rows of a worksheet, read as a stream; blank cells between others are told as blank."""
    strings = shared_strings(z)
    with z.open(file) as f:
        for _, row in ET.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[tuple[str | None, str]] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [(None, "blank")] * (at - len(cells))
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    cells.append((None, "blank"))
                    continue
                else:
                    text = strings[int(v.text)] if kind == "s" else v.text
                cells.append((text, _KIND.get(kind, "numeric")))
            yield (name, int(row.get("r") or 0), cells)
            row.clear()


class _Sheet(InputPartition):
    def __init__(self, name: str, file: str):
        self.name, self.file = name, file


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as z:
            return [_Sheet(*s) for s in sheets(z)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with _open(self.path) as z:
            yield from rows(z, partition.name, partition.file)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row_number int, cells array<struct<value string, storage string>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
