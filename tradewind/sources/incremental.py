"""Incremental extracts from paged services as a stream: offsets are points in time, pages are read by tasks.

A service lists records by the time of their last change. A micro-batch is what changed from its
start to its end; it is cut into windows, each paged by a task of its own: outer cursors over
records, nested ones over the lists inside a record that go on beyond its first page. The
checkpoint keeps the end of the last batch, so a stopped query goes on there, and a batch that
died is read again between the same two points. A batch has `admit` windows at most; only the
first one after a restart has all that came meanwhile.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tradewind.sources.paged import Retryable

#: The service's points in time, in UTC; they sort like the times that they name.
FORMAT = "%Y-%m-%dT%H:%M:%S"


class Client(Protocol):
    """A service; it is sent to the tasks. Every call may raise Retryable, with the seconds that the service asks for."""

    def newest(self) -> str:
        """A point in time before which nothing changes any more."""

    def page(self, since: str, until: str, cursor: str | None) -> tuple[list[dict[str, Any]], str | None]:
        """Records changed in [since, until) and the cursor of the next page."""

    def nested(self, record: dict[str, Any], field: str, cursor: str) -> tuple[list[Any], str | None]:
        """The next items of a record's list and the cursor of those after them."""


class Window(InputPartition):
    def __init__(self, since: str, until: str):
        super().__init__((since, until))
        self.since, self.until = since, until


def patient(call: Callable[[], Any], tries: int = 6, base: float = 0.5, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What call gives; after a Retryable it is called again when the service asks for it, else after growing pauses."""
    for n in range(tries):
        try:
            return call()
        except Retryable as e:
            if n == tries - 1:
                raise
            sleep(min(longest, e.after if e.after is not None else base * 2**n))
    raise AssertionError


def records(client: Client, since: str, until: str, nested: dict[str, str]) -> Iterator[dict[str, Any]]:
    """Whole records of a window, a page at a time; nested: list field -> the field with its cursor."""
    cursor, seen = None, set()
    while True:
        rows, cursor = patient(lambda c=cursor: client.page(since, until, c))
        for r in rows:
            whole = dict(r)
            for field, at in nested.items():
                items, more = list(r.get(field) or []), r.get(at)
                known = set()
                while more is not None:
                    if more in known:
                        raise ValueError(f"cursor {more} of {field} came twice")
                    known.add(more)
                    further, more = patient(lambda f=field, m=more, x=r: client.nested(x, f, m))
                    items += further
                whole[field] = items
                whole.pop(at, None)
            yield whole
        if cursor is None:
            return
        if cursor in seen:
            raise ValueError(f"cursor {cursor} came twice")
        seen.add(cursor)


def source(name: str, client: Client, schema: str, start: str, step_minutes: int = 60, admit: int = 24, nested: dict[str, str] | None = None) -> type[DataSource]:
    """A data source of the client's records to be registered and read with readStream.format(name).

    start: the first point in time. A record that changes again comes again, as a revision of
    its own; a null in a field is null; a batch in which nothing changed has no rows.
    """
    lists = dict(nested or {})

    class Reader(DataSourceStreamReader):
        def __init__(self, fields: list[str]):
            self.fields, self.last = fields, None

        def initialOffset(self) -> dict:
            self.last = start
            return {"until": start}

        def latestOffset(self) -> dict:
            newest = patient(client.newest)
            if self.last is None:  # the first batch after a restart, whose start only Spark knows: all that there is
                return {"until": newest}
            most = _plus(self.last, step_minutes * admit)
            self.last = max(self.last, min(newest, most))
            return {"until": self.last}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.last = max(end["until"], self.last or end["until"])
            out, at = [], start["until"]
            while at < end["until"]:
                to = min(_plus(at, step_minutes), end["until"])
                out.append(Window(at, to))
                at = to
            return out

        def read(self, partition: Window) -> Iterator[Row]:
            for r in records(client, partition.since, partition.until, lists):
                yield tuple(r.get(f) for f in self.fields)

        def commit(self, end: dict) -> None:
            """Nothing to release: the service keeps its records."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Reader(schema.fieldNames())

    return Source


def _plus(at: str, minutes: int) -> str:
    return (dt.datetime.strptime(at, FORMAT) + dt.timedelta(minutes=minutes)).strftime(FORMAT)
