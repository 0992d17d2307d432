"""Cursor-paged service extracts as DataFrames, with retries; the transport is a function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


class Retryable(Exception):
    """A failure worth another try; after: seconds the service asks for."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def pages(fetch: Callable[[str | None], dict], tries: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """The rows of each page; fetch(cursor) gives {rows, next}. Exponential pauses, or what the service asks for."""
    cursor = None
    while True:
        for n in range(tries):
            try:
                page = fetch(cursor)
                break
            except Retryable as e:
                if n == tries - 1:
                    raise
                sleep(e.after if e.after is not None else base * 2**n)
        yield page["rows"]
        cursor = page.get("next")
        if cursor is None:
            return


def extract(spark: SparkSession, shards: list[str], fetch: Callable[[str, str | None], dict], schema: str, updated: str | None = None, boundary: str | None = None) -> DataFrame:
    """Rows of all shards (say one a store or day), each paged by its own task; from boundary on, if given."""

    def read(batches):
        import pandas as pd

        for b in batches:
            for shard in b["shard"]:
                for rows in pages(lambda cursor, s=shard: fetch(s, cursor)):
                    kept = [r for r in rows if boundary is None or r[updated] >= boundary]
                    if kept:
                        yield pd.DataFrame(kept)

    return spark.createDataFrame([(s,) for s in shards], "shard string").repartition(max(1, len(shards))).mapInPandas(read, schema)
