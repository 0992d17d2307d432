"""Token ids in ORC: run-length encoded integers in stripes, row indexes, Bloom filters on document ids.

Files hold documents in ascending order of id (a range partition each), so a file's and a
stripe's statistics on doc_id bound an interval and readers skip the rest; the Bloom filter
settles point lookups inside it. Spark reads an ORC file stripe-parallel: a task takes the
stripes that begin in its split.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import id_lists, json_encoder, map_arrow, narrow, small_batches

SCHEMA = "doc_id long, shard int, ids_before long, n_tokens long, ids array<int>"
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(64 << 20)}


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> None:
    """Encode whole texts (null: empty), append end_id to each, write ORC files in ascending order of id.

    Null ids come first; rows that repeat an id stay, ordered by text. Other columns of docs
    are ignored; an empty table gives a folder without rows. A file's rows carry its shard
    number (files ascend with it) and the ids before them in the file. added: see json_encoder.
    """
    small_batches(docs.sparkSession)
    ordered = narrow(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        shard, before, encoder = TaskContext.get().partitionId(), 0, json_encoder(vocabulary, added)
        for b in batches:
            if not b.num_rows:
                continue
            counts, ids = id_lists(*encoder.encode(b.column("text").to_pylist()), end_id)
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "shard": pa.array(np.full(b.num_rows, shard, np.int32)), "ids_before": before + ends[:-1],
                "n_tokens": counts, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
            })
            before += int(ends[-1])

    ordered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; a filter on doc_id prunes stripes and row groups by statistics and Bloom filters."""
    return spark.read.schema(T._parse_datatype_string(SCHEMA)).option("mergeSchema", "false").orc(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids in all files before each; a row a file."""
    totals = read_token_ids(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) from the files; ids are summed up where they are read."""

    def f(b: pa.RecordBatch) -> dict:
        ids = b.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        return {
            "doc_id": b.column("doc_id"), "shard": b.column("shard"), "ids_before": b.column("ids_before"), "n_tokens": b.column("n_tokens"),
            "ids_crc32": pa.array([zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.int64()),
        }

    rows = map_arrow(read_token_ids(spark, path), f, "doc_id long, shard int, ids_before long, n_tokens long, ids_crc32 long")
    return rows.join(positions(spark, path), "shard").select("doc_id", (F.col("shard_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "shard")
