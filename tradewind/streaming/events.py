"""Bronze and Silver as Structured Streaming; the classifiers are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

KEY = ["business_id", "source_type", "source_id", "event_id"]


def decode(kafka: DataFrame, schema: str) -> DataFrame:
    """Kafka records (or a source of the same columns) as parsed JSON with their lineage; malformed JSON is kept as such."""
    raw = kafka.select(F.col("key").cast("string").alias("kafka_key"), F.col("value").cast("string").alias("raw_json"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"))
    parsed = F.from_json("raw_json", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # generated, so that a later filter on what follows from the fields isn't moved before them with a parse for each use
    return raw.select("*", F.inline(F.array(parsed))).withColumn("malformed", F.col("raw_json").isNull() | F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def dedup(events: DataFrame, horizon: str = "7 days", time: str = "event_timestamp") -> DataFrame:
    """The first event of each key within the watermark; state is bounded by horizon, later repeats may pass."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark(KEY)


def write(events: DataFrame, path: str, checkpoint: str, by: str, continuous: str | None = None) -> StreamingQuery:
    """Append as Parquet by a date column; continuous: a trigger interval, else all that is there and stop."""
    w = events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy(by)
    return (w.trigger(processingTime=continuous) if continuous else w.trigger(availableNow=True)).start()
