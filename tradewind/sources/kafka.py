"""Kafka as source and sink of the marketplace stream; the connector must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

TOPIC = "marketplace.events"


def read_stream(spark: SparkSession, servers: str, topic: str = TOPIC, starting: str = "earliest") -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def records(events: DataFrame, tenant: str = "business_id", customer: str = "customer_id") -> DataFrame:
    """(key, value): the event as JSON under tenant|customer, so that a customer's events stay in order."""
    key = F.when(F.col(tenant).isNull(), F.col(customer)).otherwise(F.concat_ws("|", F.col(tenant), F.col(customer)))
    return events.select(key.alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def write(events: DataFrame, servers: str, topic: str = TOPIC) -> None:
    records(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true").option("topic", topic).save()


def consume(stream: DataFrame, process, checkpoint: str) -> StreamingQuery:
    """At least once: each micro-batch is validated and processed, then its offsets are committed."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
