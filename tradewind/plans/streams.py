"""Streams over the events table as a file source: run to their end, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind.plans import marketplace as mk
from tradewind.plans.registry import query, table
from tradewind.sources import commerce
from tradewind.session import shared_folder
from tradewind.streaming import events as S


def _source(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # a stream's source is a folder: the table's own, or the one that holds it as a single file
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet")
    raw = reader.parquet(f"{sf_dir}/events.parquet" if folder else sf_dir)
    return raw.selectExpr(*commerce._select(commerce.EVENTS)).withColumn("kafka_offset", F.col("event_number")).withColumn("extracted_at", F.col("event_timestamp"))


def _land(spark, df, label: str):
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    S.write(df.withColumn("event_date", F.to_date("event_timestamp")), f"{base}/data", f"{base}/checkpoint", "event_date").awaitTermination()
    return spark.read.parquet(f"{base}/data")


@query(f"WITH {mk.CLASSIFIED_SQL} SELECT event_id, array_to_string(validation_errors, '|') AS codes FROM coded WHERE kafka_offset < 100000000")
def st_bronze(spark, sf_dir):
    df = mk.classify(_source(spark, sf_dir)).select("event_id", "event_timestamp", F.array_join("validation_errors", "|").alias("codes"))
    return _land(spark, df, "bronze").select("event_id", "codes")


@query(f"WITH {mk.CLASSIFIED_SQL} SELECT DISTINCT business_id, source_type, source_id, event_id FROM coded WHERE len(validation_errors) = 0 AND kafka_offset < 100000000")
def st_silver_dedup(spark, sf_dir):
    """A tenth of the stream arrives twice; each event stays once."""
    twice = _source(spark, sf_dir).withColumn("copy", F.explode(F.when(F.expr(commerce.REPLAY.replace("event_id", "event_number")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    good = mk.classify(twice).filter(F.size("validation_errors") == 0)
    return _land(spark, S.dedup(good.select(*mk.KEY, "event_timestamp")), "silver").select(*mk.KEY)
