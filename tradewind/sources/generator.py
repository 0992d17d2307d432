"""Seeded synthetic journeys: each session walks the stages until it drops out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stage and the chance of reaching it from the one before.
STAGES = [("product_viewed", 1.0), ("product_added_to_cart", 0.45), ("checkout_started", 0.6), ("order_created", 0.8), ("payment_completed", 0.9), ("order_shipped", 0.95), ("order_delivered", 0.92), ("order_refunded", 0.08)]


def journeys(spark: SparkSession, sessions: int, seed: int = 42, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """One row an event; all draws are hashes of (seed, session, stage), so any partitioning gives the same rows."""
    draw = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000)) / 1_000_000)
    s = spark.range(sessions).withColumnRenamed("id", "session")
    names, odds = F.array(*[F.lit(n) for n, _ in STAGES]), F.array(*[F.lit(p) for _, p in STAGES])
    step = F.explode(F.sequence(F.lit(0), F.lit(len(STAGES) - 1))).alias("stage")
    x = s.select("session", step).withColumn("passed", draw(F.col("session"), F.col("stage")) < F.get(odds, F.col("stage")))
    # a stage is reached if all before it and itself are passed
    reached = x.groupBy("session").agg(F.min(F.when(~F.col("passed"), F.col("stage"))).alias("stop"))
    r = reached.select("session", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("stop") - 1, F.lit(len(STAGES) - 1)))).alias("stage"))
    at = F.expr(f"timestamp '{start}'") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("session") % 40_000 + F.col("stage") * 30).cast("int"), F.lit(0))
    return r.select(F.concat(F.lit("ses_"), "session").alias("session_id"), F.concat(F.lit("evt_"), "session", F.lit("_"), "stage").alias("event_id"), F.get(names, F.col("stage")).alias("event_type"), at.alias("event_timestamp"), F.round(5 + 95 * draw(F.col("session"), F.lit("price")), 2).alias("unit_price"))
