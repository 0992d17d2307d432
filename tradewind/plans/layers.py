"""Bronze and Silver in full: Kafka records to coded, routed rows, in batch and as streams.

The events table becomes Kafka records (key, JSON value, offset) with planted faults: cut-off
JSON, records without or with part of their identity, foreign keys, an unknown schema version.
Nothing is dropped: a record with codes is routed to the rejected side with all of them. Null
conditions don't hold, repeated records are coded alike, an empty topic gives empty sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.core import clean, errors
from tradewind.plans.marketplace import TYPES
from tradewind.plans.registry import query, table
from tradewind.session import landed, shared_folder
from tradewind.sources import commerce
from tradewind.streaming import events as S

SLUG, VERSION = "^[a-z0-9][a-z0-9_-]{2,63}$", "1"
IDENTITY = ["business_id", "source_type", "source_id", "schema_version"]
#: What records from before identities get.
LEGACY = {"business_id": "marketplace_default", "source_type": "marketplace", "source_id": "default", "schema_version": VERSION}
_OLD, _PART = "event_number % 7 = 3", "event_number % 113 = 5"
_HIDDEN = f"{_OLD} or {_PART}"
#: A record's fields, over the canonical events.
FIELDS = {
    "business_id": f"case when {_OLD} then null else business_id end",
    "source_type": f"case when {_HIDDEN} then null else source_type end",
    "source_id": f"case when {_HIDDEN} then null else source_id end",
    "schema_version": f"case when {_HIDDEN} then null when event_number % 53 = 0 then '9' else '{VERSION}' end",
    "event_id": "case when event_number % 401 = 0 then null else event_id end",
    "event_type": "case when event_number % 61 = 0 then null else event_type end",
    "event_timestamp": "case when event_number % 211 = 7 then 'some day' else cast(event_timestamp as string) end",
    "customer_id": "customer_id",
    "session_id": "session_id",
    "country": "country",
    "currency": "currency",
    "quantity": "cast(quantity as int)",
    "unit_price": "unit_price",
    "event_amount": "case when event_number % 127 = 0 then -1.0 else event_amount end",
    "is_active": "case when event_number % 29 = 0 then false when event_number % 3 = 0 then null else true end",
    "reporting_date": "case when event_number % 2 = 0 then cast(cast(event_timestamp as date) - interval 1 day as date) else null end",
}
_KEY = f"case when event_number % 59 = 0 then 'other' when event_number % 307 = 0 then null when {_OLD} then customer_id when {_PART} then concat_ws('|', business_id, customer_id) else concat_ws('|', business_id, customer_id) end"
_CUT = "event_number % 131 = 0"
SCHEMA = "business_id string, source_type string, source_id string, schema_version string, event_id string, event_type string, event_timestamp string, customer_id string, session_id string, country string, currency string, quantity int, unit_price double, event_amount double, is_active boolean, reporting_date date"


def to_kafka(raw: DataFrame) -> DataFrame:
    """Canonical events as what a Kafka source gives."""
    record = F.to_json(F.struct(*[F.expr(e).alias(c) for c, e in FIELDS.items()]))
    return raw.select(
        F.expr(_KEY).cast("binary").alias("key"),
        F.when(F.expr(_CUT), F.left(record, F.lit(25))).otherwise(record).cast("binary").alias("value"),
        F.lit("events").alias("topic"),
        (F.col("event_number") % 3).cast("int").alias("partition"),
        F.col("event_number").alias("offset"),
        F.col("event_timestamp").cast("timestamp").alias("timestamp"),
    )


def bronze(kafka: DataFrame) -> DataFrame:
    """Decoded records with bronze_errors (malformed_json alone, or all codes in order), defaults for legacy ones, and the ingestion's time and date."""
    x = S.decode(kafka, SCHEMA)
    n = sum((F.col(c).isNotNull().cast("int") for c in IDENTITY), F.lit(0))
    x = x.withColumn("legacy", n == 0).withColumn("partial_identity", (n > 0) & (n < 4))
    expected = F.when(F.col("legacy"), F.col("customer_id")).otherwise(F.concat_ws("|", "business_id", "customer_id"))
    bad = lambda c: ~F.col("legacy") & ~F.col(c).rlike(SLUG)
    codes = errors(
        (F.col("event_id").isNull(), "missing_event_id"),
        (F.col("event_type").isNull(), "missing_event_type"),
        (F.expr("try_cast(event_timestamp as timestamp_ntz) is null"), "missing_event_timestamp"),
        (F.col("customer_id").isNull(), "missing_customer_id"),
        (F.col("kafka_key").isNull() | (F.col("customer_id").isNotNull() & (F.col("kafka_key") != expected)), "kafka_key_customer_id_mismatch"),
        (F.col("partial_identity"), "partial_source_identity"),
        (bad("business_id"), "invalid_business_id"),
        (bad("source_type"), "invalid_source_type"),
        (bad("source_id"), "invalid_source_id"),
        (~F.col("legacy") & (F.col("schema_version") != VERSION), "unsupported_schema_version"),
    )
    x = x.withColumn("bronze_errors", F.when(F.col("malformed"), F.array(F.lit("malformed_json"))).otherwise(codes))
    x = x.withColumns({c: F.when(F.col("legacy"), F.lit(v)).otherwise(F.col(c)) for c, v in LEGACY.items()})
    return x.withColumn("event_timestamp", F.expr("try_cast(event_timestamp as timestamp_ntz)")).withColumn("ingested_at", F.current_timestamp()).withColumn("ingestion_date", F.to_date("ingested_at"))


def split(df: DataFrame, codes: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of one plan."""
    return df.filter(F.size(codes) == 0), df.filter(F.size(codes) > 0)


def event_date() -> Column:
    """A shop's reporting date where there is one, else the day of the event."""
    return F.when((F.col("source_type") == "shopify") & F.col("reporting_date").isNotNull(), F.col("reporting_date")).otherwise(F.to_date("event_timestamp"))


def silver(valid: DataFrame) -> DataFrame:
    """Normalised records with silver_errors: all codes that hold, in order."""
    lower, upper = ["business_id", "source_type", "source_id", "event_type"], ["country", "currency"]
    x = valid.withColumns({**{c: clean(c, "lower") for c in lower}, **{c: clean(c, "upper") for c in upper}, **{c: clean(c) for c in ("event_id", "customer_id", "session_id", "schema_version")}})
    x = x.withColumn("is_active", F.coalesce("is_active", F.lit(True))).withColumn("event_date", event_date())
    shop = F.col("source_type") == "shopify"
    odd = lambda c, pattern: ~F.col(c).rlike(pattern)
    codes = errors(
        (F.col("partial_identity"), "partial_source_identity"),
        (odd("business_id", SLUG), "invalid_business_id"),
        (odd("source_type", SLUG), "invalid_source_type"),
        (odd("source_id", SLUG), "invalid_source_id"),
        (F.col("schema_version") != VERSION, "unsupported_schema_version"),
        (F.col("event_id").isNull(), "missing_event_id"),
        (~shop & F.col("customer_id").isNull(), "missing_customer_id"),
        (~shop & F.col("session_id").isNull(), "missing_session_id"),
        (F.col("event_timestamp").isNull(), "invalid_event_timestamp"),
        (~F.col("event_type").isin(TYPES), "unsupported_event_type"),
        (F.col("quantity") <= 0, "invalid_quantity"),
        (F.col("unit_price") < 0, "invalid_unit_price"),
        (F.col("event_amount") < 0, "invalid_event_amount"),
        (odd("country", "^[A-Z]{2}$"), "invalid_country_code"),
        (odd("currency", "^[A-Z]{3}$"), "invalid_currency_code"),
    )
    return x.withColumn("silver_errors", codes)


def active(df: DataFrame) -> DataFrame:
    """Rows that are in force; unsaid counts as active."""
    return df.filter(F.coalesce("is_active", F.lit(True)))


def _records(spark, sf_dir) -> DataFrame:
    return to_kafka(table(spark, sf_dir, "events").selectExpr(*commerce._select(commerce.EVENTS)))


def _bronze(spark, sf_dir) -> DataFrame:
    """Bronze as files with its codes; one plan from records to Gold would nest every code in every default."""
    return landed(bronze(_records(spark, sf_dir)), "bronze")


def _slug_sql(c: str) -> str:
    return f"regexp_matches({c}, '{SLUG}')"


def _sql_codes(*pairs: tuple[str, str]) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN {cond} THEN '{code}' END''' for cond, code in pairs)}], lambda x: x IS NOT NULL)"


_BRONZE_CODES = _sql_codes(
    ("event_id IS NULL", "missing_event_id"), ("event_type IS NULL", "missing_event_type"), ("try_cast(event_timestamp AS TIMESTAMP) IS NULL", "missing_event_timestamp"), ("customer_id IS NULL", "missing_customer_id"),
    ("kafka_key IS NULL OR (customer_id IS NOT NULL AND kafka_key <> CASE WHEN legacy THEN customer_id ELSE concat_ws('|', business_id, customer_id) END)", "kafka_key_customer_id_mismatch"),
    ("partial_identity", "partial_source_identity"), *[(f"NOT legacy AND NOT {_slug_sql(c)}", f"invalid_{c}") for c in IDENTITY[:3]], (f"NOT legacy AND schema_version <> '{VERSION}'", "unsupported_schema_version"),
)
_SILVER_CODES = _sql_codes(
    ("partial_identity", "partial_source_identity"), *[(f"NOT {_slug_sql(c)}", f"invalid_{c}") for c in IDENTITY[:3]], (f"schema_version <> '{VERSION}'", "unsupported_schema_version"),
    ("event_id IS NULL", "missing_event_id"), ("source_type <> 'shopify' AND customer_id IS NULL", "missing_customer_id"), ("source_type <> 'shopify' AND session_id IS NULL", "missing_session_id"),
    ("event_timestamp IS NULL", "invalid_event_timestamp"), (f"event_type NOT IN ({', '.join(repr(t) for t in TYPES)})", "unsupported_event_type"), ("quantity <= 0", "invalid_quantity"),
    ("unit_price < 0", "invalid_unit_price"), ("event_amount < 0", "invalid_event_amount"), ("NOT regexp_matches(country, '^[A-Z]{2}$')", "invalid_country_code"), ("NOT regexp_matches(currency, '^[A-Z]{3}$')", "invalid_currency_code"),
)
_CLEAN = ", ".join(
    [f"lower(nullif(trim({c}), '')) AS {c}" for c in ("business_id", "source_type", "source_id", "event_type")] + [f"upper(nullif(trim({c}), '')) AS {c}" for c in ("country", "currency")]
    + [f"nullif(trim({c}), '') AS {c}" for c in ("event_id", "customer_id", "session_id")]
)
LAYERS_SQL = f"""canonical AS ({commerce._sql(commerce.EVENTS, "events")}),
fields AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FIELDS.items())}, {_KEY} AS kafka_key, event_number AS kafka_offset, {_CUT} AS malformed FROM canonical),
known AS (SELECT *, {' + '.join(f'({c} IS NOT NULL)::INT' for c in IDENTITY)} AS n FROM fields),
marked AS (SELECT *, n = 0 AS legacy, n > 0 AND n < 4 AS partial_identity FROM known),
bronze AS (SELECT * REPLACE ({', '.join(f"CASE WHEN legacy THEN '{v}' ELSE {c} END AS {c}" for c, v in LEGACY.items())}, try_cast(event_timestamp AS TIMESTAMP) AS event_timestamp), CASE WHEN malformed THEN ['malformed_json'] ELSE {_BRONZE_CODES} END AS bronze_errors FROM marked),
normal AS (SELECT * REPLACE ({_CLEAN}, coalesce(is_active, true) AS is_active) FROM bronze WHERE len(bronze_errors) = 0),
silver AS (SELECT *, CASE WHEN source_type = 'shopify' AND reporting_date IS NOT NULL THEN reporting_date ELSE CAST(event_timestamp AS DATE) END AS event_date, {_SILVER_CODES} AS silver_errors FROM normal)"""


@query(f"WITH {LAYERS_SQL} SELECT code, count(*) AS records FROM (SELECT unnest(bronze_errors) AS code FROM bronze) GROUP BY 1")
def brz_codes(spark, sf_dir):
    return _bronze(spark, sf_dir).select(F.explode("bronze_errors").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {LAYERS_SQL} SELECT kafka_offset, array_to_string(bronze_errors, '|') AS codes, true AS stamped FROM bronze WHERE len(bronze_errors) > 0")
def brz_rejected(spark, sf_dir):
    rejected = split(_bronze(spark, sf_dir), "bronze_errors")[1]
    return rejected.select("kafka_offset", F.array_join("bronze_errors", "|").alias("codes"), (F.col("ingestion_date") == F.to_date("ingested_at")).alias("stamped"))


@query(f"WITH {LAYERS_SQL} SELECT kafka_offset, business_id, source_type, source_id, schema_version, event_id, legacy, event_timestamp FROM bronze WHERE len(bronze_errors) = 0")
def brz_valid(spark, sf_dir):
    return split(_bronze(spark, sf_dir), "bronze_errors")[0].select("kafka_offset", *IDENTITY, "event_id", "legacy", "event_timestamp")


def _silver(spark, sf_dir) -> DataFrame:
    return landed(silver(split(_bronze(spark, sf_dir), "bronze_errors")[0]), "silver")


@query(f"WITH {LAYERS_SQL} SELECT kafka_offset, array_to_string(silver_errors, '|') AS codes FROM silver WHERE len(silver_errors) > 0")
def slv_rejected(spark, sf_dir):
    return split(_silver(spark, sf_dir), "silver_errors")[1].select("kafka_offset", F.array_join("silver_errors", "|").alias("codes"))


@query(f"WITH {LAYERS_SQL} SELECT kafka_offset, business_id, source_type, event_id, event_type, country, currency, is_active, event_date FROM silver WHERE len(silver_errors) = 0")
def slv_valid(spark, sf_dir):
    return split(_silver(spark, sf_dir), "silver_errors")[0].select("kafka_offset", "business_id", "source_type", "event_id", "event_type", "country", "currency", "is_active", "event_date")


@query(f"WITH {LAYERS_SQL} SELECT business_id, event_date, count(*) AS events, count(DISTINCT customer_id) AS customers FROM silver WHERE len(silver_errors) = 0 AND is_active GROUP BY 1, 2")
def slv_active_daily(spark, sf_dir):
    rows = active(split(_silver(spark, sf_dir), "silver_errors")[0])
    return rows.groupBy("business_id", "event_date").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("customer_id").alias("customers"))


def stream_source(spark, sf_dir) -> DataFrame:
    """The events table as a stream of canonical rows."""
    schema = table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # a stream's source is a folder: the table's own, or the one that holds it as a single file
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet")
    return reader.parquet(f"{sf_dir}/events.parquet" if folder else sf_dir).selectExpr(*commerce._select(commerce.EVENTS))


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def run_layer(spark, valid: DataFrame, rejected: DataFrame, base: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Two queries with a checkpoint each below base, valid and rejected, run to the end of their source; what they have written so far."""
    running = [S.write(df, f"{base}/{side}/data", f"{base}/{side}/checkpoint", by) for side, df in (("valid", valid), ("rejected", rejected))]
    for q in running:
        q.awaitTermination()
    return spark.read.schema(valid.schema).parquet(f"{base}/valid/data"), spark.read.schema(rejected.schema).parquet(f"{base}/rejected/data")


@query(f"WITH {LAYERS_SQL} SELECT kafka_offset, CASE WHEN len(bronze_errors) = 0 THEN 'valid' ELSE 'rejected' END AS side, array_to_string(bronze_errors, '|') AS codes FROM bronze")
def st_bronze_sides(spark, sf_dir):
    rows = bronze(to_kafka(stream_source(spark, sf_dir))).select("kafka_offset", "ingestion_date", "bronze_errors")
    good, bad = run_layer(spark, *split(rows, "bronze_errors"), _folder(spark, "bronze-sides"), "ingestion_date")
    side = lambda df, name: df.select("kafka_offset", F.lit(name).alias("side"), F.array_join("bronze_errors", "|").alias("codes"))
    return side(good, "valid").unionByName(side(bad, "rejected"))


@query(f"""WITH {LAYERS_SQL} SELECT 'valid' AS side, business_id, source_type, source_id, event_id, 1 AS copies FROM silver WHERE len(silver_errors) = 0
UNION ALL SELECT 'rejected', business_id, source_type, source_id, event_id, CASE WHEN kafka_offset % 10 = 0 THEN 2 ELSE 1 END FROM silver WHERE len(silver_errors) > 0""")
def st_silver_sides(spark, sf_dir):
    """A tenth of the stream arrives twice: the valid side keeps each event once, the rejected side is stateless and keeps both."""
    twice = stream_source(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_number") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = silver(split(bronze(to_kafka(twice)), "bronze_errors")[0]).select(*S.KEY, "event_timestamp", "event_date", "silver_errors")
    good, bad = split(rows, "silver_errors")
    good, bad = run_layer(spark, S.dedup(good), bad, _folder(spark, "silver-sides"), "event_date")
    side = lambda df, name: df.groupBy(*S.KEY).agg(F.count(F.lit(1)).cast("int").alias("copies")).select(F.lit(name).alias("side"), *S.KEY, "copies")
    return side(good, "valid").unionByName(side(bad, "rejected"))


KAFKA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def run_chain(spark, inbox: str, base: str, horizon: str = "7 days") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) Silver so far: Bronze as a stream over the records in inbox, Silver as one over the files that Bronze has committed.

    Every call goes on where the last one stopped: each of the four queries keeps its checkpoint
    below base, and the file sink's log says which of Bronze's files count, so a stop between
    or inside layers loses and repeats nothing. The valid side keeps each event once: a repeat
    within horizon of the newest event meets its key in the state; whatever is older than that,
    a repeat or not, is dropped. The rejected side has no state and keeps repeats.
    """
    raw = spark.readStream.schema(KAFKA).parquet(inbox)
    run_layer(spark, *split(bronze(raw), "bronze_errors"), f"{base}/bronze", "ingestion_date")
    whole = bronze(spark.createDataFrame([], KAFKA)).schema
    landed_ = spark.readStream.schema(whole).parquet(f"{base}/bronze/valid/data")
    good, bad = split(silver(landed_), "silver_errors")
    return run_layer(spark, S.dedup(good, horizon), bad, f"{base}/silver", "event_date")


_CUT_DAY = "2024-01-20"


@query(f"""WITH {LAYERS_SQL}, good AS (SELECT *, kafka_offset % 10 = 0 AND kafka_offset % 17 <> 0 AND event_timestamp < TIMESTAMP '{_CUT_DAY}' AS again, kafka_offset % 17 <> 0 AND event_timestamp < TIMESTAMP '{_CUT_DAY}' AS early FROM silver),
mark AS (SELECT max(event_timestamp) - INTERVAL 7 DAY AS m FROM good WHERE early AND len(silver_errors) = 0)
SELECT 'valid' AS side, business_id, source_type, source_id, event_id, 1 AS copies FROM good, mark WHERE len(silver_errors) = 0 AND (early OR event_timestamp >= m)
UNION ALL SELECT 'rejected', business_id, source_type, source_id, event_id, CASE WHEN again THEN 2 ELSE 1 END FROM good WHERE len(silver_errors) > 0""")
def st_chained_layers(spark, sf_dir):
    """Two arrivals with a stop between: the second has later events, a tenth of the first's again, and early ones that come only now."""
    base = _folder(spark, "chained")
    records = landed(_records(spark, sf_dir), "kafka-records")
    before, held = F.col("timestamp") < F.lit(_CUT_DAY).cast("timestamp"), F.col("offset") % 17 == 0
    records.filter(before & ~held).write.parquet(f"{base}/inbox")
    run_chain(spark, f"{base}/inbox", f"{base}/layers")
    records.filter(~before | held | (F.col("offset") % 10 == 0)).write.mode("append").parquet(f"{base}/inbox")
    good, bad = run_chain(spark, f"{base}/inbox", f"{base}/layers")
    side = lambda df, name: df.groupBy(*S.KEY).agg(F.count(F.lit(1)).cast("int").alias("copies")).select(F.lit(name).alias("side"), *S.KEY, "copies")
    return side(good, "valid").unionByName(side(bad, "rejected"))
