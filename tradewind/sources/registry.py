"""Registries of businesses and sources as tables of JSON configs, checked row by row, and the state of connectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.core import errors
from tradewind.session import landed

BUSINESS = "business_id string, business_name string, status string, timezone string, reporting_timezone string, currency string, country string, enabled_sources array<string>"
SOURCE = "business_id string, source_id string, source_type string, schema_version string, ingestion_mode string, schedule string, credential_ref string, enabled boolean, metadata map<string, string>"
#: Fixed patterns of identifiers, environment references, cron fields and quarterly API versions.
IDENTIFIER, REFERENCE, CRON, QUARTER = "^[a-z0-9][a-z0-9_-]{2,63}$", "^[A-Z][A-Z0-9_]+$", r"^(\S+\s+){4}\S+$", "^20[0-9]{2}-(01|04|07|10)$"


def configs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object a file below folder; a file that isn't one fails the read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(folder)


def _off(c: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def business_issues(businesses: DataFrame, zones: Sequence[str]) -> DataFrame:
    """(business_id, source_id null, code) of each fault of a business; a business that stands twice is business_not_found, as no one config is its."""
    zone = lambda c: ~F.coalesce(F.col(c).isin(*zones), F.lit(False))
    codes = errors(
        (F.col("n") > 1, "business_not_found"),
        (_off("business_id", IDENTIFIER), "invalid_business_id"),
        (F.coalesce(F.trim("business_name"), F.lit("")).eqNullSafe("") | ~F.coalesce(F.col("status").isin("ACTIVE", "INACTIVE"), F.lit(False)), "invalid_business_metadata"),
        (zone("timezone") | zone("reporting_timezone"), "invalid_timezone"),
        (_off("currency", "^[A-Z]{3}$"), "invalid_currency"),
        (_off("country", "^[A-Z]{2}$"), "invalid_country"),
        (F.size("enabled_sources") > F.size(F.array_distinct("enabled_sources")), "duplicate_enabled_source"),
    )
    n = businesses.groupBy("business_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("business_id", "b")
    met = businesses.join(n, F.col("business_id").eqNullSafe(F.col("b")))
    return met.select("business_id", F.lit(None).cast("string").alias("source_id"), F.explode(codes).alias("code")).distinct()


def source_issues(businesses: DataFrame, sources: DataFrame, contracts: DataFrame) -> DataFrame:
    """(business_id, source_id, code) of each fault of a source, and of lists that name sources which aren't there.

    contracts: (source_type, schema_version) that are supported.
    """
    listed = businesses.select("business_id", F.explode_outer("enabled_sources").alias("source_id")).filter("source_id is not null").distinct()
    n = sources.groupBy("business_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    x = sources.join(n, ["business_id", "source_id"]).join(listed.withColumn("listed", F.lit(True)), ["business_id", "source_id"], "left")
    x = x.join(contracts.select("source_type", "schema_version").distinct().withColumn("agreed", F.lit(True)), ["source_type", "schema_version"], "left")
    x = x.join(contracts.select("source_type").distinct().withColumn("typed", F.lit(True)), "source_type", "left")
    on, listed_ = F.coalesce("enabled", F.lit(False)), F.col("listed").isNotNull()
    shop, meta = F.col("source_type") == "shopify", lambda k: F.coalesce(F.element_at("metadata", k), F.lit(""))
    admin = shop & (meta("adapter") == "admin_api")
    codes = errors(
        (F.col("n") > 1, "duplicate_source_id"),
        (F.col("typed").isNull(), "unsupported_source_type"),
        (on & ~listed_, "enabled_source_unlisted"),
        (~on & listed_, "listed_source_disabled"),
        (_off("source_id", IDENTIFIER), "invalid_source_id"),
        (~F.coalesce(F.col("ingestion_mode").isin("batch", "file"), F.lit(False)), "invalid_ingestion_mode"),
        (_off("schedule", CRON), "invalid_schedule"),
        (_off("credential_ref", REFERENCE), "missing_credential_ref"),
        (F.col("agreed").isNull(), "unsupported_schema_version"),
        (shop & ~meta("adapter").isin("", "mock", "admin_api"), "unsupported_adapter"),
        (admin & ~meta("shop_domain_ref").rlike(REFERENCE), "missing_shop_domain_ref"),
        (admin & ~meta("api_version").rlike(QUARTER), "invalid_shopify_api_version"),
        (admin & ~meta("backfill_start_ref").rlike(REFERENCE), "missing_backfill_start_ref"),
    )
    found = x.select("business_id", "source_id", F.explode(codes).alias("code")).distinct()
    missing = listed.join(sources.select("business_id", "source_id").distinct(), ["business_id", "source_id"], "left_anti")
    return found.unionByName(missing.select("business_id", "source_id", F.lit("enabled_source_missing").alias("code")))


def connector_state(runs: DataFrame) -> DataFrame:
    """One row (business_id, source_id) from the log of runs: last attempt and success, checkpoint, records of the last success, latest error, health.

    runs: (business_id, source_id, attempted_at, ok, checkpoint, records, error). A checkpoint never
    moves back; health is that of the last attempt, an error stays until a success follows it.
    """
    ok = F.coalesce("ok", F.lit(False))
    last = F.max(F.struct("attempted_at", ok.alias("ok"), "error"))
    good = F.max(F.when(ok, F.struct("attempted_at", "records")))
    return runs.groupBy("business_id", "source_id").agg(
        F.max("attempted_at").alias("last_attempted_at"),
        F.max(F.when(ok, F.col("attempted_at"))).alias("last_successful_at"),
        F.max(F.when(ok, F.col("checkpoint"))).alias("checkpoint"),
        F.coalesce(good["records"], F.lit(0)).alias("records_extracted"),
        F.when(~last["ok"], last["error"]).alias("latest_error"),
        F.when(last["ok"], "healthy").otherwise("failing").alias("health"),
    )


def jdbc_snapshot(spark: SparkSession, url: str, relation: str, schema: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database's table with an explicit schema, read in one repeatable snapshot a connection.

    key: a number to cut the read into parts ranges between low and high; without it one task
    reads with a cursor. The driver's class and password come as options.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", relation).option("customSchema", schema).option("isolationLevel", "REPEATABLE_READ").option("fetchsize", "10000")
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    return reader.options(**options).load()


def jdbc_at_once(spark: SparkSession, url: str, relation: str, schema: str, key: str, parts: int, hold: str | None = None, session: str | None = None, **options: str) -> DataFrame:
    """A database's table read by several connections as of one moment, and landed.

    One connection of the driver stays open over the whole read and makes it one snapshot:
    hold is a statement that it runs first, such as LOCK TABLE .. IN SHARE MODE, after which
    writers wait; or, where the database can share snapshots, hold is a query of its name and
    session a statement with {snapshot} in it that every reading connection runs first. The
    bounds of key (a number) come from the table by that connection; null keys are read too, in
    the first part. An empty table has no rows.
    """
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    held = jvm.java.sql.DriverManager.getConnection(url, options.get("user", ""), options.get("password", ""))
    try:
        held.setAutoCommit(False)
        held.setTransactionIsolation(4)  # java.sql.Connection.TRANSACTION_REPEATABLE_READ
        statement = held.createStatement()
        snapshot = ""
        if hold and statement.execute(hold):
            rows = statement.getResultSet()
            snapshot = rows.getString(1) if rows.next() else ""
        rows = statement.executeQuery(f"SELECT min({key}), max({key}) FROM {relation}")
        rows.next()
        low, high = rows.getObject(1), rows.getObject(2)
        if session:
            options["sessionInitStatement"] = session.format(snapshot=snapshot)
        reader = spark.read.format("jdbc").options(url=url, dbtable=relation, customSchema=schema, isolationLevel="REPEATABLE_READ", fetchsize="10000", **options)
        if low is not None and int(high) > int(low):
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(parts))
        return landed(reader.load(), "jdbc")
    finally:
        held.rollback()
        held.close()
