"""Operators on small rows whose results are known."""

import datetime as dt
import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from tradewind.functions import core
from tradewind.operators import alerts, anomaly, canonical, quality, relational, templates
from tradewind.plans import marketplace
from tradewind.sources import kafka
from tradewind.streaming import events as streaming

DAY = dt.date


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_functions(spark):
    df = spark.createDataFrame([("a", 6.0, 2.0, "00212 612-345678", "http://x/?utm_source=a+b&utm_campaign=")], "k string, n double, d double, p string, u string")
    r = df.select(core.ratio("n", "d").alias("x"), core.ratio(F.col("n"), F.lit(0)).alias("z"), core.uuid5(uuid.NAMESPACE_URL.hex, F.col("k")).alias("u5"), core.hmac_sha256(b"key", F.col("k")).alias("h"), core.hmac_sha256(b"k" * 80, F.col("k")).alias("h2"), core.phone("p").alias("p"), core.utm("u", "utm_source").alias("s"), core.utm("u", "utm_campaign").alias("c")).first()
    assert (r.x, r.z, r.p, r.s, r.c) == (3.0, None, "212612345678", "a b", None)
    assert r.u5 == str(uuid.uuid5(uuid.NAMESPACE_URL, "a"))
    assert r.h == hmac.new(b"key", b"a", hashlib.sha256).hexdigest() and r.h2 == hmac.new(b"k" * 80, b"a", hashlib.sha256).hexdigest()


def test_effective_dated_cost(spark):
    facts = spark.createDataFrame([(1, "p", DAY(2024, 1, 5)), (2, "p", DAY(2023, 1, 1)), (3, "q", DAY(2024, 1, 5)), (4, "p", DAY(2024, 2, 1))], "id int, product string, day date")
    costs = spark.createDataFrame([("old", "p", 1.0, DAY(2024, 1, 1), DAY(2024, 1, 31), 1), ("new", "p", 2.0, DAY(2024, 1, 3), None, 1), ("newer", "p", 3.0, DAY(2024, 1, 3), DAY(2024, 1, 20), 2)], "cost_id string, product string, unit double, valid_from date, valid_to date, revision int")
    out = relational.effective(facts, costs, ["product"], "day", F.lit(1), ["id"], [F.desc("d.valid_from"), F.desc("d.revision")])
    assert rows(out, "id", "cost_id", "specificity") == [(1, "newer", 1), (2, None, 0), (3, None, 0), (4, "new", 1)]


def test_allocation_is_whole(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 10.0, 3.0), ("b", 9.0, 0.0), ("b", 9.0, 0.0), ("c", None, 2.0)], "k string, amount double, w double")
    assert rows(relational.allocate(df, {"share": "amount"}, "w", ["k"]), "k", "share") == [("a", 2.5), ("a", 7.5), ("b", 4.5), ("b", 4.5), ("c", None)]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", float("nan")), (2, None, -1.0), (None, "z", None)], "id int, s string, x double")
    got = {r.rule: r.status for r in quality.run(df, [quality.not_null("id"), quality.not_null("s", most=0.5, severity="WARNING"), quality.unique("id", "s"), quality.allowed("s", ["a", "z"], null_ok=True), quality.bounds("x", 0), quality.row_count(5), quality.volume(4, 0.0), quality.volume(None, 0.1), quality.not_null("nope"), quality.pattern("s", "^[a-z]$", null_ok=True)][:7]).collect()}
    assert got == {"not_null:id": "FAIL", "not_null:s": "PASS", "unique:id,s": "FAIL", "allowed:s": "PASS", "bounds:x": "FAIL", "row_count": "FAIL", "volume_change": "PASS"}
    assert {r.status for r in quality.run(df.limit(0), [quality.not_null("id")]).collect()} == {"WARN"}
    assert {r.rule: r.status for r in quality.run(df, [quality.not_null("nope"), quality.volume(None, 0.1)]).collect()} == {"not_null:nope": "FAIL", "volume_change": "WARN"}
    with pytest.raises(ValueError):
        quality.run(spark.readStream.format("rate").load(), [quality.row_count(1)])


def test_anomaly_spike(spark):
    pts = [("s", DAY(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i % 3) for i in range(40)] + [("s", DAY(2024, 2, 10), 99.0)]
    out = anomaly.graded(anomaly.robust(anomaly.with_history(spark.createDataFrame(pts, "series string, day date, value double"))))
    by_day = {r.day: r for r in out.collect()}
    assert by_day[DAY(2024, 1, 3)].status == "INSUFFICIENT_HISTORY" and by_day[DAY(2024, 1, 9)].strategy == "robust_history"
    assert by_day[DAY(2024, 2, 10)].status == "CRITICAL" and by_day[DAY(2024, 2, 9)].status == "NORMAL"
    line = [("s", DAY(2024, 1, 1) + dt.timedelta(days=i), 5.0 + 2 * i) for i in range(20)]
    r = anomaly.trend(spark.createDataFrame(line, "series string, day date, value double")).first()
    assert round(r.slope, 9) == 2 and round(r.prediction, 6) == r.value


def test_incident_fold(spark):
    occ = spark.createDataFrame([("a", 1, DAY(2024, 1, 1), "INFO", 1.0), ("a", 2, DAY(2024, 1, 2), "CRITICAL", 2.0), ("a", 2, DAY(2024, 1, 2), "CRITICAL", 2.0), ("a", 3, DAY(2024, 1, 20), "INFO", 3.0)], "alert string, occurrence_id int, seen_at date, severity string, evidence double")
    assert rows(alerts.fold(occ, "alert", 2), "incident", "occurrences", "severity_rank", "evidence") == [(0, 2, 2, 2.0), (1, 1, 0, 3.0)]


def test_providers(spark):
    g = spark.createDataFrame([("2024-01-01", "c", 1_500_000, 10, 20, None)], "segments_date string, campaign_id string, cost_micros long, impressions long, clicks long, conversions double")
    m = spark.createDataFrame([("2024-01-01", "c", 2.0, 100, 50)], "date_start string, campaign_id string, spend double, impressions long, reach long")
    out = canonical.ad_reports({"google": g, "meta": m})
    assert rows(out, "platform", "spend", "conversions", "frequency") == [("google", 1.5, 0.0, None), ("meta", 2.0, 0.0, 2.0)]
    assert rows(out.select("platform", F.array_join(canonical.ad_errors(), "|")))[0] == ("google", "invalid_currency|clicks_above_impressions")
    s = canonical.map_status(spark.createDataFrame([("delivery", "Done "), ("delivery", "??")], "role string, provider_status string"), {("delivery", "done"): "DELIVERED"})
    assert rows(s, "status", "status_error") == [("DELIVERED", None), (None, "unmapped_status")]


def test_templates(spark):
    sql = templates.expand("SELECT * FROM t WHERE 1 = 1 [[AND a = :a]] [[AND d BETWEEN :x AND :y]]", {"x": "date", "y": "date"})
    assert sql == "SELECT * FROM t WHERE 1 = 1 AND (cast(:a as string) IS NULL OR a = cast(:a as string)) AND (cast(:x as date) IS NULL OR cast(:y as date) IS NULL OR d BETWEEN cast(:x as date) AND cast(:y as date))"
    t = spark.createDataFrame([("p", 1), ("q' OR 1=1", 2)], "a string, n int")
    run = lambda **v: rows(templates.report(spark, "SELECT n FROM t_rows WHERE 1 = 1 [[AND a = :a]] [[AND n >= :n]]", {"t_rows": t}, {"n": "int"}, **v))
    assert run() == [(1,), (2,)] and run(a="q' OR 1=1") == [(2,)] and run(n=2) == [(2,)] and run(a="p", n=2) == []


def test_kafka_columns(spark):
    rec = kafka.records(spark.createDataFrame([("b", "c", 1), (None, "c", 2)], "business_id string, customer_id string, n int"))
    assert [r.key for r in rec.collect()] == ["b|c", "c"]
    src = rec.union(spark.createDataFrame([("k", "{broken")], "key string, value string")).select(F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(1).alias("offset"), F.current_timestamp().alias("timestamp"))
    got = rows(streaming.decode(src, "business_id string, customer_id string, n int"), "kafka_key", "n", "malformed")
    assert got == [("b|c", 1, False), ("c", 2, False), ("k", None, True)]


def test_codes_come_together(spark):
    row = {"business_id": "B!", "source_type": "marketplace", "source_id": "s", "event_id": None, "event_timestamp": None, "customer_id": " ", "session_id": "x", "country": "usa", "currency": "eur", "event_type": "nope", "quantity": 0, "unit_price": -1.0}
    schema = "business_id string, source_type string, source_id string, event_id string, event_timestamp timestamp, customer_id string, session_id string, country string, currency string, event_type string, quantity int, unit_price double"
    out = marketplace.classify(spark.createDataFrame([row], schema)).first()
    assert out.validation_errors == ["invalid_business_id", "missing_event_id", "missing_event_timestamp", "missing_customer_id", "invalid_event_type", "invalid_country", "non_positive_quantity", "negative_unit_price"] and out.currency == "EUR"
