"""Alert lifecycle, layers, pilot rules and sinks on small rows with nulls, ties and repeats, and on empty tables."""

import datetime as dt
import types

import pytest
from pyspark.sql import functions as F

from tradewind.functions import core
from tradewind.operators import alerts, anomaly, quality, relational
from tradewind.plans import gates, layers, pilot, views
from tradewind.sources import files, sinks

AT = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def commands(spark, data):
    return spark.createDataFrame(data, "alert_id int, target string, at timestamp_ntz, number int, by string")


def folded(data):
    """The transitions command by command."""
    state, out = {}, []
    for alert, target, at, _, by in sorted((d for d in data if d[2] is not None), key=lambda d: (d[2], d[3])):
        before = state.get(alert, "OPEN")
        if by and by.strip() and (before, target) in alerts.TRANSITIONS:
            state[alert] = target
            out.append((alert, before, target, at, by.strip()))
    return sorted(out, key=repr)


def test_transitions_are_those_of_a_fold(spark):
    day = lambda d: AT(2024, 1, d)
    data = [
        (1, "ACKNOWLEDGED", day(2), 1, "a"), (1, "RESOLVED", day(3), 1, "b"), (1, "RESOLVED", day(4), 1, "c"), (1, "ACKNOWLEDGED", day(5), 1, "d"),
        (2, "RESOLVED", day(1), 2, " e "), (2, "ACKNOWLEDGED", day(1), 1, "f"), (3, "ACKNOWLEDGED", day(1), 1, " "), (3, "RESOLVED", day(2), 1, None),
        (4, "OPEN", day(1), 1, "g"), (5, "RESOLVED", None, 1, "h"), (6, "ACKNOWLEDGED", day(9), 1, "i"), (6, "ACKNOWLEDGED", day(9), 2, "j"), (7, "RESOLVED", day(1), 1, "k"), (7, "ACKNOWLEDGED", day(2), 1, "l"),
    ]
    assert rows(alerts.audit(commands(spark, data))) == folded(data)
    assert alerts.audit(commands(spark, [])).count() == 0


def test_claims(spark):
    now = "2024-01-02 00:00:00"
    late, soon = AT(2024, 1, 1), AT(2024, 1, 1, 23, 50)
    tried = spark.createDataFrame([("failed", 1, "FAILED", late), ("soon", 1, "FAILED", soon), ("sent", 1, "FAILED", late), ("sent", 2, "SENT", late), ("spent", 3, "FAILED", late), ("open", 1, "PENDING", None), ("odd", 1, "FAILED", None)], "key string, attempt int, status string, completed_at timestamp_ntz")
    keys = spark.createDataFrame([(k,) for k in ("new", "failed", "soon", "sent", "spent", "open", "odd", "new", None)], "key string")
    assert rows(alerts.claims(keys, tried, now, 3, 30)) == [("failed", 2), ("new", 1)]
    assert rows(alerts.claims(keys, tried.limit(0), now, 3, 30))[0][1] == 1 and alerts.claims(keys.limit(0), tried, now, 3, 30).count() == 0


def test_incidents_by_days(spark):
    day = lambda d: dt.date(2024, 1, d)
    occ = spark.createDataFrame([("a", 1, day(1), "INFO", 1.0), ("a", 2, day(3), "CRITICAL", 2.0), ("a", 3, day(3), "INFO", 3.0), ("a", 4, day(9), "INFO", None), ("a", 4, day(9), "INFO", None), (None, 5, day(1), "WARNING", 5.0)], "alert string, occurrence_id int, seen_at date, severity string, evidence double")
    got = {(r.alert, r.incident): (r.occurrences, r.severity_rank, r.first_seen, r.last_seen, r.evidence) for r in alerts.fold(occ, "alert", 2).collect()}
    assert got == {("a", 0): (3, 2, day(1), day(3), 3.0), ("a", 1): (1, 0, day(9), day(9), None), (None, 0): (1, 1, day(1), day(1), 5.0)}
    assert alerts.fold(occ.limit(0), "alert", 2).count() == 0
    due = alerts.due(alerts.fold(occ, "alert", 2), spark.createDataFrame([("a", 0, "INITIAL", True)], "alert string, incident long, kind string, ok boolean"), ["alert", "incident"], "2024-01-20", 3, 14, 3)
    assert ("a", 0, "INITIAL", 0) not in rows(due) and ("a", 0, "ESCALATION", 0) in rows(due) and ("a", 1, "INITIAL", 0) in rows(due)
    key = spark.createDataFrame([("x", None)], "a string, b string").select(alerts.incident_key("1", "a", "b").alias("k")).first().k
    assert len(key) == 64


def test_consolidated(spark):
    old = spark.createDataFrame([("k", 2, AT(2024, 1, 1), "INFO"), ("k", 1, AT(2024, 1, 1), "INFO"), ("k", 3, AT(2024, 1, 5), "CRITICAL"), ("one", 9, AT(2024, 1, 1), "INFO")], "incident_key string, alert_id int, created_at timestamp_ntz, severity string")
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in rows(alerts.consolidated(old))] == [("k", 1, 3, "CRITICAL", 2), ("one", 9, 1, "INFO", 0)]


def test_totals_and_others(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), (None, 4.0), (None, 5.0)], "k string, x double")
    assert rows(relational.others(df, ["k"], {"rest": "x"})) == [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", None, None), (None, 4.0, 5.0), (None, 5.0, 4.0)]
    assert relational.others(df.limit(0), ["k"], {"rest": "x"}).count() == 0


def test_urls_are_decoded(spark):
    df = spark.createDataFrame([("http://x/?utm_source=a%20b%C3%A9+c",), ("http://x/?utm_source=%zz",), ("http://x/",), (None,)], "u string")
    assert [r[0] for r in df.select(core.utm("u", "utm_source")).collect()] == ["a bé c", "%zz", None, None]


def test_quality_ordered_and_fresh(spark):
    df = spark.createDataFrame([(1, 2, AT(2024, 1, 1)), (3, 2, AT(2024, 1, 2)), (None, 1, None)], "a int, b int, t timestamp_ntz")
    got = {r.rule: r.status for r in quality.run(df, [quality.ordered("a", "b"), quality.fresh("t", "2024-01-02 01:00:00", 7200)]).collect()}
    assert got == {"ordered:a<=b": "FAIL", "freshness:t": "PASS"}


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert gates.exists(df).first().passed and not gates.exists(df.limit(0)).first().passed
    assert not gates.none(gates.repeated(df, ["a", "b"])).first().passed and gates.none(gates.repeated(df.filter("a = 2"), ["a"])).first().passed
    assert [r.name for r in gates.policy(df, ["b"])] == ["row_count", "not_null:b", "unique:b", "bounds:a"]


def test_layers_on_odd_records(spark):
    good = '{"business_id":"biz_1","source_type":"shopify","source_id":"src","schema_version":"1","event_id":"e","event_type":"PRODUCT_VIEWED","event_timestamp":"2024-01-02 03:04:05","customer_id":"c","country":"us","currency":"usd","reporting_date":"2024-01-01"}'
    old = '{"event_id":"f","event_type":"product_viewed","event_timestamp":"2024-01-02 03:04:05","customer_id":"c","session_id":"s"}'
    data = [(b"biz_1|c", good.encode(), 1), (b"c", old.encode(), 2), (b"x", old.encode(), 3), (None, b"{", 4), (b"c", None, 5), (b"biz_1|c", good.replace("shopify", "mall").encode(), 6), (b"biz_1|c", good.encode(), 1)]
    kafka = spark.createDataFrame([(k, v, "t", 0, o, AT(2024, 1, 1)) for k, v, o in data], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    b = layers.bronze(kafka)
    assert sorted((r.kafka_offset, *r.bronze_errors) for r in b.collect()) == [(1,), (1,), (2,), (3, "kafka_key_customer_id_mismatch"), (4, "malformed_json"), (5, "malformed_json"), (6,)]
    s = layers.silver(layers.split(b, "bronze_errors")[0])
    got = {r.kafka_offset: (r.business_id, str(r.event_date), r.event_type, r.is_active, tuple(r.silver_errors)) for r in s.collect()}
    assert got[1] == ("biz_1", "2024-01-01", "product_viewed", True, ()) and got[2][:2] == ("marketplace_default", "2024-01-02") and got[6][4] == ("missing_session_id",)
    assert layers.silver(layers.bronze(kafka.limit(0))).count() == 0
    assert layers.active(spark.createDataFrame([(None,), (True,), (False,)], "is_active boolean")).count() == 2


def test_pilot_rules(spark):
    df = spark.createDataFrame([("Qty: 3", 199.0), ("4x jar", 50.0), (None, 299.0), ("jar", 1.0), ("QUANTITY-2", None), (None, None)], "products string, price double")
    assert [r[0] for r in df.select(pilot.quantity()).collect()] == [3, 4, 4, None, 2, None]
    empty = spark.createDataFrame([], "order_id int, total double, item_id int, created_at timestamp_ntz, line_number int, flag string, price int")
    assert pilot.intents(empty).count() == 0
    tree = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), (None, "y")], "id string, name string")
    assert rows(pilot.hierarchy_conflicts(tree, {"ad": ("id", ["name"])})) == [("ad", 1)]


def test_views_on_empty_tables(spark):
    runs = spark.createDataFrame([], "quality_run_id int, dataset_name string, layer string, attempt_number int, overall_status string, started_at timestamp_ntz, completed_at timestamp_ntz")
    assert views.quality_history(runs).count() == 0
    one = spark.createDataFrame([(1, None, AT(2024, 1, 1), None, None)], "alert_event_id int, business_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, resolved_at timestamp_ntz")
    assert views.alert_history(one, "2024-01-02").first().duration_seconds == 86400.0


def test_chain_falls_back(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    data = [("season", day(i), 10.0 + i + (50.0 if i % 7 == 0 else 0.0)) for i in range(57)] + [("short", day(2 * i), 5.0) for i in range(9)] + [("lone", day(0), 1.0)]
    got = {r.series: r for r in anomaly.chain(spark.createDataFrame(data, "series string, day date, value double")).collect()}
    assert (got["season"].strategy, got["season"].status, got["season"].fallback_used) == ("seasonal_trend", "NORMAL", False)
    assert got["season"].expected == pytest.approx(116.0) and got["season"].slope == pytest.approx(1.0)
    assert (got["short"].strategy, got["short"].fallback_used, got["lone"].status) == ("robust_history", True, "INSUFFICIENT_HISTORY")
    assert "Baseline: seasonal + trend." in got["season"].explanation
    assert anomaly.chain(spark.createDataFrame([], "series string, day date, value double")).count() == 0


def test_upsert_and_swap(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    sinks.upsert(df, f"{base}/t", ["k"])
    sinks.upsert(df, f"{base}/t", ["k"])
    assert rows(spark.read.parquet(f"{base}/t")) == [("a", 2), (None, 1)]
    with pytest.raises(ValueError):
        sinks.swap(df, f"{base}/t", lambda _: False)
    assert spark.read.parquet(f"{base}/t").count() == 2
    sinks.json_lines(df, f"{base}/j")
    assert rows(files.json_lines(spark, f"{base}/j", "k string, v int").select("k", "v")) == [("a", 2), (None, 1)]


def test_overwrite_tries_again(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(sinks, "time", types.SimpleNamespace(sleep=calls.append))
    bad = spark.range(3).select(F.raise_error(F.lit("disk")).alias("x"))
    with pytest.raises(Exception, match="disk"):
        sinks.overwrite(bad, f"file://{tmp_path}/a/b", [f"file://{tmp_path}/a"], tries=3, pause=1)
    assert calls == [1, 2]
