"""Parts that no query uses, and invariants of operational records, on small rows with nulls and ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.functions import core
from tradewind.operators import canonical, metrics, operational, quality, relational
from tradewind.sources import files, kafka

AT = dt.datetime(2024, 1, 2)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_top_k_and_orphans(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), (None, 5), (None, None), ("b", None)], "k string, v int")
    got = rows(relational.top_k(df, ["k"], [F.desc_nulls_last("v")], 2))
    assert got == sorted([("a", 3, 1), ("a", 3, 2), (None, 5, 1), (None, None, 2), ("b", None, 1)], key=repr)
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    assert rows(relational.orphans(child, spark.createDataFrame([(2,), (None,)], "y int"), "x", "y")) == [(1,)]
    g = df.groupBy("k").agg(relational.single_or("v", F.lit(-1)).alias("v"))
    assert {r.k: r.v for r in g.collect()} == {"a": -1, None: 5, "b": -1}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "d": "2024-01-05 00:00:00"}, {"x": 2, "d": "2024-01-01 00:00:00"}, {"x": 3}]')
    from pyspark.sql import types as T

    df = files.json_array(spark, f"file://{tmp_path}/a.json", T._parse_datatype_string("x int, d timestamp"))
    assert rows(df.filter(files.since("2024-01-04 00:00:00", 2, "d")).select("x")) == [(1,)]
    (tmp_path / "b.json").write_text("[{")
    with pytest.raises(Exception):
        files.json_array(spark, f"file://{tmp_path}/b.json", T._parse_datatype_string("x int")).collect()


def test_shop_orders(spark):
    schema = "order_id string, currency string, subtotal double, shipping double, tax double, discount double, total double, line_items array<struct<quantity: int>>"
    good = ("1", "USD", 10.0, 2.0, 1.0, 3.0, 10.01, [(1,)])
    bad = (None, "usd", -1.0, None, None, None, 5.0, [(0,)])
    df = spark.createDataFrame([good, bad, ("2", "EUR", 1.0, 0.0, 0.0, 0.0, 1.0, [])], schema)
    got = [r[0] for r in df.select(canonical.shopify_errors()).collect()]
    assert got == [[], ["missing_order_id", "invalid_currency", "negative_subtotal", "total_mismatch", "non_positive_quantity"], ["no_line_items"]]


def test_kafka_records(spark):
    df = spark.createDataFrame([("b", "c", 1), (None, "c", 2), (None, None, 3)], "business_id string, customer_id string, n int")
    assert [(r.key, r.value) for r in kafka.records(df).collect()] == [("b|c", '{"business_id":"b","customer_id":"c","n":1}'), ("c", '{"customer_id":"c","n":2}'), (None, '{"n":3}')]
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka.read_stream(spark, "nowhere:9092")


def test_campaign_texts(spark):
    data = [None, "", "  ", "{}", '{"UTM Source": "a", "source": "b", "Medium": ""}', "[1]", "{broken", "utm_source:xutm_source=y", "id:1CONTENT = 'z' ", "term:%zz+q", "source:" + "x" * 300]
    df = spark.createDataFrame([(t,) for t in data], "t string")
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in df.select(*[c.alias(n) for n, c in core.utm_texts("t").items()]).collect()]
    assert got == [{}, {}, {}, {}, {"utm_source": "a"}, {}, {}, {"utm_source": "y"}, {"utm_id": "1", "utm_content": "z"}, {"utm_term": "%zz q"}, {"utm_source": "x" * 255}]


def test_registry(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(None, 1), (7, None)], "id int, v int")
    x = quality.registry(df, "id", {"one": ("ERROR", "D", F.col("v") == 1), "never": ("INFO", "D", F.col("v") > 9)}, samples=3)
    assert rows(x) == [("never", "INFO", "D", 0, []), ("one", "ERROR", "D", 11, ["1", "13", "17"])]
    assert rows(quality.registry(df.limit(0), "id", {"one": ("ERROR", "D", F.col("v") == 1)})) == [("one", "ERROR", "D", 0, [])]


def test_metrics(spark):
    df = spark.createDataFrame([("b", None, dt.date(2024, 1, 1), 2, 4), (None, "x", None, 1, 1), ("a", "x", dt.date(2024, 1, 2), 1, None)], "d2 string, d1 string, day date, n int, of int")
    x = metrics.extract(df, "t", "day", ["d2", "d1"], {"rate": (F.col("n") / F.col("of"), F.col("of")), "n": (F.col("n"), None)})
    assert rows(x) == sorted([("t", "rate", '{"d2":"b"}', dt.date(2024, 1, 1), 0.5, 4), ("t", "n", '{"d2":"b"}', dt.date(2024, 1, 1), 2.0, None), ("t", "n", '{"d1":"x","d2":"a"}', dt.date(2024, 1, 2), 1.0, None)], key=repr)


@pytest.mark.parametrize(("kind", "schema", "data"), [
    ("order_line", "order_id string, line_id string, quantity int, unit_price double, currency string", [(("1", "1", 1, 0.0, "USD"), []), (("1", " ", 0, -1.0, None), ["missing_identity", "non_positive_quantity", "invalid_unit_price", "invalid_currency"]), (("1", "2", None, float("nan"), "USD"), ["non_positive_quantity", "invalid_unit_price"])]),
    ("commerce_order", "business_id string, order_id string, order_created_at timestamp_ntz, order_updated_at timestamp_ntz, order_value double, currency string, payment_type string", [(("biz_1", "1", AT, AT, 1.0, "USD", "cod"), []), (("B", "1", AT, AT - dt.timedelta(1), float("inf"), "USD", "gift"), ["missing_identity", "updated_before_created", "invalid_order_value", "invalid_payment_type"]), (("biz_1", "1", None, AT, 0.0, "USD", None), ["missing_time", "invalid_payment_type"])]),
    ("operational_event", "provider string, event_id string, external_event_id string, order_id string, provider_status string, revision int, event_at timestamp_ntz, received_at_utc timestamp_ntz", [(("p", "e", "x", "o", "s", 1, AT, AT), []), (("p", "e", "x", "o", "", 0, None, AT), ["missing_identity", "invalid_revision", "missing_time"])]),
    ("fulfillment", "business_id string, order_id string, fulfillment_id string, provider string, line_quantities map<string, int>", [(("b", "o", "f", "p", {"a": 1}), []), (("b", "o", "f", "p", None), []), ((None, "o", "f", "p", {"a": 0}), ["missing_identity", "invalid_line_quantities"]), (("b", "o", "f", "p", {"": 1}), ["invalid_line_quantities"])]),
    ("shipment", "business_id string, order_id string, fulfillment_id string, shipment_id string, provider string, shipped_at timestamp_ntz, delivered_at timestamp_ntz, line_quantities map<string, int>", [(("b", "o", "f", "s", "p", AT, AT, {}), []), (("b", "o", "f", "s", "p", AT, AT - dt.timedelta(1), {"a": None}), ["delivered_before_shipped", "invalid_line_quantities"])]),
    ("delivery_attempt", "event_id string, attempt_number int", [(("e", 1), []), (("e", 0), ["invalid_attempt_number"]), ((None, None), ["missing_identity", "invalid_attempt_number"])]),
    ("cash_collection", "business_id string, collection_id string, order_id string, cash_expected double, cash_collected double, collection_currency string", [(("b", "c", "o", 1.0, 0.0, "USD"), []), (("b", "c", "o", None, -1.0, "usd"), ["invalid_cash_expected", "invalid_cash_collected", "invalid_currency"])]),
])
def test_invariants(spark, kind, schema, data):
    df = spark.createDataFrame([r for r, _ in data], schema).coalesce(1)
    assert [r.record_errors for r in operational.checked(df, kind).collect()] == [codes for _, codes in data]
