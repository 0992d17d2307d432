"""Registry configs with planted faults, and connector state from a log of runs."""

import datetime as dt
import json

from tradewind.sources import registry

GOOD_B = {"business_id": "biz_one", "business_name": "One", "status": "ACTIVE", "timezone": "UTC", "reporting_timezone": "UTC", "currency": "USD", "country": "US", "enabled_sources": ["src_a"]}
GOOD_S = {"business_id": "biz_one", "source_id": "src_a", "source_type": "shopify", "schema_version": "1", "ingestion_mode": "batch", "schedule": "0 * * * *", "credential_ref": "KEY_A", "enabled": True, "metadata": {}}


def read(spark, tmp_path, name, rows, schema):
    folder = tmp_path / name
    folder.mkdir()
    for i, r in enumerate(rows):
        (folder / f"{i}.json").write_text(json.dumps(r))
    return registry.configs(spark, f"file://{folder}", schema)


def test_issues(spark, tmp_path):
    businesses = [GOOD_B, GOOD_B | {"business_id": "X", "business_name": " ", "timezone": "Nowhere", "currency": "usd", "country": None, "enabled_sources": ["s", "s", "gone"]}, GOOD_B | {"business_id": "twice_b"}, GOOD_B | {"business_id": "twice_b"}]
    admin = {"adapter": "admin_api", "api_version": "2024-02", "shop_domain_ref": "low"}
    sources = [GOOD_S, GOOD_S | {"source_id": "src_b"}, GOOD_S | {"business_id": "X", "source_id": "s", "source_type": "odd", "ingestion_mode": "live", "schedule": "hourly", "credential_ref": None, "enabled": False}, GOOD_S | {"source_id": "src_c", "enabled": False, "metadata": admin, "schema_version": "9"}]
    b, s = read(spark, tmp_path, "b", businesses, registry.BUSINESS), read(spark, tmp_path, "s", sources, registry.SOURCE)
    got = {(r.business_id, r.code) for r in registry.business_issues(b, ["UTC"]).collect()}
    assert got == {("X", c) for c in ("invalid_business_id", "invalid_business_metadata", "invalid_timezone", "invalid_currency", "invalid_country", "duplicate_enabled_source")} | {("twice_b", "business_not_found")}
    contracts = spark.createDataFrame([("shopify", "1")], "source_type string, schema_version string")
    got = {(r.business_id, r.source_id, r.code) for r in registry.source_issues(b, s, contracts).collect()}
    want = {("biz_one", "src_b", "enabled_source_unlisted"), ("X", "gone", "enabled_source_missing"), ("twice_b", "src_a", "enabled_source_missing")}
    want |= {("X", "s", c) for c in ("unsupported_source_type", "listed_source_disabled", "invalid_source_id", "invalid_ingestion_mode", "invalid_schedule", "missing_credential_ref", "unsupported_schema_version")}
    want |= {("biz_one", "src_c", c) for c in ("missing_shop_domain_ref", "invalid_shopify_api_version", "missing_backfill_start_ref", "unsupported_schema_version")}
    assert got == want
    assert registry.business_issues(b.limit(0), ["UTC"]).count() == registry.source_issues(b.limit(0), s.limit(0), contracts).count() == 0


def test_state(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    runs = [("b", "s", at(1), True, at(0), 5, None), ("b", "s", at(3), True, at(2), 7, None), ("b", "s", at(4), False, at(9), 0, "down"), ("b", "t", at(1), False, None, None, "x"), ("b", "t", at(2), True, at(1), 3, "old")]
    df = spark.createDataFrame(runs, "business_id string, source_id string, attempted_at timestamp_ntz, ok boolean, checkpoint timestamp_ntz, records int, error string")
    got = {r.source_id: tuple(r)[2:] for r in registry.connector_state(df).collect()}
    assert got == {"s": (at(4), at(3), at(2), 7, "down", "failing"), "t": (at(2), at(2), at(1), 3, None, "healthy")}
    assert registry.connector_state(df.limit(0)).count() == 0
