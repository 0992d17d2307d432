"""Provider reports and statuses in canonical form, with invariants as error columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.core import errors, ratio

#: Canonical column of each provider's field; fixed by the providers' public report formats.
PROVIDERS: dict[str, dict[str, str]] = {
    "meta": {"report_date": "date_start", "account_id": "account_id", "campaign_id": "campaign_id", "ad_group_id": "adset_id", "ad_id": "ad_id", "currency": "account_currency", "spend": "spend", "impressions": "impressions", "clicks": "clicks", "reach": "reach", "conversions": "actions", "conversion_value": "action_values"},
    "tiktok": {"report_date": "stat_time_day", "account_id": "advertiser_id", "campaign_id": "campaign_id", "ad_group_id": "adgroup_id", "ad_id": "ad_id", "currency": "currency", "spend": "stat_cost", "impressions": "show_cnt", "clicks": "click_cnt", "conversions": "conversion", "conversion_value": "conversion_value"},
    "google": {"report_date": "segments_date", "account_id": "customer_id", "campaign_id": "campaign_id", "ad_group_id": "ad_group_id", "ad_id": "ad_id", "currency": "currency", "spend": "cost_micros", "impressions": "impressions", "clicks": "clicks", "conversions": "conversions", "conversion_value": "conversions_value"},
    "generic": {k: k for k in ("report_date", "account_id", "campaign_id", "ad_group_id", "ad_id", "currency", "spend", "impressions", "clicks", "reach", "conversions", "conversion_value")},
}
_TYPES = {"report_date": "date", "spend": "double", "impressions": "long", "clicks": "long", "reach": "long", "conversions": "double", "conversion_value": "double"}
COLUMNS = ["platform", *PROVIDERS["generic"], "frequency"]


def ad_report(df: DataFrame, provider: str) -> DataFrame:
    """A provider's ad days with canonical names and types; what it doesn't tell is null, no conversions are nought."""
    names = PROVIDERS[provider]
    cols = []
    for c in PROVIDERS["generic"]:
        src = names.get(c)
        x = F.col(src) if src in df.columns else F.lit(None)
        x = x.cast(_TYPES.get(c, "string"))
        if provider == "google" and c == "spend":
            x = x / 1e6
        cols.append((F.coalesce(x, F.lit(0.0)) if c == "conversions" else x).alias(c))
    out = df.select(F.lit(provider if provider != "generic" else None).cast("string").alias("platform") if provider != "generic" or "platform" not in df.columns else F.col("platform").cast("string"), *cols)
    return out.withColumn("frequency", ratio("impressions", "reach")).select(*COLUMNS)


def ad_reports(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All providers' ad days in one table."""
    out = None
    for provider, df in frames.items():
        x = ad_report(df, provider)
        out = x if out is None else out.unionByName(x)
    return out


def ad_errors() -> Column:
    """Invariants of a canonical ad day."""
    return errors(
        (F.col("report_date").isNull(), "missing_date"), (F.col("campaign_id").isNull() & F.col("ad_group_id").isNotNull(), "ad_group_without_campaign"), (F.col("ad_group_id").isNull() & F.col("ad_id").isNotNull(), "ad_without_ad_group"),
        (~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "invalid_currency"), (F.col("spend") < 0, "negative_spend"), (F.col("clicks") > F.col("impressions"), "clicks_above_impressions"),
    )


def map_status(df: DataFrame, mapping: Mapping[tuple[str, str], str], role: str = "role", status: str = "provider_status", out: str = "status") -> DataFrame:
    """Canonical status by (role, provider's status), case aside; status_error tells the unmapped ones."""
    table = F.create_map(*[F.lit(x) for (r, s), c in mapping.items() for x in (f"{r}|{s.lower()}", c)])
    found = F.element_at(table, F.concat_ws("|", F.col(role), F.lower(F.trim(F.col(status)))))
    return df.withColumn(out, found).withColumn("status_error", F.when(F.col(out).isNull(), F.lit("unmapped_status")))


def shopify_errors() -> Column:
    """Codes for shop orders: ids, currency, amounts, and a total within two cents of its parts."""
    money = ["subtotal", "shipping", "tax", "discount", "total"]
    parts = F.coalesce(F.col("subtotal"), F.lit(0.0)) - F.coalesce(F.col("discount"), F.lit(0.0)) + F.coalesce(F.col("shipping"), F.lit(0.0)) + F.coalesce(F.col("tax"), F.lit(0.0))
    return errors(
        (F.col("order_id").isNull(), "missing_order_id"), (~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)), "invalid_currency"),
        *[(F.col(c) < 0, f"negative_{c}") for c in money],
        (F.abs(parts - F.col("total")) > 0.02, "total_mismatch"), (F.size("line_items") < 1, "no_line_items"), (F.exists("line_items", lambda x: x["quantity"] <= 0), "non_positive_quantity"),
    )
