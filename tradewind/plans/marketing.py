"""Marketing: latest revision of each ad day, four grains with ratio-of-sums indicators, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.core import money, ratio
from tradewind.operators.relational import latest
from tradewind.plans.registry import query
from tradewind.sources import commerce

AD_DAY = ["business_id", "platform", "campaign_id", "ad_group_id", "ad_id", "report_date", "currency"]
GRAINS = {
    "daily": ["business_id", "platform", "report_date", "currency"],
    "campaign": ["business_id", "platform", "campaign_id", "report_date", "currency"],
    "ad_group": ["business_id", "platform", "campaign_id", "ad_group_id", "report_date", "currency"],
    "ad": AD_DAY,
}
_LATEST_SQL = f"{commerce.ADS_SQL}, ad_days AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(AD_DAY)} ORDER BY revision DESC, native DESC, spend DESC, impressions DESC) AS n FROM ads_in) WHERE n = 1)"
_SUMS_SQL = """CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, sum(conversions) AS conversions, CAST(sum(CAST(conversion_value AS DECIMAL(18,4))) AS DOUBLE) AS conversion_value"""
_KPI_SQL = "clicks / nullif(impressions, 0) AS ctr, spend / nullif(clicks, 0) AS cpc, 1000 * spend / nullif(impressions, 0) AS cpm, spend / nullif(conversions, 0) AS cpa, conversion_value / nullif(spend, 0) AS platform_roas"


def _grain_sql(grain: str) -> str:
    keys = ", ".join(GRAINS[grain])
    return f"WITH {_LATEST_SQL}, g AS (SELECT {keys}, {_SUMS_SQL} FROM ad_days GROUP BY {keys}) SELECT *, {_KPI_SQL} FROM g"


def ad_days(spark, sf_dir) -> DataFrame:
    return latest(commerce.ads(spark, sf_dir), AD_DAY, [F.desc("revision"), F.desc("native"), F.desc("spend"), F.desc("impressions")])


def with_indicators(df: DataFrame) -> DataFrame:
    """Indicators as ratios of sums; nought below the line gives null."""
    return df.withColumns({"ctr": ratio("clicks", "impressions"), "cpc": ratio("spend", "clicks"), "cpm": ratio(1000 * F.col("spend"), F.col("impressions")), "cpa": ratio("spend", "conversions"), "platform_roas": ratio("conversion_value", "spend")})


def rollup(days: DataFrame, keys: list[str]) -> DataFrame:
    """Sums that stay null where all parts are."""
    sums = days.groupBy(*keys).agg(money("spend").alias("spend"), F.sum("impressions").cast("long").alias("impressions"), F.sum("clicks").cast("long").alias("clicks"), F.sum("conversions").alias("conversions"), money("conversion_value").alias("conversion_value"))
    return with_indicators(sums)


@query(f"WITH {_LATEST_SQL} SELECT {', '.join(AD_DAY)}, revision, native, spend FROM ad_days")
def ads_latest_revision(spark, sf_dir):
    return ad_days(spark, sf_dir).select(*AD_DAY, "revision", "native", "spend")


@query(_grain_sql("daily"))
def ads_daily(spark, sf_dir):
    return rollup(ad_days(spark, sf_dir), GRAINS["daily"])


@query(_grain_sql("campaign"))
def ads_campaign(spark, sf_dir):
    return rollup(ad_days(spark, sf_dir), GRAINS["campaign"])


@query(_grain_sql("ad_group"))
def ads_ad_group(spark, sf_dir):
    return rollup(ad_days(spark, sf_dir), GRAINS["ad_group"])


@query(_grain_sql("ad"))
def ads_ad(spark, sf_dir):
    return rollup(ad_days(spark, sf_dir), GRAINS["ad"])


@query(f"WITH {_LATEST_SQL}, g AS (SELECT platform, currency, {_SUMS_SQL} FROM ad_days GROUP BY 1, 2) SELECT *, {_KPI_SQL} FROM g")
def ads_overview(spark, sf_dir):
    return rollup(ad_days(spark, sf_dir), ["platform", "currency"])


@query(f"""WITH {_LATEST_SQL}, g AS (SELECT business_id, platform, currency, campaign_id, CAST(sum(CAST(spend AS DECIMAL(18,4))) AS DOUBLE) AS spend FROM ad_days GROUP BY ALL)
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY business_id, platform, currency ORDER BY spend DESC) AS spend_rank FROM g) WHERE spend_rank <= 10""")
def ads_spend_rank(spark, sf_dir):
    g = ad_days(spark, sf_dir).groupBy("business_id", "platform", "currency", "campaign_id").agg(money("spend").alias("spend"))
    return g.withColumn("spend_rank", F.dense_rank().over(Window.partitionBy("business_id", "platform", "currency").orderBy(F.desc("spend")))).filter("spend_rank <= 10")
