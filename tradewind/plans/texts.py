"""Text helpers: campaign parameters in URLs, and screens for personal data and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions.core import errors, utm
from tradewind.plans.registry import query, table

EMAIL, PHONE, CAUSAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?[0-9][0-9 ()-]{7,}[0-9]", r"(?i)\b(because of|caused by|due to|leads to)\b"


@query("""SELECT page_id, nullif(left(url_decode(replace(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '+', ' ')), 255), '') AS source, nullif(left(url_decode(replace(regexp_extract(url, '[?&]utm_campaign=([^&#]*)', 1), '+', ' ')), 255), '') AS campaign, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def tx_utm(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", utm("url", "utm_source").alias("source"), utm("url", "utm_campaign").alias("campaign"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


def _screen(c: str):
    x = F.col(c)
    return errors((x.rlike(EMAIL), "EMAIL"), (x.rlike(PHONE), "PHONE"), (x.rlike(CAUSAL), "CAUSAL_CLAIM"))


_SCREEN_SQL = f"array_to_string(list_filter([CASE WHEN regexp_matches(text, '{EMAIL}') THEN 'EMAIL' END, CASE WHEN regexp_matches(text, '{PHONE}') THEN 'PHONE' END, CASE WHEN regexp_matches(text, '{CAUSAL}') THEN 'CAUSAL_CLAIM' END], lambda x: x IS NOT NULL), '|')"


@query(f"SELECT conv_id, turn, {_SCREEN_SQL} AS flags FROM conversations")
def tx_pii_screen(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(_screen("text"), "|").alias("flags"))
