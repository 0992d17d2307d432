"""Pilot rules: quantities from text, rule costs, intents at order grain, campaign outcomes, hierarchy conflicts.

lineitem stands for the shop's intents and the leads. Null texts and prices give null
quantities, repeated rows count once where the grain says so, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.core import UTM_NAMES, money, utm_texts
from tradewind.plans.registry import query, table

#: Patterns of a quantity in a lead's text, and what offers at a price hold.
QUANTITY = (r"(?i)(?:QTY|QUANTITY)\s*[:=x-]?\s*(\d+)", r"(?i)\b(\d+)\s*x\b")
OFFERS = {199: 2, 299: 4}
#: Dollars: the call centre by outcome, logistics by outcome, goods a unit; share of what is collected on delivery.
CALLS, LOGISTICS, UNIT_COGS, COD_SHARE = {"delivered": 3.0, "confirmed": 2.0, "other": 0.5, "wrong": 0.0}, {"delivered": 4.99, "shipped": 2.99, "none": 0.0}, 2.80, 0.05

_LEADS = {
    "order_id": "l_orderkey",
    "item_id": "l_partkey",
    "line_number": "l_linenumber",
    "products": "case l_linenumber % 4 when 0 then concat('SKU ', l_partkey, ' QTY: ', cast(l_quantity as int)) when 1 then concat('quantity', cast(l_quantity as int)) when 2 then concat(cast(l_quantity as int), ' X widget') else concat('widget', l_partkey) end",
    "price": "case l_suppkey % 3 when 0 then 199 when 1 then 299 else 50 end",
    "total": "cast(floor(l_extendedprice / 20000) as double)",
    "lead": "case l_linenumber % 5 when 0 then 'wrong' when 1 then 'cancelled' when 2 then null else 'confirmed' end",
    "shipped": "l_linenumber > 2",
    "delivered": "l_linenumber > 3 and l_returnflag <> 'R'",
    "created_at": "l_shipdate",
    "utm_source": "case when l_suppkey % 3 = 0 then ' TikTok ' else 'meta' end",
    "utm_id": "case when l_suppkey % 5 = 0 then '' else concat('c', l_suppkey % 7) end",
    "utm_campaign": "concat('Campaign ', l_suppkey % 7)",
    "flag": "l_returnflag",
}
_SQL = f"leads AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _LEADS.items())} FROM lineitem)"


def leads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in _LEADS.items()])


def quantity(text: str = "products", price: str = "price") -> Column:
    """A quantity said in the text, else what the offer at that price holds, else null."""
    found = [F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit("")).cast("int") for p in QUANTITY]
    offer = F.lit(None).cast("int")
    for amount, n in OFFERS.items():
        offer = F.when(F.col(price) == amount, n).otherwise(offer)
    return F.coalesce(*found, offer)


_QUANTITY_SQL = f"coalesce({', '.join(f'''try_cast(nullif(regexp_extract(products, '{p}', 1), '') AS INTEGER)''' for p in QUANTITY)}, CASE {' '.join(f'WHEN price = {a} THEN {n}' for a, n in OFFERS.items())} END)"


@query(f"WITH {_SQL} SELECT {_QUANTITY_SQL} AS quantity, line_number % 4 AS kind, count(*) AS leads FROM leads GROUP BY 1, 2")
def pil_quantity(spark, sf_dir):
    return leads(spark, sf_dir).groupBy(quantity().alias("quantity"), (F.col("line_number") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("leads"))


def rule_costs(df: DataFrame) -> DataFrame:
    """df with call_center, logistics, goods and cod_fee by outcome; a missing or wrong lead costs the call centre nothing."""
    confirmed, delivered = F.coalesce(F.col("lead") == "confirmed", F.lit(False)), F.col("delivered")
    calls = F.when(F.col("lead").isNull() | (F.col("lead") == "wrong"), CALLS["wrong"]).when(confirmed & delivered, CALLS["delivered"]).when(confirmed, CALLS["confirmed"]).otherwise(CALLS["other"])
    freight = F.when(delivered, LOGISTICS["delivered"]).when(F.col("shipped"), LOGISTICS["shipped"]).otherwise(LOGISTICS["none"])
    goods = F.when(delivered, F.coalesce("quantity", F.lit(0)) * UNIT_COGS).otherwise(0.0)
    fee = F.when(delivered, F.coalesce(F.col("total"), F.lit(0)) * COD_SHARE).otherwise(0.0)
    return df.withColumns({"call_center": calls, "logistics": freight, "goods": goods, "cod_fee": fee})


_COSTS_SQL = f"""costs AS (SELECT *, CASE WHEN lead IS NULL OR lead = 'wrong' THEN {CALLS['wrong']} WHEN lead = 'confirmed' AND delivered THEN {CALLS['delivered']} WHEN lead = 'confirmed' THEN {CALLS['confirmed']} ELSE {CALLS['other']} END AS call_center,
 CASE WHEN delivered THEN {LOGISTICS['delivered']} WHEN shipped THEN {LOGISTICS['shipped']} ELSE 0 END AS logistics, CASE WHEN delivered THEN coalesce({_QUANTITY_SQL}, 0) * {UNIT_COGS} ELSE 0 END AS goods,
 CASE WHEN delivered THEN coalesce(total, 0) * {COD_SHARE} ELSE 0 END AS cod_fee FROM leads)"""


@query(f"""WITH {_SQL}, {_COSTS_SQL} SELECT coalesce(lead, 'none') AS lead, delivered, count(*) AS leads, {', '.join(f'CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) AS {c}' for c in ('call_center', 'logistics', 'goods', 'cod_fee'))} FROM costs GROUP BY 1, 2""")
def pil_costs(spark, sf_dir):
    c = rule_costs(leads(spark, sf_dir).withColumn("quantity", quantity()))
    return c.groupBy(F.coalesce("lead", F.lit("none")).alias("lead"), "delivered").agg(F.count(F.lit(1)).alias("leads"), *[money(x).alias(x) for x in ("call_center", "logistics", "goods", "cod_fee")])


def intents(rows: DataFrame) -> DataFrame:
    """One row an order: least total, distinct items, what its first row by time says, the price if all rows name one, whether totals differ.

    Minima and maxima decide, no set of an order's rows is gathered.
    """
    first = F.min(F.struct("created_at", "line_number", "item_id", "flag"))
    return rows.groupBy("order_id").agg(
        F.min("total").alias("initial_total"),
        F.count_distinct("item_id").alias("initial_quantity"),
        first["created_at"].alias("created_at"),
        first["flag"].alias("flag"),
        F.when(F.min("price") == F.max("price"), F.min("price")).alias("price"),
        F.coalesce(F.min("total") < F.max("total"), F.lit(False)).alias("conflicting_totals"),
    )


@query(f"""WITH {_SQL} SELECT order_id, min(total) AS initial_total, count(DISTINCT item_id) AS initial_quantity, min({{'a': created_at, 'b': line_number, 'c': item_id, 'd': flag}}).a AS created_at,
 min({{'a': created_at, 'b': line_number, 'c': item_id, 'd': flag}}).d AS flag, CASE WHEN count(DISTINCT price) = 1 THEN min(price) END AS price, count(DISTINCT total) > 1 AS conflicting_totals FROM leads GROUP BY 1""")
def pil_intents(spark, sf_dir):
    return intents(leads(spark, sf_dir))


def campaign_outcomes(rows: DataFrame, facts: DataFrame, source: str = "tiktok") -> DataFrame:
    """Orders of a source by campaign and day, counted by outcome; only orders whose rows name one campaign, and name it."""
    own = rows.filter(F.lower(F.trim("utm_source")) == source)
    pair = F.struct(F.trim(F.coalesce("utm_id", F.lit(""))).alias("campaign_id"), F.trim(F.coalesce("utm_campaign", F.lit(""))).alias("campaign_name"))
    one = own.groupBy("order_id").agg(F.min(pair).alias("x"), F.max(pair).alias("y")).filter("x = y and x.campaign_id <> ''").select("order_id", "x.*")
    day = facts.withColumn("report_date", F.to_date("created_at"))
    counts = [F.count_if(F.col("outcome") == o).alias(f"{o.lower()}_orders") for o in ("MATCHED", "AMBIGUOUS", "UNMATCHED")]
    return day.join(one, "order_id").groupBy("campaign_id", "campaign_name", "report_date").agg(F.count(F.lit(1)).alias("initial_orders"), *counts)


@query(f"""WITH {_SQL}, own AS (SELECT order_id, count(DISTINCT {{'a': trim(utm_id), 'b': trim(utm_campaign)}}) AS n, min(trim(utm_id)) AS campaign_id, min(trim(utm_campaign)) AS campaign_name FROM leads WHERE lower(trim(utm_source)) = 'tiktok' GROUP BY 1),
facts AS (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS report_date, CASE o_orderstatus WHEN 'F' THEN 'MATCHED' WHEN 'O' THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS outcome FROM orders)
SELECT campaign_id, campaign_name, report_date, count(*) AS initial_orders, count(*) FILTER (WHERE outcome = 'MATCHED') AS matched_orders, count(*) FILTER (WHERE outcome = 'AMBIGUOUS') AS ambiguous_orders,
 count(*) FILTER (WHERE outcome = 'UNMATCHED') AS unmatched_orders FROM facts JOIN own USING (order_id) WHERE n = 1 AND campaign_id <> '' GROUP BY 1, 2, 3""")
def pil_outcomes(spark, sf_dir):
    outcome = "case o_orderstatus when 'F' then 'MATCHED' when 'O' then 'AMBIGUOUS' else 'UNMATCHED' end as outcome"
    facts = table(spark, sf_dir, "orders").selectExpr("o_orderkey as order_id", "o_orderdate as created_at", outcome)
    return campaign_outcomes(leads(spark, sf_dir), facts)


#: Levels of an ad account: id, and what an id may stand under and be called once only.
_LEVELS = {"campaign": ("utm_id", ["utm_campaign"]), "ad_group": ("item_id", ["utm_id", "flag"]), "ad": ("order_id", ["utm_id", "utm_campaign", "flag"])}


def hierarchy_conflicts(rows: DataFrame, levels: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(level, conflicts): ids that stand under more than one parent or name, a null being a value like any other."""
    out = None
    for level, (key, under) in levels.items():
        values = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in under])
        one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg((F.min(values) != F.max(values)).alias("bad"))
        part = one.agg(F.count_if("bad").alias("conflicts")).select(F.lit(level).alias("level"), "conflicts")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH " + _SQL + " " + " UNION ALL ".join(f"SELECT '{level}' AS level, count(*) AS conflicts FROM (SELECT {key} FROM leads GROUP BY 1 HAVING count(DISTINCT row({', '.join(under)})) > 1)" for level, (key, under) in _LEVELS.items()))
def pil_hierarchy(spark, sf_dir):
    return hierarchy_conflicts(leads(spark, sf_dir), _LEVELS)


#: Parameters as they come: JSON, runs with nothing between, delimited lists, other text and nothing.
_UTM_TEXT = """case o_orderkey % 5 when 0 then concat('{"UTM Source": "s', o_custkey % 7, '", "medium": " cpc ", "utm_id": "', o_custkey % 5, '"}')
 when 1 then concat('utm_source:"fb', o_custkey % 7, '"utm_medium=cpc+', o_custkey % 3, 'UTM campaign = a%20b%C3%A9Content:x', o_orderkey % 9)
 when 2 then concat('source=tt&medium=vid; medium=', o_custkey % 4, '&term=,') when 3 then 'nothing of note' end"""


def _run_sql(n: str) -> str:
    last = f"list_filter(segments, lambda x: lower(split_part(x, chr(2), 1)) = '{n}')[-1]"
    bare = f"regexp_replace(split_part({last}, chr(2), 2), '^[ \t\r\n,;&\"''}}]+|[ \t\r\n,;&\"''}}]+$', '', 'g')"
    given = {"source": "UTM Source", "medium": "medium", "id": "utm_id"}.get(n)
    of_json = f"json_extract_string(text, '$.\"{given}\"')" if given else "NULL"
    return f"nullif(left(trim(CASE WHEN starts_with(text, '{{') THEN {of_json} ELSE url_decode(replace({bare}, '+', ' ')) END), 255), '') AS utm_{n}"


@query(f"""WITH t AS (SELECT {_UTM_TEXT} AS text FROM orders),
m AS (SELECT *, list_filter(string_split(regexp_replace(text, '(?:utm[_ ]?)?(source|id|campaign|medium|content|term)\\s*[:=]\\s*["'']?', chr(1) || '\\1' || chr(2), 'gi'), chr(1)), lambda x: contains(x, chr(2))) AS segments FROM t),
p AS (SELECT {', '.join(_run_sql(n) for n in UTM_NAMES)} FROM m) SELECT *, count(*) AS orders FROM p GROUP BY ALL""")
def pil_utm_texts(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.expr(_UTM_TEXT).alias("text")).select(*[v.alias(n) for n, v in utm_texts("text").items()])
    return x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("orders"))
