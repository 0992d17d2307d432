"""A signed invoice ledger and the reconciliation of orders with their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.core import money, ratio
from tradewind.operators import quality as Q
from tradewind.operators.relational import single_or
from tradewind.plans.registry import query, table

#: lineitem as ledger lines: returns are negative, a high tax cancels, no discount is a zero price.
_LEDGER = {
    "sheet": "case when l_shipdate < timestamp '1998-07-01 00:00:00' then 'first' else 'second' end",
    "invoice": "concat(case when l_tax >= 0.08 then 'C' else '' end, cast(l_orderkey % 5000 as string))",
    "stock_code": "case when l_partkey % 40 = 0 then 'POST' when l_partkey % 41 = 0 then 'M' else cast(l_partkey as string) end",
    "quantity": "case when l_returnflag = 'R' then -l_quantity when l_partkey % 53 = 0 then null else l_quantity end",
    "price": "case when l_discount = 0 then 0 else l_extendedprice end",
    "day": "cast(l_shipdate as date)",
    "supplier": "l_suppkey",
}
_SPECIAL = ["POST", "M", "D", "DOT", "BANK CHARGES"]
_CLASS_SQL = f"case when starts_with(invoice, 'C') then 'cancellation' when quantity is null or price is null then 'missing_number' when quantity < 0 then 'adjustment' when price = 0 then 'zero_price' when stock_code in ({', '.join(repr(x) for x in _SPECIAL)}) then 'special_code' else 'sale' end"
_LEDGER_SQL = f"raw_ledger AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _LEDGER.items())} FROM lineitem), ledger AS (SELECT *, {_CLASS_SQL} AS class, CAST(quantity * price AS DECIMAL(18,4)) AS amount FROM raw_ledger)".replace("as string)", "as varchar)")


def ledger(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _LEDGER.items()])
    kind = F.when(F.col("invoice").startswith("C"), "cancellation").when(F.col("quantity").isNull() | F.col("price").isNull(), "missing_number").when(F.col("quantity") < 0, "adjustment").when(F.col("price") == 0, "zero_price").when(F.col("stock_code").isin(_SPECIAL), "special_code").otherwise("sale")
    return x.withColumn("class", kind).withColumn("amount", (F.col("quantity") * F.col("price")).cast("decimal(18,4)"))


@query(f"WITH {_LEDGER_SQL} SELECT class, count(*) AS lines, count(DISTINCT invoice) AS invoices, CAST(sum(amount) AS DOUBLE) AS value FROM ledger GROUP BY class")
def led_lines(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("invoice").alias("invoices"), F.sum("amount").cast("double").alias("value"))


@query(f"""WITH {_LEDGER_SQL} SELECT day, CAST(coalesce(sum(amount) FILTER (WHERE class = 'sale'), 0) AS DOUBLE) AS sales, CAST(coalesce(sum(amount) FILTER (WHERE class = 'cancellation'), 0) AS DOUBLE) AS cancellations,
 CAST(coalesce(sum(amount) FILTER (WHERE class = 'adjustment'), 0) AS DOUBLE) AS adjustments, CAST(coalesce(sum(amount) FILTER (WHERE class NOT IN ('sale', 'cancellation', 'adjustment')), 0) AS DOUBLE) AS other, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS net FROM ledger GROUP BY day""")
def led_daily(spark, sf_dir):
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("double")
    k = F.col("class")
    return ledger(spark, sf_dir).groupBy("day").agg(part(k == "sale").alias("sales"), part(k == "cancellation").alias("cancellations"), part(k == "adjustment").alias("adjustments"), part(~k.isin("sale", "cancellation", "adjustment")).alias("other"), part(F.lit(True)).alias("net"))


@query(f"""WITH {_LEDGER_SQL} SELECT sheet, invoice, count(*) AS lines, count(*) FILTER (WHERE class = 'sale') AS sale_lines, CAST(sum(amount) AS DOUBLE) AS value, min(day) AS first_day, max(day) AS last_day,
 CASE WHEN min(supplier) = max(supplier) THEN CAST(min(supplier) AS VARCHAR) ELSE 'MIXED_OR_UNKNOWN' END AS supplier, min(day) <> max(day) AS mixed_days FROM ledger GROUP BY 1, 2""")
def led_invoices(spark, sf_dir):
    x = ledger(spark, sf_dir).withColumn("supplier", F.col("supplier").cast("string"))
    return x.groupBy("sheet", "invoice").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("class") == "sale").alias("sale_lines"), F.sum("amount").cast("double").alias("value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), single_or("supplier", F.lit("MIXED_OR_UNKNOWN")).alias("supplier"), (F.min("day") != F.max("day")).alias("mixed_days"))


@query(f"WITH {_LEDGER_SQL} SELECT invoice FROM ledger GROUP BY invoice HAVING count(DISTINCT sheet) > 1")
def led_reused_invoices(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("invoice").agg(F.min("sheet").alias("a"), F.max("sheet").alias("b")).filter("a <> b").select("invoice")


@query(f"WITH {_LEDGER_SQL} SELECT n_name AS country, count(*) AS lines, CAST(sum(amount) AS DOUBLE) AS net FROM ledger JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def led_country(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("country"))
    # one row a supplier before the join
    return ledger(spark, sf_dir).groupBy("supplier").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("amount")).join(s, "supplier").groupBy("country").agg(F.sum("lines").cast("long").alias("lines"), F.sum("amount").cast("double").alias("net"))


@query("""WITH i AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS items, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS freight, count(*) AS lines, count(DISTINCT l_suppkey) AS sellers FROM lineitem GROUP BY 1)
SELECT o_orderstatus AS status, count(*) AS orders, count(*) FILTER (WHERE lines IS NULL) AS without_lines, count(*) FILTER (WHERE lines > 1) AS multi_item, count(*) FILTER (WHERE sellers > 1) AS multi_seller,
 count(*) FILTER (WHERE abs(o_totalprice - items - freight) > 0.01) AS off_cent, count(*) FILTER (WHERE abs(o_totalprice - items - freight) > 50000) AS off_far, CAST(sum(CAST(items AS DECIMAL(18,4))) AS DOUBLE) AS merchandise FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1""")
def rel_order_reconciliation(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(money("l_extendedprice").alias("items"), money(F.col("l_extendedprice") * F.col("l_tax")).alias("freight"), F.count(F.lit(1)).alias("lines"), F.count_distinct("l_suppkey").alias("sellers"))
    off = F.abs(F.col("o_totalprice") - F.col("items") - F.col("freight"))
    o = table(spark, sf_dir, "orders").join(i, "o_orderkey", "left")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("lines").isNull()).alias("without_lines"), F.count_if(F.col("lines") > 1).alias("multi_item"), F.count_if(F.col("sellers") > 1).alias("multi_seller"), F.count_if(off > 0.01).alias("off_cent"), F.count_if(off > 50000).alias("off_far"), money("items").alias("merchandise"))


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS orders, sum(days)::DOUBLE / count(*) AS mean_days, median(days) AS median_days, quantile_cont(days, 0.95) AS p95_days, count(*) FILTER (WHERE days > 1000) AS late, count(*) FILTER (WHERE days > 1000) / count(*) AS late_rate FROM d GROUP BY 1""")
def rel_delivery_days(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.datediff(F.max(F.to_date("l_shipdate")), F.min(F.to_date("o_orderdate"))).alias("days"))
    g = d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), (F.sum("days").cast("double") / F.count("days")).alias("mean_days"), F.median("days").alias("median_days"), F.percentile("days", F.lit(0.95)).alias("p95_days"), F.count_if(F.col("days") > 1000).alias("late"))
    return g.withColumn("late_rate", ratio("late", "orders"))


@query("""SELECT combination, count(*) AS orders FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ' + ' ORDER BY l_returnflag) AS combination FROM lineitem GROUP BY 1) GROUP BY 1""")
def rel_flag_combinations(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " + ").alias("combination"))
    return s.groupBy("combination").agg(F.count(F.lit(1)).alias("orders"))


@query("""SELECT sheet, row_number, quantity, CASE WHEN serial IS NULL THEN 'bad_date' WHEN quantity IS NULL THEN 'bad_quantity' END AS problem, TIMESTAMP '1899-12-30' + to_days(serial) AS at FROM (
 SELECT l_linenumber AS sheet, l_orderkey AS row_number, TRY_CAST(CASE WHEN l_partkey % 30 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS INTEGER) AS quantity, TRY_CAST(CASE WHEN l_partkey % 31 = 0 THEN '' ELSE CAST(30000 + l_partkey % 9000 AS VARCHAR) END AS INTEGER) AS serial FROM lineitem)""")
def rel_tolerant_parsing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = li.select(F.col("l_linenumber").alias("sheet"), F.col("l_orderkey").alias("row_number"), F.when(F.col("l_partkey") % 30 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("q"), F.when(F.col("l_partkey") % 31 == 0, "").otherwise((30000 + F.col("l_partkey") % 9000).cast("string")).alias("d"))
    out = text.withColumn("quantity", F.expr("try_cast(q as int)")).withColumn("serial", F.expr("try_cast(nullif(d, '') as int)"))
    problem = F.when(F.col("serial").isNull(), "bad_date").when(F.col("quantity").isNull(), "bad_quantity")
    return out.select("sheet", "row_number", "quantity", problem.alias("problem"), F.expr("timestamp_ntz '1899-12-30 00:00:00' + make_dt_interval(serial, 0, 0, 0)").alias("at"))


#: The ledger's registry: severity, classification, condition (the same in both dialects).
_REGISTRY = {
    "malformed_invoice_identity": ("ERROR", "DATA_DEFECT", "invoice is null or invoice in ('', 'C')"),
    "unparseable_quantity": ("ERROR", "DATA_DEFECT", "quantity is null"),
    "unparseable_price": ("ERROR", "DATA_DEFECT", "price is null"),
    "impossible_invoice_date": ("ERROR", "DATA_DEFECT", "day is null or day < date '1990-01-01'"),
    "missing_customer_id": ("INFO", "SOURCE_COMPLETENESS", "customer is null"),
    "missing_description": ("INFO", "SOURCE_COMPLETENESS", "description is null"),
    "zero_price_line": ("INFO", "BUSINESS_SOURCE_SEMANTICS", "price = 0"),
    "cancellation_invoice_line": ("INFO", "BUSINESS_SOURCE_SEMANTICS", "invoice like 'C%'"),
    "negative_quantity_line": ("INFO", "BUSINESS_SOURCE_SEMANTICS", "quantity < 0"),
    "non_c_negative_quantity_line": ("INFO", "BUSINESS_SOURCE_SEMANTICS", "quantity < 0 and invoice not like 'C%'"),
    "special_stock_code_line": ("INFO", "BUSINESS_SOURCE_SEMANTICS", f"stock_code in ({', '.join(repr(x) for x in _SPECIAL)})"),
    "positive_quantity_on_c_invoice": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "quantity > 0 and invoice like 'C%'"),
    "negative_price_line": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "price < 0"),
}
#: Of whole invoices; the sample is the invoice.
_MIXED = {
    "mixed_invoice_customer": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "customers > 1"),
    "mixed_invoice_customer_presence": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "known > 0 and known < line_count"),
    "mixed_invoice_country": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "countries > 1"),
    "mixed_invoice_timestamp": ("WARNING", "UNUSUAL_SOURCE_BEHAVIOR", "days > 1"),
}
_REPEATED = {"duplicate_source_row_identity": ("ERROR", "DATA_DEFECT", "copies > 1")}
_REG_LINE = {"line_id": "concat(l_orderkey, '-', l_linenumber)", "customer": "case when l_suppkey % 6 = 0 then null else l_suppkey % 20 end", "description": "case when l_partkey % 9 = 0 then null else 'd' end", "place": "l_suppkey % 2"}
_REG_SQL = f"""{_LEDGER_SQL.replace("FROM lineitem", ", " + ", ".join(f"{e} AS {n}" for n, e in _REG_LINE.items()) + " FROM lineitem", 1)},
invoices AS (SELECT concat(sheet, '/', invoice) AS line_id, count(DISTINCT customer) AS customers, count(customer) AS known, count(*) AS line_count, count(DISTINCT place) AS countries, count(DISTINCT day) AS days FROM ledger GROUP BY 1),
ids AS (SELECT line_id, count(*) AS copies FROM ledger GROUP BY 1),
hits AS ({' UNION ALL '.join(f"SELECT '{c}' AS code, line_id FROM {t} WHERE {cond}" for t, reg in (('ledger', _REGISTRY), ('invoices', _MIXED), ('ids', _REPEATED)) for c, (_, _, cond) in reg.items())}),
known_codes(code, severity, classification) AS (VALUES {', '.join(f"('{c}', '{a}', '{b}')" for c, (a, b, _) in {**_REGISTRY, **_MIXED, **_REPEATED}.items())})"""


@query(f"WITH {_REG_SQL} SELECT k.code, severity, classification, count(line_id) AS count, array_to_string(list_sort(coalesce(list(line_id ORDER BY line_id) FILTER (WHERE line_id IS NOT NULL), []))[:10], '|') AS sample FROM known_codes k LEFT JOIN hits USING (code) GROUP BY 1, 2, 3")
def led_registry(spark, sf_dir):
    """All codes of the ledger with their count and first ten ids."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in {**_LEDGER, **_REG_LINE}.items()])
    inv = raw.groupBy(F.concat("sheet", F.lit("/"), "invoice").alias("line_id")).agg(F.count_distinct("customer").alias("customers"), F.count("customer").alias("known"), F.count(F.lit(1)).alias("line_count"), F.count_distinct("place").alias("countries"), F.count_distinct("day").alias("days"))
    ids = raw.groupBy("line_id").agg(F.count(F.lit(1)).alias("copies"))
    parts = [Q.registry(df, "line_id", {c: (a, b, F.expr(e)) for c, (a, b, e) in reg.items()}) for df, reg in ((raw, _REGISTRY), (inv, _MIXED), (ids, _REPEATED))]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return x.select("code", "severity", "classification", "count", F.array_join("sample_ids", "|").alias("sample"))
