"""Evidence for decisions: facts with unique ids, blockers that lower a priority, and answers held against what they may say.

Null facts are left out; a forbidden key never becomes a fact; rows that repeat are one
evidence; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.plans import decisions as dec
from tradewind.plans import diagnostics as dx
from tradewind.plans.registry import query, table
from tradewind.plans.texts import CAUSAL, EMAIL

#: Keys that no evidence may carry.
FORBIDDEN = ["phone", "email", "name", "cost"]


def evidence(df: DataFrame, kind: str, id_parts: list[str], scope: Column, facts: list[str]) -> DataFrame:
    """(evidence_id, type, scope, facts): one row for each id, facts as a map of allowed keys to numbers."""
    keep = [c for c in facts if c not in FORBIDDEN]
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in keep]), lambda p: p["v"].isNotNull()))
    name = F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in id_parts])
    return df.select(name.alias("evidence_id"), F.lit(kind).alias("type"), scope.alias("scope"), pairs.alias("facts")).dropDuplicates(["evidence_id"])


_STAGE_FACTS, _CAMPAIGN_FACTS = ["observed", "denominator", "rate"], ["shipped", "delivered", "delivery_rate", "peer_delivery_rate", "cost"]


def _facts_sql(kind: str, name: str, scope: str, facts: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {name} AS evidence_id, '{kind}' AS type, {scope} AS scope, '{c}' AS fact, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for c in facts if c not in FORBIDDEN)


@query(f"""WITH {dx._CAMP}, {dx._LEAK_SQL}, {dx._DIAG_SQL} {_facts_sql('leakage', "concat('leakage:', business, ':', stage)", "concat('business:', business)", _STAGE_FACTS, 'leak')}
UNION ALL {_facts_sql('campaign', "concat('campaign:', campaign)", "concat('business:', business)", _CAMPAIGN_FACTS, 'diag')}""")
def ev_context(spark, sf_dir):
    c = dx.campaigns(spark, sf_dir)
    scope = F.concat(F.lit("business:"), F.col("business").cast("string"))
    rows = evidence(dx.leakage(c), "leakage", ["business", "stage"], scope, _STAGE_FACTS).unionByName(evidence(dx.diagnose(c), "campaign", ["campaign"], scope, _CAMPAIGN_FACTS))
    return rows.select("evidence_id", "type", "scope", F.explode("facts").alias("fact", "value"))


#: What a blocked requirement means for a kind of opportunity; what isn't named is irrelevant to it.
RELEVANCE = [("COST", "cost", "SCORING"), ("DELIVERY", "sample", "SCORING"), ("RETURNS", "sample", "SCORING"), ("DELIVERY", "cost", "CONTEXTUAL"), ("RETURNS", "cost", "CONTEXTUAL")]
LOWER = {"HIGH": "MEDIUM", "MEDIUM": "LOW"}


def lowered(opps: DataFrame) -> DataFrame:
    """Opportunities with scoring and contextual blockers counted; one that scores lowers the priority a band."""
    relevance = opps.sparkSession.createDataFrame(RELEVANCE, "kind string, requirement string, relevance string")
    met = dec.resolve(opps).join(relevance, ["kind", "requirement"], "left")
    blocked = F.col("state").isin("BLOCKED", "MISSING")
    g = met.groupBy("campaign", "kind", "priority").agg(F.count_if(blocked & (F.col("relevance") == "SCORING")).alias("scoring"), F.count_if(blocked & (F.col("relevance") == "CONTEXTUAL")).alias("contextual"))
    after = F.when(F.col("scoring") == 0, F.col("priority"))
    for a, b in LOWER.items():
        after = after.when(F.col("priority") == a, b)
    return g.withColumn("priority_after", after.otherwise(F.col("priority")))


_RELEVANCE_SQL = ", ".join(str(r) for r in RELEVANCE)


@query(f"""WITH {dx._CAMP}, {dx._DIAG_SQL}, {dec._OPP_SQL}, {dec._RESOLVED_SQL}, rel(kind, requirement, relevance) AS (VALUES {_RELEVANCE_SQL}),
b AS (SELECT v.campaign, v.kind, count(*) FILTER (WHERE state IN ('BLOCKED', 'MISSING') AND relevance = 'SCORING') AS scoring, count(*) FILTER (WHERE state IN ('BLOCKED', 'MISSING') AND relevance = 'CONTEXTUAL') AS contextual
FROM resolved v LEFT JOIN rel USING (kind, requirement) GROUP BY 1, 2)
SELECT campaign, kind, priority, scoring, contextual, CASE WHEN scoring = 0 THEN priority WHEN priority = 'HIGH' THEN 'MEDIUM' WHEN priority = 'MEDIUM' THEN 'LOW' ELSE priority END AS priority_after FROM b JOIN ranked USING (campaign, kind)""")
def ev_blockers(spark, sf_dir):
    return lowered(dec.opportunities(dx.diagnose(dx.campaigns(spark, sf_dir))))


def validated(answers: DataFrame, text: str = "text", allowed: str = "allowed") -> DataFrame:
    """answers with codes: numbers that aren't among the allowed ones, causal claims, addresses; a null text is empty.

    Numbers are compared as they are written, each once.
    """
    said = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    strange = F.size(F.array_except(said, F.coalesce(F.col(allowed), F.array().cast("array<string>"))))
    codes = F.array_compact(F.array(F.when(strange > 0, F.lit("UNGROUNDED_NUMBER")), F.when(F.col(text).rlike(CAUSAL), F.lit("CAUSAL_CLAIM")), F.when(F.col(text).rlike(EMAIL), F.lit("PERSONAL_DATA"))))
    return answers.withColumn("strange_numbers", strange).withColumn("codes", F.array_join(codes, "|"))


@query(rf"""WITH a AS (SELECT doc_id, text, [CAST(doc_id AS VARCHAR), '1', '2', '3', '10'] AS allowed FROM documents),
n AS (SELECT doc_id, text, len(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '\d+(?:\.\d+)?')), lambda x: NOT list_contains(allowed, x))) AS strange_numbers FROM a)
SELECT doc_id, strange_numbers, concat_ws('|', CASE WHEN strange_numbers > 0 THEN 'UNGROUNDED_NUMBER' END, CASE WHEN regexp_matches(text, '{CAUSAL}') THEN 'CAUSAL_CLAIM' END, CASE WHEN regexp_matches(text, '{EMAIL}') THEN 'PERSONAL_DATA' END) AS codes FROM n""")
def ev_validated(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.col("doc_id").cast("string"), *map(F.lit, ("1", "2", "3", "10"))).alias("allowed"))
    return validated(answers).select("doc_id", F.col("strange_numbers").cast("long").alias("strange_numbers"), "codes")
