"""Alert lifecycle as folds over occurrences: incidents, due deliveries, what retention may delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ordered import carried, counted, pieces
from tradewind.session import landed

SEVERITY = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}


def incident_key(version: str, *parts: str) -> Column:
    """SHA-256 of the parts as canonical JSON (an array in fixed order) under a version."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), *[F.col(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def numbered(occurrences: DataFrame, key: str, gap_days: int, seen: str = "seen_at") -> DataFrame:
    """occurrences with the number of their incident: days of a key at most gap_days apart are one, a longer pause begins another.

    Days decide, so the window runs over a row for each day of a key, whatever the number of its
    occurrences. Occurrences without a time belong to the first incident.
    """
    days = occurrences.select(F.col(key).alias("__key"), F.to_date(seen).alias("__day")).distinct()
    w = Window.partitionBy("__key").orderBy("__day")
    opened = F.coalesce((F.datediff("__day", F.lag("__day").over(w)) > gap_days).cast("int"), F.lit(0))
    days = days.withColumn("__new", opened).select("__key", "__day", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("incident"))
    met = occurrences.join(days, F.col(key).eqNullSafe(F.col("__key")) & F.to_date(seen).eqNullSafe(F.col("__day")))
    return met.select(*occurrences.columns, "incident")


def fold(occurrences: DataFrame, key: str, gap_days: int, seen: str = "seen_at", severity: str = "severity", evidence: str = "evidence") -> DataFrame:
    """Incidents, see numbered(): the worst severity, the latest evidence, the first and last time and the distinct occurrences."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col(severity)]
    return numbered(occurrences, key, gap_days, seen).groupBy(key, "incident").agg(F.count_distinct("occurrence_id").alias("occurrences"), F.max(rank).alias("severity_rank"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.max(F.struct(seen, "occurrence_id", evidence))[evidence].alias("evidence"))


def due(incidents: DataFrame, attempts: DataFrame, keys: Sequence[str], now: str, recur: int, escalate_days: int, most: int) -> DataFrame:
    """Deliveries due: INITIAL without any, RECURRENCE from recur occurrences on, ESCALATION after escalate_days open; each until most attempts failed."""
    last = attempts.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("tries"), F.bool_or("ok").alias("done"))
    kinds = F.array(
        F.struct(F.lit("INITIAL").alias("kind"), F.lit(True).alias("wanted")),
        F.struct(F.lit("RECURRENCE").alias("kind"), (F.col("occurrences") >= recur).alias("wanted")),
        F.struct(F.lit("ESCALATION").alias("kind"), (F.datediff(F.lit(now).cast("date"), F.to_date("first_seen")) >= escalate_days).alias("wanted")),
    )
    wanted = incidents.select(*keys, F.inline(kinds)).filter("wanted").drop("wanted")
    return wanted.join(last, [*keys, "kind"], "left").filter((~F.coalesce("done", F.lit(False))) & (F.coalesce("tries", F.lit(0)) < most)).select(*keys, "kind", F.coalesce("tries", F.lit(0)).alias("tries"))


#: Transitions that an alert may make.
TRANSITIONS = [("OPEN", "ACKNOWLEDGED"), ("OPEN", "RESOLVED"), ("ACKNOWLEDGED", "RESOLVED")]


def audit(commands: DataFrame) -> DataFrame:
    """(alert_id, previous_status, new_status, changed_at, changed_by): the transitions that commands made, an alert being OPEN at first.

    commands: (alert_id, target, at, number, by), in order of (at, number). Only TRANSITIONS are
    made: the first RESOLVED, and the first ACKNOWLEDGED if it came before; all other commands,
    those of nobody and those without a time are refused and leave no row. Minima decide, so an
    alert with very many commands is no large group.
    """
    named = commands.filter(F.col("target").isin("ACKNOWLEDGED", "RESOLVED") & F.col("at").isNotNull() & (F.length(F.trim("by")) > 0))
    first = lambda s: F.min(F.when(F.col("target") == s, F.struct("at", "number", F.trim("by").alias("by"))))
    x = named.groupBy("alert_id").agg(first("ACKNOWLEDGED").alias("a"), first("RESOLVED").alias("r"))
    x = x.withColumn("a", F.when(F.col("r").isNull() | (F.struct("a.at", "a.number") < F.struct("r.at", "r.number")), F.col("a")))
    row = lambda before, after, c: F.struct(before.alias("previous_status"), F.lit(after).alias("new_status"), F.col(f"{c}.at").alias("changed_at"), F.col(f"{c}.by").alias("changed_by"))
    before = F.when(F.col("a").isNotNull(), "ACKNOWLEDGED").otherwise("OPEN")
    rows = F.array_compact(F.array(F.when(F.col("a").isNotNull(), row(F.lit("OPEN"), "ACKNOWLEDGED", "a")), F.when(F.col("r").isNotNull(), row(before, "RESOLVED", "r"))))
    return x.select("alert_id", F.inline(rows))


def claims(candidates: DataFrame, attempts: DataFrame, now: str, most: int, wait_minutes: int) -> DataFrame:
    """(key, attempt): the next attempt of each candidate key that may be claimed now.

    attempts: (key, attempt, status, completed_at). The last attempt decides: none, or one that
    failed at least wait_minutes ago and wasn't the last of most. One writer appends the claims, so
    (key, attempt) stays unique; there are no locks. Null keys claim nothing.
    """
    last = attempts.groupBy("key").agg(F.max(F.struct("attempt", "completed_at", "status")).alias("last"))
    met = candidates.select("key").filter("key is not null").distinct().join(last, "key", "left")
    waited = F.col("last.completed_at") + F.expr(f"interval {int(wait_minutes)} minutes") <= F.lit(now).cast("timestamp_ntz")
    free = F.col("last").isNull() | ((F.col("last.status") == "FAILED") & F.coalesce(waited, F.lit(False)))
    return met.withColumn("number", F.coalesce(F.col("last.attempt"), F.lit(0)) + 1).filter(free & (F.col("number") <= most)).select("key", F.col("number").alias("attempt"))


def consolidated(legacy: DataFrame, key: str = "incident_key") -> DataFrame:
    """(key, alert_id, first_seen, last_seen, occurrences, severity, resolved): alerts from before incident keys, one active alert a key.

    The oldest (by created_at, alert_id) stays active, the others are resolved into it and count as
    its occurrences; the severity is CRITICAL if any was, WARNING if several met, else its own.
    """
    oldest = F.min(F.struct("created_at", "alert_id", "severity"))
    g = legacy.groupBy(key).agg(oldest.alias("o"), F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.max((F.col("severity") == "CRITICAL").cast("int")).alias("worst"))
    severity = F.when(F.col("worst") == 1, "CRITICAL").when(F.col("occurrences") > 1, "WARNING").otherwise(F.col("o.severity"))
    return g.select(key, F.col("o.alert_id").alias("alert_id"), F.col("o.created_at").alias("first_seen"), "last_seen", "occurrences", severity.alias("severity"), (F.col("occurrences") - 1).alias("resolved"))


def incident_states(occurrences: DataFrame, commands: DataFrame) -> DataFrame:
    """Incidents by one ordered fold over occurrences and commands: a key has one active incident at most, RESOLVED ends it, the next new occurrence opens another.

    occurrences: (key, occurrence_id, seen_at, severity, evidence, at, number), commands: (key,
    target, by, at, number); at and number are the order of arrival, an occurrence before a
    command of the same. The first arrival of an occurrence id is its receipt. A replay counts
    nothing: it may raise the severity and bring newer evidence while the receipt's incident is
    active, and does nothing once that is resolved; under another key than the receipt's it is
    refused. Commands need an active incident and somebody who gives them; the first
    ACKNOWLEDGED of an incident holds. Refused ones leave no trace. The latest seen_at brings the
    evidence, of equal ones the later arrival. Rows without key, id or arrival are refused;
    arrivals that repeat whole are one. A key's history is cut into pieces, see ordered.py.

    (key, incident, status, occurrences, replays, severity, first_seen, last_seen, evidence,
    acknowledged_at, acknowledged_by, resolved_at, resolved_by)
    """
    arrival = ["key", "occurrence_id", "at", "number"]
    given = occurrences.filter(F.col("key").isNotNull() & F.col("occurrence_id").isNotNull() & F.col("at").isNotNull() & F.col("number").isNotNull())
    once = given.groupBy(*arrival).agg(F.max(F.struct("seen_at", "severity", "evidence")).alias("x")).select(*arrival, "x.*")
    receipts = given.groupBy("occurrence_id").agg(F.min(F.struct("at", "number", "key")).alias("receipt"))
    o = once.join(receipts, "occurrence_id").filter(F.col("key") == F.col("receipt.key"))
    kind = F.when((F.col("at") == F.col("receipt.at")) & (F.col("number") == F.col("receipt.number")), "new").otherwise("replay")
    c = commands.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("number").isNotNull() & F.col("target").isin("ACKNOWLEDGED", "RESOLVED") & (F.length(F.trim("by")) > 0))
    log = o.select("key", "at", F.lit(0).alias("turn"), "number", kind.alias("kind"), "occurrence_id", "seen_at", "severity", "evidence").unionByName(
        c.select("key", "at", F.lit(1).alias("turn"), "number", F.col("target").alias("kind"), F.trim("by").alias("by")), allowMissingColumns=True
    )
    order = ["at", "turn", "number", "kind", "occurrence_id", "by"]
    rows = pieces(log, ["key"], order, "incident-log")
    turns = F.when(F.col("kind").isin("new", "RESOLVED"), F.col("kind"))
    rows = carried(rows, ["key"], order, turns, "last_turn")
    active = F.coalesce(F.col("last_turn") == "new", F.lit(False))
    rows = rows.withColumn("active", active).withColumn("ends", (active & (F.col("kind") == "RESOLVED")).cast("long"))
    rows = landed(counted(rows, ["key"], order, F.col("ends"), "incident"), "incident-rows")
    first = rows.filter("kind = 'new'").select("occurrence_id", F.col("incident").alias("own"))
    replays = rows.filter("kind = 'replay'").join(first, "occurrence_id").filter("incident = own").drop("own")
    used = rows.filter("kind = 'new' or active and kind in ('ACKNOWLEDGED', 'RESOLVED')").unionByName(replays)
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    seen = F.col("kind").isin("new", "replay")
    act = lambda k: F.min(F.when(F.col("kind") == k, F.struct("at", "number", "by")))
    g = used.groupBy("key", "incident").agg(
        F.count_if(F.col("kind") == "new").alias("occurrences"), F.count_if(F.col("kind") == "replay").alias("replays"), F.max(rank).alias("rank"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max(F.when(seen, F.struct("seen_at", "at", "number", "evidence")))["evidence"].alias("evidence"),
        act("ACKNOWLEDGED").alias("a"), act("RESOLVED").alias("r"),
    )
    status = F.when(F.col("r").isNotNull(), "RESOLVED").when(F.col("a").isNotNull(), "ACKNOWLEDGED").otherwise("OPEN")
    names = F.when(F.col("rank").isNotNull(), F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce("rank", F.lit(0)) + 1))
    return g.select(
        "key", "incident", status.alias("status"), "occurrences", "replays", names.alias("severity"), "first_seen", "last_seen", "evidence",
        F.col("a.at").alias("acknowledged_at"), F.col("a.by").alias("acknowledged_by"), F.col("r.at").alias("resolved_at"), F.col("r.by").alias("resolved_by"),
    )
