"""Ordered histories: incidents and lifecycles against plain folds, with few and with many pieces."""

import datetime as dt
import random

import pytest

from tradewind.operators import alerts
from tradewind.operators.ordered import carried, counted, pieces
from tradewind.plans import lifecycle

AT = dt.datetime
OCC = "key string, occurrence_id int, seen_at timestamp_ntz, severity string, evidence int, at timestamp_ntz, number int"
CMD = "key string, target string, by string, at timestamp_ntz, number int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def minute(n):
    return AT(2024, 1, 1) + dt.timedelta(minutes=n)


def plain_incidents(occurrences, commands):
    """One arrival after the other, as a service with a table of incidents and one of receipts would."""
    log = sorted({(o[5], o[6], 0, o) for o in occurrences} | {(c[3], c[4], 1, c) for c in commands}, key=lambda x: (x[0], x[2], x[1]))
    receipts, active, made = {}, {}, {}
    rank = alerts.SEVERITY
    for at, number, turn, x in log:
        if turn == 0:
            key, oid, seen, severity, evidence = x[:5]
            if oid in receipts:
                k, n = receipts[oid]
                if k != key or made[k, n]["status"] == "RESOLVED":
                    continue
                i = made[k, n]
                i["replays"] += 1
            else:
                n = active.setdefault(key, sum(k == key for k, _ in made))
                receipts[oid] = key, n
                i = made.setdefault((key, n), {"status": "OPEN", "occ": 0, "replays": 0, "rank": 0, "first": seen, "last": seen, "ev": (seen, at, number, evidence), "ack": (None, None), "res": (None, None)})
                i["occ"] += 1
            i["rank"] = max(i["rank"], rank[severity])
            i["first"], i["last"] = min(i["first"], seen), max(i["last"], seen)
            i["ev"] = max(i["ev"], (seen, at, number, evidence))
        else:
            key, target, by = x[:3]
            if target not in ("ACKNOWLEDGED", "RESOLVED") or not (by or "").strip() or key not in active:
                continue
            i = made[key, active[key]]
            if (i["status"], target) not in alerts.TRANSITIONS:
                continue
            i["status"], i["ack" if target == "ACKNOWLEDGED" else "res"] = target, (at, by.strip())
            if target == "RESOLVED":
                del active[key]
    names = list(rank)
    return sorted(((k, n, i["status"], i["occ"], i["replays"], names[i["rank"]], i["first"], i["last"], i["ev"][3], *i["ack"], *i["res"]) for (k, n), i in made.items()), key=repr)


def history(r, n, keys):
    occ, cmd = [], []
    for number in range(n):
        key, at = r.choice(keys), minute(r.randrange(n))
        if r.random() < 0.7:
            again = r.choice(occ) if occ and r.random() < 0.3 else None
            oid, key = (again[1], again[0] if r.random() < 0.9 else key) if again else (number, key)
            occ.append((key, oid, minute(r.randrange(60)), r.choice(list(alerts.SEVERITY)), r.randrange(100), at, number))
        else:
            cmd.append((key, r.choice(["ACKNOWLEDGED", "RESOLVED", "RESOLVED", "OPEN"]), r.choice(["a", " b ", "", None]), at, number))
    return occ, cmd


@pytest.mark.parametrize("parts", [1, 7])
def test_incidents_are_those_of_a_service(spark, parts, monkeypatch):
    monkeypatch.setattr(alerts, "pieces", lambda df, keys, order, label: pieces(df.repartitionByRange(parts, *keys, *order), keys, order, label) if parts == 1 else cut(spark, df, keys, order, parts))
    r = random.Random(3)
    occ, cmd = history(r, 600, ["a", "a", "a", "b", "c"])
    got = rows(alerts.incident_states(spark.createDataFrame(occ, OCC), spark.createDataFrame(cmd, CMD)))
    assert got == plain_incidents(occ, cmd) and len(got) > 30 and sum(x[4] for x in got) > 5


def cut(spark, df, keys, order, parts):
    """Pieces that surely part a key: by place in the whole order, not by size."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tradewind.session import landed

    return landed(df.withColumn("piece", F.ntile(parts).over(Window.orderBy(*keys, *order)) - 1), "cut")


def test_replays_change_nothing(spark):
    r = random.Random(4)
    occ, cmd = history(r, 200, ["a", "b"])
    once = rows(alerts.incident_states(spark.createDataFrame(occ, OCC), spark.createDataFrame(cmd, CMD)))
    twice = rows(alerts.incident_states(spark.createDataFrame(occ + occ, OCC), spark.createDataFrame(cmd, CMD)))
    assert once == twice
    odd = [(None, 1, minute(1), "INFO", 1, minute(1), 1), ("a", None, minute(1), "INFO", 1, minute(1), 1), ("a", 5, None, None, None, minute(1), 1), ("a", 6, minute(1), "INFO", 1, None, 1)]
    got = alerts.incident_states(spark.createDataFrame(odd, OCC), spark.createDataFrame([("a", "RESOLVED", "x", None, 1)], CMD)).collect()
    assert [(x.key, x.incident, x.status, x.occurrences, x.severity, x.evidence) for x in got] == [("a", 0, "OPEN", 1, None, None)]
    assert alerts.incident_states(spark.createDataFrame([], OCC), spark.createDataFrame([], CMD)).count() == 0


def test_running_values_over_pieces(spark):
    data = [("k", i, i % 3 if i % 4 else None) for i in range(40)] + [(None, i, 1) for i in range(5)]
    from pyspark.sql import functions as F

    df = cut(spark, spark.createDataFrame(data, "k string, i int, v int"), ["k"], ["i"], 6)
    x = counted(carried(df, ["k"], ["i"], F.col("v"), "last"), ["k"], ["i"], F.col("v"), "sum")
    got = {(r.k, r.i): (r.last, r.sum) for r in x.collect()}
    for k in ("k", None):
        last, total = None, 0
        for _, i, v in (d for d in data if d[0] == k):
            assert got[k, i] == (last, total)
            last, total = v if v is not None else last, total + (v or 0)


def plain_lifecycle(events):
    """(previous, current, verdict) of each event in order."""
    moves, state, out = set(lifecycle.allowed_pairs()), None, []
    for _, _, status, correction in sorted(events, key=lambda e: (e[1], e[2] or "", e[3] or False)):
        before = state
        if status not in lifecycle.STATUSES:
            verdict = "unknown"
        elif before == status:
            verdict = "repeated"
        elif before is None or correction or (before, status) in moves:
            verdict, state = "corrected" if correction and before else "entered", status
        else:
            verdict = "refused"
        out.append((before, state, verdict))
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_lifecycles(spark, parts, monkeypatch):
    from tradewind.operators import ordered

    monkeypatch.setattr(ordered, "pieces", lambda df, keys, order, label: cut(spark, df, keys, order, parts))
    r = random.Random(8)
    data = [(k, i, r.choice([*lifecycle.STATUSES, "LOST", None]), r.choice([None, False, False, True])) for k in ("long", "b", None) for i in range(300 if k == "long" else 25)]
    df = spark.createDataFrame(data, "k string, i int, status string, correction boolean")
    got = {(x.k, x.i): (x.previous, x.current, x.verdict) for x in lifecycle.lifecycles(df, ["k"], ["i"]).collect()}
    for k in ("long", "b", None):
        own = [d for d in data if d[0] == k]
        assert [got[k, d[1]] for d in own] == plain_lifecycle(own)
    assert {v for _, _, v in got.values()} == {"entered", "repeated", "corrected", "refused", "unknown"}
    assert lifecycle.lifecycles(df.limit(0), ["k"], ["i"]).count() == 0


def test_moves():
    moves = set(lifecycle.allowed_pairs())
    assert len(lifecycle.STATUSES) == 20 and all((a, a) in moves for a in lifecycle.STATUSES)
    assert ("CREATED", "REMITTED") in moves and ("SHIPPED", "CREATED") not in moves and ("CANCELLED", "SHIPPED") not in moves
    assert ("REFUSED", "DELIVERED") in moves and ("REFUSED", "UNREACHABLE") not in moves and ("IN_TRANSIT", "UNREACHABLE") in moves
    assert ("DELIVERED", "SHIPPED") not in moves and ("DELIVERED", "REMITTED") in moves and ("UNREACHABLE", "CONFIRMED") not in moves
