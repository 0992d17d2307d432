"""Overlaps by a sweep against all pairs, and on one subject with very many intervals."""

import datetime as dt
import random
import time

from tradewind.operators import relational

DAY = dt.date(2024, 1, 1)


def plain(rows):
    """(subject, record) that overlap an interval of another record which begins before them."""
    out = set()
    far = dt.date(9999, 12, 31)
    good = [(s, k, a, b or far) for s, k, a, b in rows if k is not None and a is not None and a <= (b or far)]
    for s, k, a, b in good:
        for t, m, c, d in good:
            if s == t and k != m and c <= b and a <= d:
                out.add((s, max((a, k), (c, m))[1]))
    return out


def test_conflicts(spark):
    r = random.Random(6)
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = []
    for s in ("a", "b", None, "lone"):
        for _ in range(60 if s != "lone" else 1):
            a = r.randrange(400)
            rows.append((s, r.randrange(40), day(a), r.choice([None] if r.random() < 0.02 else [day(a + r.randrange(6))])))
    rows += [("a", None, day(1), day(900)), ("a", 50, None, day(900)), ("a", 51, day(9), day(3)), ("c", 1, day(1), day(5)), ("c", 1, day(3), day(9)), ("c", 2, day(9), None), ("c", 3, day(9), None)]
    df = spark.createDataFrame(rows, "s string, k int, valid_from date, valid_to date").repartition(7)
    got = relational.conflicts(df, ["s"], "k").collect()
    # merged records begin where their first revision does, so whole records are compared
    assert {(x.s, x.k) for x in got} >= {("c", 2), ("c", 3)} and not any(x.s == "lone" or (x.s, x.k) == ("c", 1) for x in got)
    assert {frozenset((x.k, x.other)) for x in got if x.s == "c"} == {frozenset((2, 1)), frozenset((3, 2))}
    wanted = plain(rows)
    involved = {(x.s, x.k) for x in got} | {(x.s, x.other) for x in got}
    assert {s for s, _ in wanted} == {x.s for x in got} and wanted <= involved
    for x in got:
        assert x.k != x.other
    assert relational.conflicts(df.limit(0), ["s"], "k").count() == 0


def test_one_subject_with_very_many_intervals(spark):
    n = 100_000
    df = spark.range(n).selectExpr("1 as s", "id as k", "date_add(date '2000-01-01', cast(id % 20000 as int)) as valid_from", "date_add(date '2000-01-01', cast(id % 20000 as int)) as valid_to")
    began = time.time()
    assert relational.conflicts(df, ["s"], "k").count() == n - 20_000  # five a day
    assert time.time() - began < 90
