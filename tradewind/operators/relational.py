"""Relational operators beyond the built-in ones, as compositions that Catalyst can plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ordered import counted, greatest_before, pieces
from tradewind.session import landed


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under order (say desc_nulls_last columns with a unique last one)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered; Spark cuts groups at k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def with_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """df with aggregates of its key beside each row: summed up before the shuffle and joined, so no key is one task. Null keys are a key."""
    made = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return df.alias("l").join(made.alias("t"), _same("l", "t", keys)).select("l.*", *[F.col(f"t.{n}") for n in totals])


def others(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """df with {new: column} of what the other rows of the same key add up to: total less own, no self join.

    A null counts as nought in the total and makes the row's own result null.
    """
    totals = with_totals(df, keys, {f"__{n}": F.sum(c) for n, c in columns.items()})
    return totals.select(*df.columns, *[(F.col(f"__{n}") - F.col(c)).alias(n) for n, c in columns.items()])


def unpivot(df: DataFrame, keys: Sequence[str], rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """A row of (keys, names) for each of rows; entries are columns or literals."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.array(*[F.struct(*[lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])
    return df.select(*keys, F.inline(made))


def effective(facts: DataFrame, dated: DataFrame, on: Sequence[str], day: str, specificity: Column, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As-of join: each fact with the one dated row in force on its day that fits most specifically.

    dated has valid_from, valid_to (null: open) beside the equality columns on; specificity is
    nought where a row doesn't fit. keys tell facts apart; order settles equals. The equality
    columns shuffle the join, the interval is a filter inside it. Facts without a row keep nulls.
    """
    f, d = facts.alias("f"), dated.alias("d")
    cond = [F.col(f"f.{c}") == F.col(f"d.{c}") for c in on]
    inside = (F.col(f"f.{day}") >= F.col("d.valid_from")) & (F.col(f"f.{day}") <= F.coalesce(F.col("d.valid_to"), F.col(f"f.{day}")))
    met = f.join(d.withColumn("__there", F.lit(True)).alias("d"), [*cond, inside], "left").withColumn("__fit", F.when(F.col("__there"), specificity).otherwise(0))
    best = Window.partitionBy(*[F.col(f"f.{k}") for k in keys]).orderBy(F.desc("__fit"), *order)
    own = [c for c in dated.columns if c not in on]
    return met.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select("f.*", *[F.when(F.col("__fit") > 0, F.col(f"d.{c}")).alias(c) for c in own], F.col("__fit").alias("specificity"))


def allocate(links: DataFrame, amounts: dict[str, str], weight: str, over: Sequence[str]) -> DataFrame:
    """links with {new: amount} shared out over the links of a key by weight; all weights nought or null: in equal parts.

    Weights are added up as decimals, so shares don't depend on the order of rows; a null amount
    or weight has a null share.
    """
    met = with_totals(links, over, {"__total": F.sum(F.col(weight).cast("decimal(28,8)")).cast("double"), "__n": F.count(F.lit(1))})
    share = lambda c: F.when(F.col("__total") != 0, F.col(c) * F.col(weight) / F.nullif("__total", F.lit(0.0))).otherwise(F.col(c) / F.col("__n"))
    return met.select(*links.columns, *[share(c).alias(n) for n, c in amounts.items()])


def share_out(links: DataFrame, per_key: DataFrame, amounts: dict[str, str], weight: str, over: Sequence[str], how: str = "left") -> DataFrame:
    """allocate() of amounts that stand once a key, in per_key: they meet the keys' totals, so the links are dealt for one join.

    how: left keeps links whose key has no amount, inner drops them. Amounts of a null key are none.
    """
    made = links.groupBy(*over).agg(F.sum(F.col(weight).cast("decimal(28,8)")).cast("double").alias("__total"), F.count(F.lit(1)).alias("__n")).join(per_key, list(over), how)
    given = [c for c in per_key.columns if c not in over]
    share = lambda c: F.when(F.col("__total") != 0, F.col(c) * F.col(weight) / F.nullif("__total", F.lit(0.0))).otherwise(F.col(c) / F.col("__n"))
    return links.alias("l").join(made.alias("t"), _same("l", "t", over)).select("l.*", *[F.col(f"t.{c}") for c in given], *[share(c).alias(n) for n, c in amounts.items()])


def overlapping(df: DataFrame, on: Sequence[str], key: str, start: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """Pairs (on, left_id, right_id) of intervals of the same subject that overlap; a null end is open."""
    a, b = df.alias("a"), df.alias("b")
    open_end = F.lit("9999-12-31").cast("date")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [F.col(f"a.{key}") < F.col(f"b.{key}"), F.col(f"a.{start}") <= F.coalesce(F.col(f"b.{stop}"), open_end), F.col(f"b.{start}") <= F.coalesce(F.col(f"a.{stop}"), open_end)]
    return a.join(b, cond).select(*[F.col(f"a.{c}") for c in on], F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id"))


def conflicts(df: DataFrame, on: Sequence[str], key: str, start: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """(on, key, start, stop, other): intervals that overlap one of another record that begins before them (or with them, with a smaller key), and the one of these that lasts longest.

    A sweep: in the order of their starts each interval meets the furthest end so far, so a
    subject with very many intervals costs a sort and no pairs, and its sweep is cut into pieces.
    Intervals of one record that touch or overlap are one first, so revisions don't conflict among
    themselves. Bounds are days, both included; a null end is open, a null start or key is in no
    conflict, nor is an interval that ends before it starts; null subjects match.
    """
    far = F.lit("9999-12-31").cast("date")
    x = df.select(*on, key, F.col(start).alias("__from"), F.coalesce(F.col(stop), far).alias("__to")).filter(F.col(key).isNotNull() & F.col(start).isNotNull()).filter("__from <= __to")
    own = [*on, key]
    x = greatest_before(pieces(x, own, ["__from", "__to"], "own-intervals"), own, ["__from", "__to"], F.col("__to"), "__reach")
    later = F.when(F.col("__reach").isNull() | (F.col("__from") > F.col("__reach")), 0).otherwise(1)
    # of equal intervals the one that begins a run comes first, however they are sorted again; they share a piece, so the pieces stay
    x = landed(x.withColumn("__later", later), "own-starts")
    x = counted(x, own, ["__from", "__to", "__later"], 1 - F.col("__later"), "__n").withColumn("__n", F.col("__n") + 1 - F.col("__later"))
    whole = landed(x.groupBy(*own, "__n").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to")).drop("__n"), "whole-intervals")
    order = ["__from", key, "__to"]
    x = greatest_before(pieces(whole, on, order, "intervals"), on, order, F.struct("__to", key), "__last").filter(F.col("__last.__to") >= F.col("__from"))
    return x.select(*on, key, F.col("__from").alias(start), F.nullif("__to", far).alias(stop), F.col(f"__last.{key}").alias("other"))


def duplicate_excess(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (excess): rows beyond the first of each key, null keys included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    return child.select(F.col(key).alias("orphan")).filter("orphan is not null").join(parent.select(F.col(parent_key).alias("orphan")), "orphan", "left_anti").distinct()


def single_or(c: str, otherwise: Column) -> Column:
    """The one distinct value of a group, else otherwise; min and max, no set is gathered."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(otherwise)
