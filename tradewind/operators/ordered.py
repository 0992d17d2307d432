"""Folds over ordered histories of keys, cut into pieces so that one very long history isn't one task.

Rows are range partitioned by key and order and written; a piece is what one task wrote. A fold
then takes three steps: each piece alone, what it does to whatever came before it (a few values
a key and piece, or a map from state to state), and the rows again with what their piece starts
with. The windows and loops below never hold more than a piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import landed, ship

#: Rows of a key's history that one task may sort.
LONG = 100_000


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "pieces") -> DataFrame:
    """df, written in ranges of keys and order, with the number of each row's range as piece; later ranges have greater numbers."""
    return landed(df.repartitionByRange(*keys, *order).withColumn("piece", F.spark_partition_id()), label)


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of pieces() with the last value that isn't null of the same keys before them; null if there is none."""
    inside = Window.partitionBy(*keys, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = landed(rows.groupBy(*keys, "piece").agg(F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("__value"))))["__value"].alias("__last")), "piece-ends")
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).select(*keys, F.col("piece"), "__before")
    met = join_pieces(rows.withColumn("__inside", F.last(value, ignorenulls=True).over(inside)), starts, keys)
    return met.withColumn(name, F.coalesce("__inside", "__before")).drop("__inside", "__before")


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the last value that isn't null of the same keys before them, in order; only histories of more than LONG rows are cut into pieces.

    Others are dealt once, by their keys, and nothing of them is written.
    """
    own = F.struct(*[F.col(k) for k in keys])  # never null
    spans = landed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LONG).select(own.alias("__long")), "long-keys")
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    short = rows.join(spans, own == F.col("__long"), "left_anti").withColumn(name, F.last(value, ignorenulls=True).over(before))
    if spans.isEmpty():
        return short
    long = rows.join(spans, own == F.col("__long"), "left_semi")
    return short.unionByName(carried(pieces(long, keys, order, "histories"), keys, order, F.col(value), name).drop("piece"))


def _running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, fold, both) -> DataFrame:
    """rows of pieces() with fold (an aggregate that may be applied to its own results) of value over the same keys before them."""
    inside = Window.partitionBy(*keys, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_pieces = landed(rows.groupBy(*keys, "piece").agg(fold(value).alias("__of_piece")), "piece-values")
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_pieces.withColumn("__before", fold(F.col("__of_piece")).over(before)).select(*keys, F.col("piece"), "__before")
    met = join_pieces(rows.withColumn("__inside", fold(value).over(inside)), starts, keys)
    return met.withColumn(name, both(F.col("__inside"), F.col("__before"))).drop("__inside", "__before")


def counted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of pieces() with the sum of value (integers) over the same keys before them."""
    return _running(rows, keys, order, value, name, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def greatest_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows of pieces() with the greatest value over the same keys before them; null if there is none. value may be a struct."""
    return _running(rows, keys, order, value, name, F.max, lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a))


def join_pieces(rows: DataFrame, of_pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of their keys' piece; null keys match."""
    own = of_pieces.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("piece").alias("__piece"), *[c for c in of_pieces.columns if c not in (*keys, "piece")])
    met = F.col("piece") == F.col("__piece")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(own, met, "left").drop("__piece", *[f"__{k}" for k in keys])


class Machine:
    """A state machine over integers: table[event][state] is the next state; a refused event leaves the state.

    States are 1 .. n, 0 is none yet. An event is a pair (target, free): target is entered if
    allowed[state][target] or free, and always from none.
    """

    def __init__(self, allowed: np.ndarray):
        n = len(allowed)
        keep = np.arange(n + 1)
        self.table = np.empty((2, n + 1, n + 1), np.int16)
        for target in range(n + 1):
            enters = np.ones(n + 1, bool) if target else np.zeros(n + 1, bool)
            self.table[1, target] = np.where(enters, target, keep)
            if target:
                enters[1:] = allowed[:, target - 1]
            self.table[0, target] = np.where(enters, target, keep)
        self.size = n + 1


def run_machine(events: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine) -> DataFrame:
    """events (with target int and free boolean) with before and after, the states around each in the order of its keys.

    A target that is null or 0 is no event. Only histories that lie in several pieces go through
    maps from state to state first: each piece gives one, they are composed a key at a time, and
    a piece then starts with what the ones before it lead to from none.
    """
    ship(events.sparkSession)
    table, size, given = machine.table, machine.size, events.columns
    rows = pieces(events, keys, order, "history")
    spans = landed(rows.groupBy(*keys).agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("lo < hi").select(*keys, F.lit(1).alias("long")), "long-histories")
    met = rows.join(spans.select(*[F.col(k).alias(f"__{k}") for k in keys]), _same(keys), "left_semi")

    def plain(df: DataFrame, start: str) -> DataFrame:
        names = [f"__k{i}" for i in range(len(keys))]
        return df.select("*", *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)], F.col(start).cast("int").alias("__start"), F.coalesce(F.col("target"), F.lit(0)).cast("int").alias("__target"), F.coalesce(F.col("free"), F.lit(False)).cast("int").alias("__free")).repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", *order)

    def groups(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        """(key and piece, first row, end) of a batch's runs of equal ones."""
        same = [b.column(c).to_pylist() for c in (*[f"__k{i}" for i in range(len(keys))], "piece")]
        marks = list(zip(*same, strict=True))
        i = 0
        for j in range(1, len(marks) + 1):
            if j == len(marks) or marks[j] != marks[i]:
                yield marks[i], i, j
                i = j

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, row = None, None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            head = pa.concat_batches([r for r, _ in done]).select([*keys, "piece"])
            return pa.RecordBatch.from_arrays([*head.columns, pa.array([s.tolist() for _, s in done], pa.list_(pa.int32()))], [*keys, "piece", "leads"])

        for b in batches:
            target, free = b.column("__target").to_numpy(), b.column("__free").to_numpy()
            for mark, i, j in groups(b):
                if mark != last:
                    if last is not None:
                        done.append((row, state))
                    last, state, row = mark, np.arange(size), b.slice(i, 1)
                for t, f in zip(target[i:j].tolist(), free[i:j].tolist(), strict=True):
                    state = table[f, t][state]
            if len(done) > 1000:
                yield out()
                done = []
        if last is not None:
            done.append((row, state))
        if done:
            yield out()

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in (*keys, "piece"))
    leads = landed(plain(met.withColumn("__start0", F.lit(0)), "__start0").mapInArrow(maps, f"{schema}, leads array<int>"), "piece-maps")
    # a row a long history and piece; composed from none, so a state a piece
    so_far = F.collect_list(F.struct("piece", "leads")).over(Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = leads.select(*keys, "piece", F.aggregate(so_far, F.lit(0), lambda s, p: F.element_at(p["leads"], s + 1)).alias("__state"))
    begun = join_pieces(rows, starts, keys).withColumn("__state", F.coalesce("__state", F.lit(0)))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        plain_table = table.tolist()
        for b in batches:
            target, free, start = (b.column(c).to_numpy().tolist() for c in ("__target", "__free", "__start"))
            before, after = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for mark, i, j in groups(b):
                if mark != last:
                    last, state = mark, start[i]
                for k in range(i, j):
                    before[k] = state
                    state = plain_table[free[k]][target[k]][state]
                    after[k] = state
            yield pa.RecordBatch.from_arrays([*b.select(given).columns, pa.array(before), pa.array(after)], [*given, "before", "after"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return plain(begun, "__state").mapInArrow(states, f"{out}, before int, after int")


def _same(keys: Sequence[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return met
