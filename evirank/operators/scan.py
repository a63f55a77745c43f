"""Prefix sums and ranks over ranges of a sort order: rows are dealt into ranges, summed within each, and each range starts after those before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.storage import stored

#: Rows of one key from which on it is sent to all tasks instead of gathered; there are at most MOST_HOT such keys.
HOT, MOST_HOT = 10_000, 100_000


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df, in storage, with __range: the number of the range of `order` that a row falls into; rows that are equal by order share one.

    Spark samples the order for its cuts, so ranges are about equally large; storing the result keeps it the same in every later read.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def sums_before(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df, a table of `ranged` whose ranges ascend by `order` within each group, with the sum of each column over the group's rows that come earlier.

    Windows hold one range of one group. What precedes a range comes from one total for each group and range: without groups these are as many as there are
    ranges and are added up on the driver, else a window over the ranges of a group does it. Rows of a group must differ in `order`.
    """
    named = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    totals = named.groupBy(*by, "__range").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    kinds = dict(totals.dtypes)
    starts = [f"__s_{n}" for n in sums]
    if by:
        earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*by, "__range", *(F.sum(f"__t_{n}").over(earlier).alias(f"__s_{n}") for n in sums))
    else:
        rows, at = [], [None] * len(sums)
        for r in totals.orderBy("__range").collect():  # one row for each range
            rows.append((r["__range"], *at))
            at = [a if r[f"__t_{n}"] is None else (a or 0) + r[f"__t_{n}"] for a, n in zip(at, sums, strict=True)]
        offsets = df.sparkSession.createDataFrame(rows, ", ".join(["__range int", *(f"__s_{n} {kinds[f'__t_{n}']}" for n in sums)]))
        offsets = F.broadcast(offsets)
    on = reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__range"]))
    placed = named.alias("l").join(offsets.alias("r"), on).select("l.*", *(f"r.{s}" for s in starts))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: (F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).cast(kinds[f"__t_{n}"]).alias(n)
    return placed.select(*df.columns, *(total(n) for n in sums))


def scanned(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with the sum of each column of `sums` over the rows of its group that come earlier by `order`; rows of a group must differ in it."""
    return sums_before(ranged(df, [*map(F.col, by), *order], ranges), by, order, sums).drop("__range")


def looked_up(left: DataFrame, right: DataFrame, on: list[str], n: str, columns: list[str]) -> DataFrame:
    """left with `columns` of right, which is in storage and has one row for each key (nulls included) with the number n of left rows that it meets.

    A key of very many rows is sent to them instead of gathering them in one task; the numbers add up to the rows of left, which bounds how many there are.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(HOT, total // MOST_HOT)

    def met(side: DataFrame, how: str) -> DataFrame:
        test = reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on))
        return left.alias("l").join(side.alias("r"), test, how)

    if most <= least:
        return met(right, "inner").select("l.*", *(f"r.{c}" for c in columns))
    hot, rest = right.where(F.col(n) > least), right.where(F.col(n) <= least)
    cold = left.alias("l").join(F.broadcast(hot.select(*on)).alias("h"), reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in on)), "left_anti")
    test = reduce(Column.__and__, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on))
    few = cold.alias("l").join(rest.alias("r"), test).select("l.*", *(f"r.{c}" for c in columns))
    return met(F.broadcast(hot), "inner").select("l.*", *(f"r.{c}" for c in columns)).unionByName(few)
