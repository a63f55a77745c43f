"""Exact ranks and prefix sums in order of a key, from hierarchical digit histograms: no global sort, and no group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.llm.common import written

#: Hex digits that a cell is split by, rows that a cell may hold, and cells that may be open at once (they are broadcast).
DIGITS, CELL, MOST_OPEN = 2, 512, 100_000


def sortable(value: Column) -> Column:
    """A BIGINT as 16 hex digits that sort as it does."""
    return F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _shared(low: Column, high: Column) -> Column:
    """Length of the common prefix of two strings."""
    places = F.sequence(F.lit(1), F.least(F.length(low), F.length(high)))
    differ = F.filter(places, lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1)))
    return F.when(F.least(F.length(low), F.length(high)) == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, F.least(F.length(low), F.length(high))))


def scanned(rows: DataFrame, by: list[str], key: Column, sums: dict[str, Column], cell: int | None = None) -> DataFrame:
    """rows, a table in storage, with the sum of each column of `sums` over the rows of the same group that come earlier by key.

    key is a string, compared bytewise, not null and distinct within a group; `by` has no nulls. Groups of over `cell` (CELL) rows are cut into cells by the next digits
    behind their common prefix, counted and summed, and cut again until each cell is small. A cell starts where its parent does plus what its earlier
    siblings hold, so every window sees one parent's children (at most 16 ** DIGITS) or one cell. Open cells hold over `cell` rows each and `cell` grows
    beyond MOST_OPEN of them, which bounds what is broadcast. An empty table gives no rows. Columns whose names start with two underscores are reserved.
    """
    most = max(cell or CELL, rows.count() // MOST_OPEN)
    named = rows.withColumns({"__key": key} | {f"__v_{n}": c for n, c in sums.items()})
    starts = [f"__s_{n}" for n in sums]
    measures = [F.count("*").alias("__n"), F.min("__key").alias("__low"), F.max("__key").alias("__high")]
    totals = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums]
    kinds = dict(named.agg(*totals).dtypes)
    zero = {f"__s_{n}": F.lit(0).cast(kinds[f"__t_{n}"]) for n in sums}

    def open_ones(cells: DataFrame) -> DataFrame:
        large = cells.where((F.col("__n") > most) & (F.col("__low") < F.col("__high")))
        return written(large.select(*by, "__cell", *starts, (_shared(F.col("__low"), F.col("__high")) + DIGITS).alias("__to")), "radix-open")

    opened = open_ones(named.groupBy(*by).agg(*measures).withColumn("__cell", F.lit("")).withColumns(zero))
    dealt, closed = named.withColumn("__cell", F.lit("")), []
    while opened.count():
        on = [*by, "__cell"]
        inside = dealt.join(F.broadcast(opened), on).withColumn("__parent", F.col("__cell")).withColumn("__cell", F.substring("__key", F.lit(1), F.col("__to")))
        before = Window.partitionBy(*by, "__parent").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = inside.groupBy(*by, "__parent", "__cell").agg(*measures, *totals, *(F.first(s).alias(s) for s in starts))
        cells = cells.withColumns({f"__s_{n}": F.col(f"__s_{n}") + F.coalesce(F.sum(f"__t_{n}").over(before), zero[f"__s_{n}"]) for n in sums})
        cells = written(cells.select(*by, "__cell", "__n", "__low", "__high", *(F.col(f"__s_{n}").cast(kinds[f"__t_{n}"]).alias(f"__s_{n}") for n in sums)), "radix-cells")
        dealt = dealt.join(F.broadcast(opened.select(*on, "__to")), on, "left").withColumn("__cell", F.coalesce(F.substring("__key", F.lit(1), F.col("__to")), F.col("__cell"))).drop("__to")
        closed.append(cells.where((F.col("__n") <= most) | (F.col("__low") == F.col("__high"))).select(*by, "__cell", *starts))
        opened = open_ones(cells)
    if closed:
        dealt = dealt.join(reduce(DataFrame.unionByName, closed), [*by, "__cell"], "left")
    else:
        dealt = dealt.withColumns(zero)
    earlier = Window.partitionBy(*by, "__cell").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: (F.coalesce(F.col(f"__s_{n}"), zero[f"__s_{n}"]) + F.coalesce(F.sum(f"__v_{n}").over(earlier), zero[f"__s_{n}"])).cast(kinds[f"__t_{n}"])
    return dealt.select(*(F.col(c) for c in rows.columns), *(total(n).alias(n) for n in sums))


def ranked(rows: DataFrame, by: list[str], key: Column, name: str, cell: int | None = None) -> DataFrame:
    """rows, a table in storage, with their place from 0 within the group, in ascending order of key."""
    return scanned(rows, by, key, {name: F.lit(1).cast("bigint")}, cell)
