"""Stratified lexicographic ranking with explicit ties, and row numbers that need no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.operators.scan import looked_up, ranged, scanned, sums_before
from evirank.storage import stored


def first_match(rules: list[tuple[Column, object]], default) -> Column:
    """Ordered rules: the value of the first condition that holds."""
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def ordinal(c: Column, scale: dict[str, int], default: int = 0) -> Column:
    return first_match([(c == k, v) for k, v in scale.items()], default)


def sort_keys(names: list[str], nullable: tuple[str, ...] = ()) -> list[Column]:
    """Descending keys; a missing value of a nullable key comes last, whatever its sign."""
    out = []
    for n in names:
        if n in nullable:
            out.append(F.when(F.col(n).isNotNull(), 1).otherwise(0).desc())
        out.append(F.coalesce(F.col(n), F.lit(0)).desc())
    return out


def rank(df: DataFrame, partition: list[str], keys: list[str], within: list[Column], nullable: tuple[str, ...] = ()) -> DataFrame:
    """Adds tier_rank, display_index, tie_group_size and tie_group_id.

    Tiers are dense over the keys; rows of a tier are tied, and `within`, which must tell all rows of a tier apart, only settles the order of display. Tiers come
    from one row for each distinct tuple of keys, and places in a tie group from ranges of `within`, so neither a partition's keys nor a tier's rows meet in
    one task.
    """
    own = {}
    for i, k in enumerate(keys):
        if k in nullable:
            own[f"__there{i}"] = F.when(F.col(k).isNotNull(), 1).otherwise(0)
        own[f"__key{i}"] = F.coalesce(F.col(k), F.lit(0))
    parts = {f"__part{i}": F.col(c) for i, c in enumerate(partition)}
    named = df.withColumns(own | parts)
    tiers = named.groupBy(*parts, *own).agg(F.count("*").alias("tie_group_size"))
    before = scanned(tiers, list(parts), [F.col(c).desc() for c in own], {"tier_rank": F.lit(1).cast("bigint"), "__before": F.col("tie_group_size")})
    tiers = stored(before.withColumn("tier_rank", F.col("tier_rank") + 1), "tiers")
    ranked = looked_up(named, tiers, [*parts, *own], "tie_group_size", ["tier_rank", "tie_group_size", "__before"]).drop(*parts, *own)
    placed = scanned(ranked, [*partition, "tier_rank"], within, {"__in": F.lit(1).cast("bigint")})
    ranked = placed.withColumn("display_index", F.col("__before") + F.col("__in") + 1).drop("__before", "__in")
    return ranked.withColumn("tie_group_id", F.concat_ws(":", *partition, F.concat(F.lit("t"), F.col("tier_rank").cast("string"))))


def stratum_report(ranked: DataFrame, partition: list[str], keys: list[str], missing: str) -> DataFrame:
    """Size, tiers, largest tie, distinct values of each key and whether a key tells nothing apart."""
    out = ranked.groupBy(*partition).agg(
        F.count("*").alias("n"), F.max("tier_rank").alias("n_tiers"), F.max("tie_group_size").alias("largest_tie_group"),
        *(F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit("missing"))).alias(f"{k}_values") for k in keys), F.count_if(F.col(missing).isNull()).alias("p_missing"),
    )
    for k in keys:
        out = out.withColumn(f"{k}_degenerate", F.col(f"{k}_values") <= 1)
    return out


def coordinate_order(chrom: str = "chrom") -> list[Column]:
    """Numeric chromosomes first and by number, then the named ones."""
    number = F.col(chrom).try_cast("int")
    return [F.when(number.isNull(), 1).otherwise(0).asc(), number.asc(), F.col(chrom).asc()]


def numbered(df: DataFrame, order: str, name: str, ranges: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Global row numbers from 1 by a column and then by `ties`, which together should tell rows apart; equal rows are numbered in any order."""
    given = ranged(df, [F.col(order).asc(), *(F.col(t).asc() for t in ties)], ranges)
    return sums_before(given, [], [F.col(order).asc(), *(F.col(t).asc() for t in ties)], {name: F.lit(1).cast("bigint")}).drop("__range").withColumn(name, F.col(name) + 1)


def batches(df: DataFrame, order: str, size: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds batch: rows in runs of `size` by order."""
    return numbered(df, order, "__n", ties=ties).withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("bigint")).drop("__n")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def audit_sample(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """A reproducible sample of min(n, max(1, floor(n * fraction))) rows, by the hash of seed and key."""
    n = df.count()
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).limit(min(n, max(1, int(n * fraction))))


def running_before(df: DataFrame, by: list[str], order: str, size: Column, name: str, step: int = 10_000) -> DataFrame:
    """Adds the sum of size over the rows of the group that come earlier by a whole-number order column.

    Sums of runs of `step` places are added up first, so rows are only sorted within such a run.
    """
    dealt = df.withColumn("__size", size).withColumn("__run", F.floor(F.col(order) / step))
    runs = dealt.groupBy(*by, "__run").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(runs, [*by, "__run"]).withColumn(name, (F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0))).cast("bigint")).drop("__size", "__run", "__start")


def by_strata(df: DataFrame, strata: tuple[str, ...]) -> list[Column]:
    """Order of output: channel, the policy's order of strata (others last), display index."""
    return [F.col("channel"), first_match([(F.col("stratum") == s, i) for i, s in enumerate(strata)], 99), F.col("display_index")]
