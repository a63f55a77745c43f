"""Tie-aware evaluation metrics as grouped aggregates: none pairs positives with negatives, and no window holds all keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.operators.scan import looked_up, ranged, scanned, sums_before
from evirank.storage import stored


def average_rank(df: DataFrame, key: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank by ascending key, tied rows sharing the mean of their places; a null key comes first.

    Ranks come from one row for each distinct key, whose counts are summed range by range.
    """
    mean = _mean_ranks(df.groupBy(*by, key).agg(F.count("*").alias("__c")), key, name, by)
    return looked_up(df, mean, [*by, key], "__c", [name])


def _mean_ranks(counts: DataFrame, key: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts (by, key, __c) with the mean place of each key's rows; in storage."""
    before = scanned(counts, list(by), [F.col(key).asc()], {"__b": F.col("__c")})
    return stored(before.withColumn(name, (F.col("__b") + (F.col("__c") + 1) / F.lit(2.0)).cast("double")).drop("__b"), "mean-ranks")


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, spearman, n): correlation of average ranks; null where a side does not vary. Works on counts of each distinct pair, and deviations from the mean rank."""
    pairs = stored(df.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__c")), "pairs")
    both = pairs
    for side in ("__x", "__y"):
        counts = pairs.groupBy(*by, side).agg(F.sum("__c").alias("__c"), F.count("*").alias("__met"))
        both = looked_up(both, _mean_ranks(counts, side, f"__r{side}", by), [*by, side], "__met", [f"__r{side}"])
    sizes = pairs.groupBy(*by).agg(F.sum("__c").alias("__n"), F.count("*").alias("__met"))
    if by:
        both = looked_up(both, stored(sizes, "sizes"), [*by], "__met", ["__n"])
    else:
        both = both.withColumn("__n", F.lit(sizes.first()["__n"] or 0))
    u, v, c = F.col("__r__x") - (F.col("__n") + 1) / 2, F.col("__r__y") - (F.col("__n") + 1) / 2, F.col("__c")
    return both.groupBy(*by).agg(F.try_divide(F.sum(c * u * v), F.sqrt(F.sum(c * u * u) * F.sum(c * v * v))).alias("spearman"), F.coalesce(F.sum(c), F.lit(0)).alias("n"))


def _area(scored: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, auroc, n_pos, n_neg) of (by, key, __p positives, __m negatives, __lower negatives with smaller keys)."""
    won = F.col("__p") * (F.col("__lower") + F.col("__m") / F.lit(2.0))
    p, m = F.sum("__p"), F.sum("__m")
    return scored.groupBy(*by).agg(F.try_divide(F.sum(won), p.cast("double") * m.cast("double")).alias("auroc"), p.alias("n_pos"), m.alias("n_neg"))


def auroc(df: DataFrame, key: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank-sum area with ties as one half; null where a class is empty. Works on counts of each distinct key, summed range by range."""
    counts = df.groupBy(*by, key).agg(F.sum(label).alias("__p"), (F.count("*") - F.sum(label)).alias("__m"))
    return _area(scanned(counts, list(by), [F.col(key).asc()], {"__lower": F.col("__m")}), by)


def expected_hits(df: DataFrame, key: str, label: str, ks: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, hits, precision, recall) in descending key order: whole tie groups while they fit and a share of the one at the boundary."""
    groups = df.groupBy(*by, key).agg(F.count("*").alias("__n"), F.sum(label).alias("__h"))
    placed = scanned(groups, list(by), [F.col(key).desc()], {"__before": F.col("__n")}).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    share = F.least(F.greatest(F.col("k") - F.col("__before"), F.lit(0)), F.col("__n")) / F.col("__n") * F.col("__h")
    out = placed.groupBy(*by, "k").agg(F.sum(share).alias("hits"), F.sum("__n").alias("__total"), F.sum("__h").alias("__all"))
    return out.where("k <= __total").select(*by, F.col("k").cast("bigint").alias("k"), "hits", (F.col("hits") / F.col("k")).alias("precision_at_k"), (F.col("hits") / F.greatest(F.lit(1), F.col("__all"))).alias("recall_at_k"))


#: Means up to here have their distribution tabulated, larger ones a corrected normal one.
TABULATED = 30


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts' text, joined by colons: the first 52 bits, in the middle of their step."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson(mean: Column, *parts: Column) -> Column:
    """A Poisson count with a whole mean, drawn by counter: the same parts always give the same count.

    Up to TABULATED it is the number of cumulative probabilities below a uniform number. Beyond, a normal number from two uniform ones, with the term that
    the skewness of the distribution asks for, is rounded.
    """
    tables = []
    for m in range(1, TABULATED + 1):
        p, total, row = math.exp(-m), 0.0, []
        for k in range(m + 12 * math.isqrt(m) + 20):
            total += p
            row.append(total)
            p *= m / (k + 1)
        tables.append(F.array(*map(F.lit, row)))
    u = uniform(*parts)
    small = F.size(F.filter(F.get(F.array(*tables), (mean - 1).cast("int")), lambda c: c <= u))
    z = F.sqrt(-2 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("a")))
    large = F.floor(F.greatest(F.lit(0.0), mean + z * F.sqrt(mean.cast("double")) + (z * z - 1) / 6 + 0.5))
    return F.when(mean <= 0, 0).when(mean <= TABULATED, small).otherwise(large).cast("bigint")


def bootstrap_auroc(df: DataFrame, key: str, label: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(low, high, n): 2.5 and 97.5 per cent places of the area over resamples, and how many have both classes.

    A resample draws, for each distinct key and label, how often its rows are taken in all: a Poisson count whose mean is their number, which is what Poisson
    weights of the single rows add up to. Keys are dealt into ranges once; resamples x distinct keys are summed in these ranges.
    """
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.sum(label).alias("__p"), (F.count("*") - F.sum(label)).alias("__m"))
    drawn = ranged(counts, [F.col("__key").asc()]).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    draw = lambda side, name: poisson(F.col(side), F.lit(seed), F.col("__b"), F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.lit(name))
    drawn = drawn.select("__range", "__key", "__b", draw("__p", "p").alias("__p"), draw("__m", "m").alias("__m")).where("__p + __m > 0")
    each = _area(sums_before(stored(drawn, "resamples"), ["__b"], [F.col("__key").asc()], {"__lower": F.col("__m")}), ("__b",)).where("auroc is not null")
    size = F.size("v")
    return each.agg(F.array_sort(F.collect_list("auroc")).alias("v")).select(
        F.try_element_at("v", F.floor(size * 0.025).cast("int") + 1).alias("low"), F.try_element_at("v", F.greatest(F.lit(1), F.floor(size * 0.975).cast("int"))).alias("high"), size.cast("bigint").alias("n"),
    )


#: Keys below one node of the tree that inversions are counted in.
FAN = 16


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(tau_b, concordant, discordant, n): Kendall's tau with ties of both sides taken out; null where a side does not vary. Rows with a null take no part.

    Distinct values of x get their dense rank, whose digits in the base FAN name the nodes of a tree. Two rows with different x part in one node: there, rows
    are counted for each y and next digit, and sums over smaller y tell how many rows of smaller digits lie below and how many of greater ones do. Every row is
    counted once for each digit, no pair is made, and sums run range by range, whatever the number of rows of a node.
    """
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__c")), "pairs")
    values = stored(scanned(pairs.groupBy("__x").agg(F.count("*").alias("__met"), F.sum("__c").alias("__t")), [], [F.col("__x").asc()], {"__at": F.lit(1).cast("bigint")}), "values")
    n_values, one = values.count(), lambda c: c.cast("decimal(38,0)")
    digits = 1
    while FAN**digits < n_values:
        digits += 1
    placed = looked_up(pairs, values, ["__x"], "__met", ["__at"])
    level = F.explode(F.array(*map(F.lit, range(digits)))).alias("__level")
    nodes = placed.select("__y", "__c", "__at", level).withColumn("__low", F.floor(F.col("__at") / F.pow(F.lit(float(FAN)), F.col("__level"))).cast("bigint"))
    nodes = nodes.withColumn("__node", F.floor(F.col("__low") / FAN).cast("bigint")).withColumn("__digit", F.col("__low") % FAN)
    rows = nodes.groupBy("__level", "__node", "__y").agg(*(F.coalesce(F.sum(F.when(F.col("__digit") == d, F.col("__c"))), F.lit(0)).alias(f"__n{d}") for d in range(FAN)))
    below = scanned(rows, ["__level", "__node"], [F.col("__y").asc()], {f"__b{d}": F.col(f"__n{d}") for d in range(FAN)})

    def met(of) -> Column:
        return sum((one(F.col(f"__n{d}")) * sum((F.col(f"__b{e}") for e in of(d)), F.lit(0)) for d in range(FAN) if list(of(d))), F.lit(0))

    counted = below.agg(F.coalesce(F.sum(one(met(lambda d: range(d)))), F.lit(0)).alias("concordant"), F.coalesce(F.sum(one(met(lambda d: range(d + 1, FAN)))), F.lit(0)).alias("discordant"))
    tied = lambda c: one(c) * (one(c) - 1) / 2
    ties = pairs.groupBy("__y").agg(F.sum("__c").alias("__t")).agg(F.sum(tied(F.col("__t"))).alias("ty"), F.sum("__t").alias("n"))
    total, tx, ty = ties.first()["n"] or 0, values.agg(F.sum(tied(F.col("__t")))).first()[0] or 0, ties.first()["ty"] or 0
    every = total * (total - 1) // 2
    scale = math.sqrt(float(every - tx) * float(every - ty))
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    tau = F.try_divide(c - d, F.lit(scale))
    return counted.select(tau.alias("tau_b"), F.col("concordant").cast("bigint").alias("concordant"), F.col("discordant").cast("bigint").alias("discordant"), F.lit(total).cast("bigint").alias("n"))


def three_way_label(score: Column, abnormal_max: float, normal_min: float) -> Column:
    """1 up to abnormal_max, 0 above normal_min, null between."""
    return F.when(score <= abnormal_max, 1).when(score > normal_min, 0)


def ndcg(df: DataFrame, order: list[Column], gain: str, k: int) -> DataFrame:
    """Normalised discounted gain of the first k rows, with gains 2^g - 1."""
    def discounted(keys: list[Column]) -> DataFrame:
        top = df.orderBy(*keys).limit(k)
        placed = top.withColumn("__i", F.row_number().over(Window.orderBy(*keys)))
        return placed.agg(F.sum((F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col("__i") + 1.0)).alias("d"))

    best = discounted([F.desc(gain)]).withColumnRenamed("d", "best")
    return discounted(order).crossJoin(best).select(F.coalesce(F.try_divide("d", "best"), F.lit(0.0)).alias("ndcg"))  # one row each


def run_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """What two runs agree and differ on, by key."""
    j = old.select(key, F.col(value).alias("old_value")).join(new.select(key, F.col(value).alias("new_value")), key, "full")
    status = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") == F.col("new_value"), "same").otherwise("changed")
    return j.withColumn("status", status)
