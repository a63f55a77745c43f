"""Rankings against measured scores: the scores, the ranked rows, and how several orders agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.functions.text import SUBSTITUTION
from evirank.operators import metrics as ME
from evirank.operators.ranking import ordinal
from evirank.schema import CONCORDANCE
from evirank.storage import stored


def measured_scores(rows: DataFrame) -> DataFrame:
    """(hgvs_p, score): mean score of each single substitution; other notations and scores that are no numbers are left out. rows: hgvs_pro, score as text."""
    name, score = F.trim("hgvs_pro"), F.col("score").try_cast("double")
    kept = rows.where(name.rlike(SUBSTITUTION) & score.isNotNull() & ~F.isnan(score))
    return kept.groupBy(F.trim("hgvs_pro").alias("hgvs_p")).agg(F.avg(F.col("score").try_cast("double")).alias("score"))


def lookup_key(classification: Column) -> Column:
    """2 for pathogenic, 0 for benign, 1 for whatever is uncertain, conflicting or unknown."""
    c = F.lower(F.coalesce(classification, F.lit("")))
    has = lambda x: F.contains(c, F.lit(x))
    return F.when(has("pathogenic") & ~has("benign") & ~has("conflicting"), 2).when(has("uncertain") | has("conflicting"), 1).when(has("benign"), 0).otherwise(1)


def ranked_rows(ranked: DataFrame, annotations: DataFrame) -> DataFrame:
    """(hgvs_p, tier, k_order, predicted, classification) of discovery missense rows of a ranked table. ranked: its text columns."""
    number = F.when(F.col("P").rlike(r"^-?[\d.]+(e[+-]?\d+)?$"), F.col("P").try_cast("double"))
    own = ranked.where("primary_channel = 'discovery' and stratum = 'missense' and coalesce(hgvs_p, '') <> ''")
    j = own.join(annotations.select("variant_id", "classification"), "variant_id", "left")
    return j.select("hgvs_p", F.col("tier_rank").cast("int").alias("tier"), ordinal(F.col("K"), CONCORDANCE, 1).alias("k_order"), number.alias("predicted"), F.coalesce("classification", F.lit("")).alias("classification"))


#: Orders that are compared: a larger key is nominated earlier.
ORDERS = {
    "tiers": lambda: -F.col("tier").cast("double"),
    "predictor_only": lambda: F.coalesce(F.col("predicted"), F.lit(-1.0)),
    "domain_only": lambda: F.col("k_order").cast("double"),
    "lookup": lambda: lookup_key(F.col("classification")).cast("double"),
}


def scored_rows(rows: DataFrame, scores: DataFrame, abnormal_max: float, normal_min: float) -> DataFrame:
    """rows that were measured, with their label: 1 abnormal, 0 normal, null between."""
    return rows.join(scores, "hgvs_p").withColumn("label", ME.three_way_label(F.col("score"), abnormal_max, normal_min))


def class_counts(scored: DataFrame) -> DataFrame:
    """(n_scored, n_abnormal, n_normal, random_precision)."""
    n = F.count("label")
    return scored.agg(F.count("*").alias("n_scored"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("n_abnormal"), (n - F.coalesce(F.sum("label"), F.lit(0))).cast("bigint").alias("n_normal"), F.try_divide(F.sum("label").cast("double"), n).alias("random_precision"))


def agreement(scored: DataFrame, orders: dict = ORDERS, ks: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """(order, measure, value): rank agreement with the scores (low scores mean loss), distinct keys, area, precision and recall at k.

    Every row is dealt to all orders at once, and each measure is computed for all of them together.
    """
    each = F.array(*(F.struct(F.lit(name).alias("order"), key().alias("key")) for name, key in orders.items()))
    keyed = stored(scored.select("score", "label", F.inline(each)), "orders")
    labelled, by = keyed.where("label is not null"), ("order",)
    at, row = F.col("k").cast("string"), lambda m, v: F.struct(m.alias("measure"), v.cast("double").alias("value"))
    hits = ME.expected_hits(labelled, "key", "label", ks, by).select("order", F.inline(F.array(row(F.concat(F.lit("precision@"), at), F.col("precision_at_k")), row(F.concat(F.lit("recall@"), at), F.col("recall_at_k")))))
    parts = [
        ME.spearman(keyed, "key", "score", by).select("order", F.lit("spearman_agreement").alias("measure"), (-F.col("spearman")).alias("value")),
        keyed.groupBy("order").agg(F.count_distinct("key").cast("double").alias("value")).select("order", F.lit("distinct_keys").alias("measure"), "value"),
        ME.auroc(labelled, "key", "label", by).select("order", F.lit("auroc").alias("measure"), F.col("auroc").alias("value")),
        hits,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
