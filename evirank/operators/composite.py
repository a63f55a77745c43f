"""The weighted composite profile: anchors, renormalised means, saturation, strata and diagnostics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evirank.operators.ranking import first_match


def linear_clamp(x: Column, low: float, high: float, invert: bool = False) -> Column:
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return 1 - v if invert else v


def piecewise(x: Column, points: list[tuple[float, float]], log: bool = False, floor: float = 1e-12) -> Column:
    """Straight lines between points, flat beyond the ends; null stays null."""
    at = [(math.log10(max(a, floor)) if log else a, b) for a, b in points]
    v = F.log10(F.greatest(x, F.lit(floor))) if log else x
    out = F.when(v <= at[0][0], at[0][1])
    for (a, ya), (b, yb) in zip(at, at[1:], strict=False):
        out = out.when(v <= b, ya + (v - a) * ((yb - ya) / (b - a)))
    return out.when(v > at[-1][0], at[-1][1])


def categorical(x: Column, values: dict[str, float]) -> Column:
    """The value of a category; one that is unknown fails the job."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(first_match([(x == k, float(v)) for k, v in values.items()], F.raise_error(F.concat(F.lit("unknown category "), x)).cast("double")))


def weighted(terms: list[tuple[float, Column]]) -> Column:
    """Mean of the terms that are there, with their weights made to sum to one; null if none is."""
    total = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), w).otherwise(0.0) for w, v in terms))
    mass = reduce(lambda a, b: a + b, (F.coalesce(v * w, F.lit(0.0)) for w, v in terms))
    return F.try_divide(mass, F.nullif(total, F.lit(0.0)))


def functional_max(tiers: list[Column], replications: Column, bonus: float = 0.15) -> Column:
    """Greatest tier plus a bounded bonus for replications."""
    top = F.greatest(*tiers) if len(tiers) > 1 else tiers[0]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), top + F.least(F.lit(bonus), F.coalesce(replications, F.lit(0)) * F.lit(bonus / 3))))


def recurrence(probands: Column, cohort: Column, rate: float = 1e-4, floor: float = 1e-6) -> Column:
    """Proband groups over what a cohort of this size would show; null without a denominator."""
    return F.when(cohort.isNotNull(), probands / F.greatest(cohort * rate, F.lit(floor)))


def saturation(rules: list[tuple[Column, float]], default: float = 0.0) -> Column:
    """How much of an allele's question is already answered: the level of the first rule that holds."""
    return first_match([(test, float(level)) for test, level in rules], float(default))


def effective_level(level: Column, critic: Column, order: tuple[str, ...]) -> Column:
    """The evidence level after a critic, who may lower but never raise it. order: most direct first."""
    def place(c: Column) -> Column:
        return first_match([(c == v, i) for i, v in enumerate(order)], 0)

    worst = F.greatest(place(level), F.coalesce(F.when(critic.isNotNull(), place(critic)), F.lit(0)))
    return first_match([(worst == i, v) for i, v in enumerate(order)], F.lit(None).cast("string"))


def distinct_observations(df: DataFrame, key: list[str], prefer: list[Column]) -> DataFrame:
    """One row for each observation key, the preferred one, with the number of rows it stands for."""
    own = Window.partitionBy(*key)
    return df.withColumn("__r", F.row_number().over(own.orderBy(*prefer))).withColumn("observations", F.count("*").over(own)).where("__r = 1").drop("__r")


def gated(branches: dict[str, Column], mechanism: Column, gates: dict[str, float], gate: Column) -> Column:
    """The branch score of a mechanism times the multiplier of its gate; an unknown gate leaves the score as it is."""
    score = first_match([(mechanism == m, v) for m, v in branches.items()], F.lit(None).cast("double"))
    return score * first_match([(gate == g, float(x)) for g, x in gates.items()], 1.0)


def composite(parts: list[tuple[float, Column]], saturation: Column, alpha: float) -> Column:
    """Renormalised sum, raised for what is not yet saturated."""
    return weighted(parts) * (1 + alpha * (1 - F.coalesce(saturation, F.lit(1.0))))


def stratified(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), key)).cast("bigint"))


def diagnose(df: DataFrame, by: list[str], names: list[str], floor: float = 0.0) -> DataFrame:
    """For each group and component: coverage, sample variance, share at the floor, and whether it is degenerate or sparse."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = df.select(*by, F.expr(f"stack({len(names)}, {pairs}) as (component, value)"))
    out = long.groupBy(*by, "component").agg(F.count("*").alias("n_rows"), F.count("value").alias("n"), F.var_samp("value").alias("variance"), F.count_if(F.col("value") <= floor).alias("at_floor"))
    return out.select(*by, "component", "n", (F.col("n") / F.col("n_rows")).alias("coverage"), "variance", F.try_divide(F.col("at_floor"), F.col("n")).alias("floor_fraction"), ((F.col("n") >= 2) & (F.coalesce("variance", F.lit(0.0)) < 1e-6)).alias("degenerate"), (F.col("n") < 2).alias("sparse"))


# Weights of the profile's parts.
PROFILES = {
    "discovery": {"disease": 0.32, "functional": 0.16, "mechanism": 0.34, "editability": 0.18, "alpha": 0.30},
    "validation": {"disease": 0.33, "functional": 0.34, "mechanism": 0.16, "editability": 0.17, "alpha": 0.0},
    "balanced": {"disease": 0.33, "functional": 0.22, "mechanism": 0.24, "editability": 0.21, "alpha": 0.15},
}
DISEASE = {"fine_mapping": 0.30, "clinical": 0.25, "recurrence": 0.20, "rarity": 0.15, "segregation": 0.10}
EDITABILITY = {"efficiency": 0.45, "designs": 0.20, "bystander": 0.12, "off_target": 0.13, "indel": 0.10}
SEGREGATION = ("de_novo_confirmed", "segregates_in_family", "de_novo_unconfirmed", "case_control_only", "single_case_report")


def profile(name: str, profiles: dict = PROFILES) -> dict[str, float]:
    """Weights of a mode, validated: the parts sum to one and alpha lies in [0, 1]."""
    found = dict(profiles["balanced" if name == "panel" else name])
    if abs(sum(v for k, v in found.items() if k != "alpha") - 1) > 1e-9 or not 0 <= found["alpha"] <= 1:
        raise ValueError(f"weights of {name} do not sum to one")
    return found


def entering(status: Column, value: Column) -> Column:
    """A quantity in a weighted mean: its value if present, 0 if searched and not found, else nothing."""
    return F.when(status == "present", value).when(status == "searched_not_found", 0.0)


def best_match(evidence: DataFrame, anchors: dict[str, float], by: str = "variant_id") -> DataFrame:
    """(by, match): the greatest anchor of the usable evidence's disease match, not below that of a related disease."""
    own = first_match([(F.col("disease_match") == k, float(v)) for k, v in anchors.items()], 0.0)
    return evidence.groupBy(by).agg(F.greatest(F.coalesce(F.max(F.when(F.col("usable"), own)), F.lit(0.0)), F.lit(float(anchors["related"]))).alias("match"))


def segregation(evidence: DataFrame, by: str = "variant_id") -> DataFrame:
    """(by, segregation): the strongest kind found in usable evidence on the allele itself."""
    place = first_match([(F.col("evidence_type") == k, i) for i, k in enumerate(SEGREGATION)], len(SEGREGATION))
    best = evidence.groupBy(by).agg(F.min(F.when(F.col("usable") & F.col("variant_specific"), place)).alias("__p"))
    return best.select(by, first_match([(F.col("__p") == i, k) for i, k in enumerate(SEGREGATION)], "none").alias("segregation"))


def disease_score(pip: Column, log_p: Column, classification: Column, stars: Column, match: Column, recurrence_: Column, rarity: Column, segregation_: Column) -> Column:
    """Weighted mean of the anchored parts: fine mapping by inclusion probability, else by p; the classification counts by stars and match."""
    return weighted([(DISEASE["fine_mapping"], F.coalesce(pip, log_p)), (DISEASE["clinical"], classification * stars * match), (DISEASE["recurrence"], recurrence_), (DISEASE["rarity"], rarity), (DISEASE["segregation"], segregation_)])


def editability(efficiency: Column, designs: Column, bystander: Column, off_target: Column, indel: Column) -> Column:
    return weighted(list(zip(EDITABILITY.values(), (efficiency, designs, bystander, off_target, indel), strict=True)))


def editing_status(conflict: Column, pam: Column, verified: Column, designs: Column) -> Column:
    """A conflict with the host line rules an allele out, then the lack of a site; without a verified host line nothing is known."""
    return F.when(conflict.isNotNull(), "not_editable_in_host_line").when(pam == F.lit(False), "not_editable_no_pam").when(~F.coalesce(verified, F.lit(False)), "editability_unknown").when(designs <= 0, "not_editable_no_pam").otherwise("editable")


def long_inputs(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, input, value): raw inputs by name, one row each."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return df.select(key, F.expr(f"stack({len(names)}, {pairs}) as (input, value)"))
