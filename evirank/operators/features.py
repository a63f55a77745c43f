"""Per-allele features: mechanism concordance (K), observation tier (O), predictor score (P), channel and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.operators.ranking import coordinate_order, ordinal, rank, stratum_report
from evirank.policy import Policy
from evirank.schema import ACCEPTED_STATES, CONCORDANCE, EXACT_MATCHES, INSTALLING, OBSERVATION_TIER, QUERY_DISEASE


def selected_effect(effects: Column) -> Column:
    """The flagged effect, if exactly one is flagged."""
    flagged = F.filter(effects, lambda e: e["selected_display"])
    return F.when(F.size(flagged) == 1, F.get(flagged, 0))


def accepted(links: DataFrame) -> DataFrame:
    return links.where(F.col("state").isin(*ACCEPTED_STATES) & F.col("variant_id").isNotNull())


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """One row for each allele of accepted links joined with their claims.

    evidence: variant_id, link_id, identity_match, kind, perturbation_type, outcome_type, cases, controls_known, disease_relationship.
    """
    exact = F.col("identity_match").isin(*EXACT_MATCHES)
    functional = exact & (F.col("kind") == "functional_experiment")
    tested = functional & F.col("perturbation_type").isin(*INSTALLING)
    altered = tested & (F.col("outcome_type") == "altered")
    seen = exact & F.col("kind").isin("patient_observation", "association") & (F.coalesce(F.col("cases"), F.lit(0)) >= 1)
    own = F.col("disease_relationship").isin(*QUERY_DISEASE)
    tier = F.when(seen & own & F.col("controls_known"), 3).when(seen & own, 2).when(seen & (F.col("disease_relationship") == "related"), 1).otherwise(0)

    def ids(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col("link_id"))))

    out = evidence.withColumn("__tier", tier).groupBy("variant_id").agg(
        F.bool_or(altered).alias("__altered"), F.bool_or(tested).alias("__tested"), F.bool_or(functional & ~tested).alias("__carrier"), F.max("__tier").alias("o_tier"),
        ids(tested).alias("__t"), ids(F.col("__tier") > 0).alias("__o"), ids(~exact).alias("__c"),
    )
    reasons = F.map_filter(F.create_map(F.lit("characterization"), F.col("__t"), F.lit("observation"), F.col("__o"), F.lit("context"), F.col("__c")), lambda k, v: F.size(v) > 0)
    return out.select(
        "variant_id", F.when(F.col("__altered"), "characterized_altered").when(F.col("__tested"), "characterized_other").otherwise("uncharacterized").alias("characterization"), "o_tier", reasons.alias("contributing_link_ids"), F.col("__carrier").alias("carrier_only"),
    )


def characterization(installs: Column, altered: Column) -> Column:
    """Aggregate: any installed allele with an altered outcome, any installed allele, or none."""
    return F.when(F.bool_or(installs & altered), "characterized_altered").when(F.bool_or(installs), "characterized_other").otherwise("uncharacterized")


def derive_features(variants: DataFrame, annotations: DataFrame, evidence: DataFrame, mechanism: str, policy: Policy) -> DataFrame:
    """variants: variant_id, label, roles, chrom, pos, ref, alt. annotations: variant_id, terms, nmd, in_functional_domain, predictions
    (map of name to {status, value}). Alleles without annotation stay, in the default stratum and flagged."""
    spark = variants.sparkSession
    a = annotations.select("variant_id", "terms", "nmd", "in_functional_domain", "predictions", F.lit(True).alias("__annotated"))
    j = variants.join(a, "variant_id", "left").join(evidence_summary(evidence), "variant_id", "left")
    j = j.withColumn("stratum", policy.stratum(F.col("terms"))).withColumn("p_predictor", policy.predictor(F.col("stratum")))
    table = policy.concordance(spark).where(F.col("mechanism") == mechanism)
    whole = table.where("feature is null").select("stratum", F.col("concordance").alias("__class"))
    sub = table.where("feature is not null").groupBy("stratum").agg(F.max("feature").alias("__feature"), F.map_from_entries(F.collect_list(F.struct("value", "concordance"))).alias("__levels"))
    j = j.join(F.broadcast(whole), "stratum", "left").join(F.broadcast(sub), "stratum", "left")  # one row for each stratum of the policy
    value = F.lower(F.coalesce(F.when(F.col("__feature") == "nmd", F.col("nmd").cast("string")).otherwise(F.col("in_functional_domain").cast("string")), F.lit("missing")))
    level = F.when(F.col("__levels").isNull(), F.col("__class")).otherwise(F.coalesce(F.try_element_at("__levels", value), F.try_element_at("__levels", F.lit("missing"))))
    j = j.withColumn("k", level).withColumn("k_basis", F.when(F.col("__levels").isNull(), "class").otherwise(F.concat(F.col("__feature"), F.lit("="), value)))
    found = F.try_element_at("predictions", F.col("p_predictor"))
    j = j.withColumn("p_status", F.when(F.col("p_predictor").isNull(), "no_predictor").otherwise(F.coalesce(found["status"], F.lit("not_searched")))).withColumn("p", F.when(F.col("p_status") == "value_present", found["value"]))
    none = F.array().cast("array<string>")
    roles = F.coalesce("roles", none)
    control = F.arrays_overlap(roles, F.array(*map(F.lit, policy.control_roles))) if policy.control_roles else F.lit(False)
    kind = F.coalesce("characterization", F.lit("uncharacterized"))
    routed = (kind != "uncharacterized") & F.lit(policy.characterized == "route_to_control")
    derived = F.when(~control & routed & (kind == "characterized_altered"), F.array(F.lit("positive_control_candidate"))).when(~control & routed, F.array(F.lit("characterized_comparison"))).otherwise(none)
    all_roles = F.array_sort(F.array_union(roles, derived))
    flags = F.array_compact(F.array(F.when(F.col("__annotated").isNull(), "no_annotation"), F.when(F.col("carrier_only"), "carrier_or_non_installation_experiment_only"), F.when(F.col("p_predictor").isNotNull() & (F.col("p_status") != "value_present"), F.concat(F.lit("p_"), F.col("p_status")))))
    tiers = {v: k for k, v in OBSERVATION_TIER.items()}
    o = F.coalesce("o_tier", F.lit(0))
    name = F.when(o == 3, tiers[3]).when(o == 2, tiers[2]).when(o == 1, tiers[1]).otherwise(tiers[0])
    return j.select(
        "variant_id", "label", "chrom", "pos", "ref", "alt", F.when(control | routed, "control").otherwise("discovery").alias("channel"), F.when(F.size(all_roles) == 0, F.array(F.lit("discovery"))).otherwise(all_roles).alias("roles"),
        "stratum", F.coalesce("terms", none).alias("consequence_terms"), kind.alias("characterization"), "k", "k_basis", name.alias("o"), "p_predictor", "p_status", "p", F.coalesce("contributing_link_ids", F.expr("cast(map() as map<string, array<string>>)")).alias("contributing_link_ids"), flags.alias("flags"),
    )


def rank_features(features: DataFrame, policy: Policy) -> DataFrame:
    """Ranked rows in the order of the policy's keys, with the labels of each key."""
    keyed = features.select("*", ordinal(F.col("k"), CONCORDANCE).alias("key_k"), ordinal(F.col("o"), OBSERVATION_TIER).alias("key_o"), F.col("p").alias("key_p"))
    ranked = rank(keyed, ["channel", "stratum"], [f"key_{k.lower()}" for k in policy.key_order], _coordinates(), ("key_p",))
    said = {
        "K": F.concat(F.lit("K="), F.col("k")), "O": F.concat(F.lit("O="), F.col("o")),
        "P": F.when(F.col("p_predictor").isNull(), "P=no_predictor").when(F.col("p").isNull(), F.concat(F.lit("P=missing:"), F.col("p_status"))).otherwise(F.concat(F.lit("P="), F.col("p").cast("string"))),
    }
    return ranked.withColumn("ordering_tuple", F.array(*(said[k] for k in policy.key_order)))


def _coordinates() -> list[Column]:
    return [*coordinate_order("chrom"), F.col("pos").asc(), F.col("ref").asc(), F.col("alt").asc()]


def report(ranked: DataFrame) -> DataFrame:
    return stratum_report(ranked, ["channel", "stratum"], ["key_k", "key_o", "key_p"], "p")
