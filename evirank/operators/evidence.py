"""Evidence checks and the state that an append-only decision log implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.operators.ranking import numbered
from evirank.schema import EXACT_MATCHES


def json_pointer(document: Column, pointer: str) -> Column:
    """The value at an RFC 6901 pointer as text. Digits are a key of an object and a place of an array."""
    value = document
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        inner = F.try_element_at(F.from_json(value, "map<string,string>"), F.lit(key))
        if key.isdigit() and (key == "0" or key[0] != "0"):
            inner = F.coalesce(inner, F.get(F.from_json(value, "array<string>"), F.lit(int(key))))
        value = inner
    return value


def check_locators(locators: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(claim_id, ok, reasons) of each claim's locators.

    locators: claim_id, kind, snapshot_id, start, end, excerpt, text_digest, value, expected_value_digest (value: what the pointer found).
    snapshots: snapshot_id, text, digest.
    """
    j = locators.join(snapshots.select("snapshot_id", "text", "digest"), "snapshot_id", "left")
    span = F.expr("substring(text, start + 1, end - start)")
    reason = (
        F.when(F.col("text").isNull(), "snapshot_missing")
        .when(F.sha2("text", 256) != F.col("digest"), "snapshot_altered")
        .when((F.col("kind") == "text_span") & (F.col("text_digest") != F.col("digest")), "text_digest_differs")
        .when((F.col("kind") == "text_span") & (span != F.col("excerpt")), "excerpt_differs")
        .when((F.col("kind") == "json_field") & F.col("value").isNull(), "pointer_unresolved")
        .when((F.col("kind") == "json_field") & (F.sha2("value", 256) != F.col("expected_value_digest")), "value_differs")
    )
    return j.withColumn("reason", reason).groupBy("claim_id").agg((F.count("reason") == 0).alias("ok"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def mechanical_checks(links: DataFrame, claims: DataFrame, identity: DataFrame, located: DataFrame) -> DataFrame:
    """Adds reasons and the host's state to links.

    links carry identity_decision_ids; claims: claim_id, revision, scope, mentions, kind, tested_mentions; identity: decision_id, status,
    variant_ids. Identity is checked only for links that claim an exact match. Every listed decision must resolve to just the link's allele.
    """
    each = links.select("link_id", "variant_id", F.explode_outer("identity_decision_ids").alias("decision_id")).join(identity.select("decision_id", "status", "variant_ids"), "decision_id", "left")
    agreed = F.coalesce((F.col("status") == "resolved") & (F.size("variant_ids") == 1) & (F.element_at("variant_ids", 1) == F.col("variant_id")), F.lit(False))
    resolved = each.groupBy("link_id").agg(F.bool_and(agreed).alias("identity_ok"))
    j = links.join(claims.select("claim_id", F.col("revision").alias("claim_revision"), "scope", "mentions", "kind", "tested_mentions"), ["claim_id", "claim_revision"], "left")
    j = j.join(resolved, "link_id", "left").join(located.select("claim_id", F.col("ok").alias("located")), "claim_id", "left")
    exact = F.col("identity_match").isin(*EXACT_MATCHES)
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("located", F.lit(False)), "citation_location"),
            F.when(exact & (F.col("scope") != "variant"), "claim_scope"),
            F.when(exact & ~F.coalesce("identity_ok", F.lit(False)), "identity_decision"),
            F.when(exact & ~F.coalesce(F.array_contains("mentions", F.col("mention_id")), F.lit(False)), "mention_not_reported"),
            F.when(exact & (F.col("kind") == "functional_experiment") & ~F.coalesce(F.array_contains("tested_mentions", F.col("mention_id")), F.lit(False)), "mention_not_tested"),
        )
    )
    return j.withColumn("reasons", reasons).withColumn("host_state", F.when(F.size("reasons") > 0, "rejected").otherwise("mechanically_valid")).drop("identity_ok", "located")


#: Fixed value: why a link to an allele out of scope cannot contribute.
OUT_OF_SCOPE = "allele outside declared consequence scope"


def scoped_checks(checked: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """Links after mechanical_checks with `checks`, a map of names to pass or fail. A link to an allele out of scope is judged by scope alone: its claim stays, but it is rejected.

    out_of_scope: (variant_id) of the alleles that left the registry, repeated or not.
    """
    gone = out_of_scope.select("variant_id", F.lit(True).alias("__gone")).distinct()
    j = checked.join(gone, "variant_id", "left")
    out = F.coalesce("__gone", F.lit(False))
    named = F.transform("reasons", lambda r: F.struct(r.alias("key"), F.lit("fail").alias("value")))
    passed = F.when(F.size("reasons") > 0, F.map_from_entries(named)).otherwise(F.map_from_arrays(F.array(F.lit("mechanical")), F.array(F.lit("pass"))))
    return j.select(
        *(c for c in checked.columns if c not in ("reasons", "host_state")), F.when(out, F.map_from_arrays(F.array(F.lit("scope")), F.array(F.lit("fail")))).otherwise(passed).alias("checks"),
        F.when(out, F.array(F.lit(OUT_OF_SCOPE))).otherwise(F.col("reasons")).alias("reasons"), F.when(out, "rejected").otherwise(F.col("host_state")).alias("host_state"),
    )


def effective_state(log: DataFrame, by: list[str], state: str = "effective_state", reviewer: str = "reviewer_type", human_review: str = "human_review", sequence: str = "sequence") -> DataFrame:
    """The state of each link (or other group) of a decision log, in one pass of combinable aggregates.

    Host rejection, then human rejection, win outright; otherwise the last human state, then the last state of anyone but
    the host; a machine cannot grant human acceptance.
    """
    s, who, order = F.col(state), F.col(reviewer), F.col(sequence)
    human, other = who == "human", who != "host"
    folded = log.groupBy(*by).agg(
        F.bool_or((who == "host") & (s == "rejected")).alias("__host_no"),
        F.bool_or(human & ((F.col(human_review) == "rejected") | (s == "rejected"))).alias("__human_no"),
        F.max_by(F.when(human, s), F.when(human, order)).alias("__human"),
        F.max_by(F.when(other, s), F.when(other, order)).alias("__other"),
    )
    outcome = (
        F.when(F.col("__host_no") | F.coalesce("__human_no", F.lit(False)), "rejected")
        .when(F.col("__human").isNotNull(), F.col("__human"))
        .when(F.col("__other").isNull(), "mechanically_valid")
        .when(F.col("__other") == "accepted_human", "quarantined")
        .otherwise(F.col("__other"))
    )
    return folded.select(*by, outcome.alias("state"))


def link_states(links: DataFrame, log: DataFrame) -> DataFrame:
    """links with their state; a link without decisions is a draft."""
    states = effective_state(log, ["link_id", "claim_revision"])
    return links.join(states, ["link_id", "claim_revision"], "left").withColumn("state", F.coalesce("state", F.lit("draft")))


def must_match(left: DataFrame, right: DataFrame, on: list[str], message: str) -> DataFrame:
    """Inner join that fails the job if a left row has no partner."""
    marked = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    return marked.where(F.coalesce(F.col("__there"), F.raise_error(F.lit(message)).cast("boolean"))).drop("__there")


def host_decisions(links: DataFrame, log: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """New host rows for checked links, numbered on from the log's last sequence in the order of the ordinal column."""
    base = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("base"))
    rows = numbered(links, ordinal, "__n").crossJoin(F.broadcast(base))  # one row
    return rows.select("link_id", "claim_id", "claim_revision", F.lit("host").alias("reviewer_type"), F.lit("unreviewed").alias("human_review"), F.col("host_state").alias("effective_state"), (F.col("base") + F.col("__n")).alias("sequence"))


def out_of_scope_links(log: DataFrame) -> DataFrame:
    """(n): distinct links with a failing scope check; checks is a map of names to results."""
    return log.where(F.try_element_at("checks", F.lit("scope")) == "fail").agg(F.count_distinct("link_id").alias("n"))


def one_kind_of_source(snapshots: DataFrame, synthetic: bool) -> DataFrame:
    """snapshots, unless synthetic and real sources are mixed: then the job fails."""
    ok = F.coalesce(F.col("is_synthetic") == F.lit(synthetic), F.lit(False))
    return snapshots.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("synthetic and real sources are mixed: "), F.col("snapshot_id"))).cast("boolean")))


def provenance(mentions: DataFrame, decisions: DataFrame, accepted: DataFrame, effects: DataFrame) -> DataFrame:
    """(variant_id, routes, refs, lit, hgvs_c, hgvs_p): where an allele was found, as sorted sets.

    mentions: mention_id, route, source_refs; decisions: mention_id, status, variant_ids; accepted: variant_id, publication, kind, perturbation_type,
    outcome_type; effects: variant_id, hgvs_c, hgvs_p of the selected transcript. Only resolved mentions count.
    """
    resolved = decisions.where("status = 'resolved'").select("mention_id", F.element_at("variant_ids", 1).alias("variant_id"))
    none = F.array().cast("array<string>")
    found = mentions.join(resolved, "mention_id").groupBy("variant_id").agg(F.collect_set("route").alias("routes"), F.flatten(F.collect_list(F.coalesce("source_refs", none))).alias("refs"))
    detail = F.when(F.col("perturbation_type").isNotNull(), F.concat_ws("/", "perturbation_type", "outcome_type")).otherwise(F.col("kind"))
    papers = accepted.where(F.startswith("publication", F.lit("PMID:"))).groupBy("variant_id").agg(F.collect_set(F.concat(F.col("publication"), F.lit(" "), F.col("kind"), F.lit(":"), detail)).alias("lit"))
    tail = lambda c: F.element_at(F.split(F.coalesce(c, F.lit("")), ":"), -1)
    j = found.join(papers, "variant_id", "full").join(effects.select("variant_id", tail("hgvs_c").alias("hgvs_c"), tail("hgvs_p").alias("hgvs_p")), "variant_id", "full")
    whole = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return j.select("variant_id", whole("routes").alias("routes"), whole("refs").alias("refs"), whole("lit").alias("lit"), F.coalesce("hgvs_c", F.lit("")).alias("hgvs_c"), F.coalesce("hgvs_p", F.lit("")).alias("hgvs_p"))
