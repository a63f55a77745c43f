"""Document triage and text evidence: rules, priorities, quotes, windows, passages, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.functions import text as TX
from evirank.functions.text import squashed
from evirank.operators.folds import capped, folded, next_fit
from evirank.operators.ranking import first_match

REVIEW_TYPES = ("Review", "Systematic Review", "Meta-Analysis", "Editorial", "Comment")


def rule_fields(docs: DataFrame) -> DataFrame:
    """Adds rule_review, access and supplement from a document's flags."""
    full = F.coalesce("is_open_access", F.lit(False)) & F.coalesce("in_pmc", F.lit(False))
    return (
        docs.withColumn("rule_review", F.coalesce(F.arrays_overlap("pub_types", F.array(*map(F.lit, REVIEW_TYPES))), F.lit(False)))
        .withColumn("access", F.when(full, "full_text_open").when(F.length(F.coalesce("abstract", F.lit(""))) > 0, "abstract_only").otherwise("metadata_only"))
        .withColumn("supplement", F.when(F.coalesce("has_suppl", F.lit(False)), F.when(full, "available").otherwise("needs_access")).otherwise("none"))
    )


# The reason that goes with each priority, in the order in which the rules are tried.
UNSCREENED = (
    ("body_alleles", "P2", "full text names variant(s) near the gene"),
    ("named_open", "P4", "LitVar link not confirmed in full text"),
    ("named", "P3", "LitVar links named variants; full text unavailable to confirm"),
    ("discussed", "P3", "gene discussed in full text"),
    ("unfinished", "P3", "gene in abstract; LLM screen not completed"),
    ("out_of_reach", "P4", "gene only outside the abstract and full text unavailable: not assessable"),
    (None, "P4", "incidental mention"),
)
SCREENED = (
    ("other_gene", "P5", "not about the human gene"),
    ("review", "P4", "review/commentary: pointer only"),
    ("common", "P4", "common_snp_association: not germline rare-allele evidence"),
    ("somatic", "P4", "somatic_cancer: not germline rare-allele evidence"),
    ("engineered", "P3", "engineered mutants: mechanism, not patient alleles"),
    ("rare_tested", "P1", "allele-level functional experiment on patient variants"),
    ("rare_cohort", "P1", "rare variants in patients/cohorts"),
    ("rare", "P2", "rare variants reported"),
    ("some", "P3", "variants reported, class unclear"),
    ("cohort", "P2", "gene-level patient/cohort study (supplements may list alleles)"),
    ("about", "P3", "gene-level mechanism/model study"),
    (None, "P4", "unclear relevance"),
)


def judged(named: Column, body_alleles: Column, open_text: Column, mentions: Column, in_abstract: Column, error: Column, screened: Column, human: Column, review: Column, kind: Column, functional: Column, cohort: Column, reported: Column) -> Column:
    """A struct of priority, P1 to P5, and reason, by two decision lists: one for documents without a screening answer, one for those with."""
    allele = reported.isin("specific_alleles_named", "variants_reported_not_named") | named
    rare = kind == "rare_coding_or_splice"
    tests = {
        "body_alleles": body_alleles, "named_open": named & open_text, "named": named, "discussed": mentions >= 3, "unfinished": in_abstract & error, "out_of_reach": ~open_text & ~in_abstract,
        "other_gene": human == "no", "review": review, "common": kind == "common_snp_association", "somatic": kind == "somatic_cancer", "engineered": kind == "engineered_mutation", "rare_tested": (functional == "yes") & rare,
        "rare_cohort": allele & rare & (cohort == "yes"), "rare": allele & rare, "some": (functional == "yes") | allele, "cohort": cohort == "yes", "about": human == "yes",
    }
    told = lambda p, r: F.struct(F.lit(p).alias("priority"), F.lit(r).alias("reason"))
    pick = lambda rules: first_match([(F.coalesce(tests[t], F.lit(False)), told(p, r)) for t, p, r in rules[:-1]], told(*rules[-1][1:]))
    return F.when(screened, pick(SCREENED)).otherwise(pick(UNSCREENED))


def priority(*args: Column, **named: Column) -> Column:
    """P1 to P5 alone."""
    return judged(*args, **named)["priority"]


def quote_found(text: Column, quote: Column, least: int = 8) -> Column:
    """The squashed quote stands in the squashed text and is long enough to mean something."""
    return F.contains(squashed(text), squashed(quote)) & (F.length(quote) > least)


def verify_claims(claims: DataFrame, passages: DataFrame, owner: Column) -> DataFrame:
    """Adds a locator (start, end) or the reason of rejection. claims: claim_id, unit_id, quote, allele; passages: unit_id, text."""
    j = claims.join(passages, "unit_id", "left")
    text, quote = F.regexp_replace("text", r"\s+", " "), F.trim(F.regexp_replace("quote", r"\s+", " "))
    at = F.instr(text, quote)
    reason = F.when(F.col("text").isNull(), "unknown_passage").when((F.length(quote) < 10) | (at == 0), "quote_not_found").when(F.instr(text, F.col("allele")) == 0, "allele_not_in_passage").when(~owner, "other_gene")
    return j.withColumn("reason", reason).withColumn("start", F.when(reason.isNull(), at - 1)).withColumn("end", F.when(reason.isNull(), at - 1 + F.length(quote)))


def select_passages(df: DataFrame, by: str, order: list[str], size: str, max_units: int, max_chars: int) -> DataFrame:
    """(by, order, size, kept): greedy choice in order; what does not fit is skipped and later ones may still fit. Groups may be larger than memory."""
    return folded(df, [by], order, size, (0, 0), capped(max_units, max_chars), "kept", "boolean").withColumnRenamed(size, "size")


def greedy_bins(df: DataFrame, by: str, order: list[str], size: str, capacity: int) -> DataFrame:
    """(by, order, size, bin): next-fit in order within each group; a row larger than a bin has one to itself. Groups may be larger than memory."""
    return folded(df, [by], order, size, (0, 0), next_fit(capacity), "bin", "bigint").withColumnRenamed(size, "size")


def cached_and_remaining(requests: DataFrame, cache: DataFrame, key: str, age: Column | None = None, ttl: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests that a cache answers, and the rest. ttl: None is always live, infinity never expires."""
    if ttl is None:
        return requests.limit(0), requests
    fresh = cache if ttl == float("inf") or age is None else cache.where(age <= ttl)
    keys = fresh.select(key).distinct()
    return requests.join(keys, key, "left_semi"), requests.join(keys, key, "left_anti")


def replayed(requests: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Requests with the last recorded answer to each digest; a missing one fails the job when strict."""
    last = records.groupBy("request_digest").agg(F.max_by("text", "attempt").alias("text"), F.max("attempt").alias("attempt"))
    j = requests.join(last, "request_digest", "left")
    if strict:
        j = j.where(F.coalesce(F.col("text").isNotNull() | F.raise_error(F.concat(F.lit("no record of "), F.col("request_digest"))).cast("boolean"), F.lit(True)))
    fenced = F.regexp_extract("text", r"(?s)```(?:json)?\s*(.*?)```", 1)
    return j.withColumn("json", F.when(F.length(fenced) > 0, F.regexp_replace(fenced, r"\s+$", "")).otherwise(F.col("text"))).withColumn("parsed", F.try_parse_json("json").isNotNull())


def deep_flags(priority_: Column, access: Column, screened: Column, quote_ok: Column, error: Column) -> tuple[Column, Column]:
    """(whether a document is to be read in depth, its flags)."""
    wanted = priority_.isin("P1", "P2")
    deep = wanted & (access == "full_text_open")
    flags = F.array_compact(F.array(F.when(screened & ~quote_ok, "quote_not_found_in_abstract"), F.when(error.isNotNull(), F.concat(F.lit("screen_error:"), error)), F.when(wanted & ~deep, "needs_manual_access")))
    return deep, flags


def document_order(year: Column, pmid: Column) -> list[Column]:
    """Latest year first (what is no number counts as 0), then the id as text."""
    number = F.when(year.rlike("^[0-9]+$"), year.try_cast("int"))
    return [F.coalesce(number, F.lit(0)).desc(), pmid.cast("string").asc()]


def passage_class(units: DataFrame, by: str, text: str, alias: str) -> DataFrame:
    """Adds class: 0 for units with an alias and a notation, 1 for an alias alone, 2 for others that hold a notation of the first two; null for the rest."""
    named = F.col(text).rlike(alias)
    own = units.withColumn("__named", named).withColumn("__notes", TX.notations(F.col(text)))
    notes = own.where("__named").groupBy(by).agg(F.array_distinct(F.flatten(F.collect_list("__notes"))).alias("__all"))
    also = F.exists(F.coalesce("__all", F.array().cast("array<string>")), lambda n: F.contains(F.col(text), n))
    j = own.join(notes, by, "left")
    return j.withColumn("class", F.when(F.col("__named") & (F.size("__notes") > 0), 0).when(F.col("__named"), 1).when(also, 2)).drop("__named", "__notes", "__all")


def scanned_units(units: DataFrame, by: list[str], text: str, aliases: list[str]) -> DataFrame:
    """(by, notation, transcript, context): notations in units that name the gene, where the nearest gene before each is that gene; each once for its unit."""
    hits = units.where(TX.names_gene(F.col(text), aliases))
    found = F.concat(TX.matches_at(F.col(text), TX.CODING), TX.matches_at(F.col(text), TX.PROTEIN))
    each = hits.select(*by, F.col(text).alias("__text"), F.explode(found).alias("m")).where(TX.owned_by(F.col("__text"), F.col("m.at"), aliases))
    transcript = F.nullif(F.regexp_extract("__text", TX.TRANSCRIPT, 1), F.lit(""))
    named = each.select(*by, F.trim(F.translate("m.text", "()", "")).alias("notation"), transcript.alias("transcript"), F.substring("__text", 1, 200).alias("context"))
    return named.groupBy(*by, "notation").agg(F.min("transcript").alias("transcript"), F.min("context").alias("context"))


def literature_claims(extracted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims as they are assembled from extracted ones (claim_no, pmid, kind, scope, perturbation, outcome, quote, mentions): kinds and outcomes
    are mapped, a claim without a resolved mention (resolved: mention_id) is about the gene, and carriers' backgrounds are flagged."""
    each = extracted.select("claim_no", F.explode("mentions").alias("mention_id")).join(resolved.select("mention_id").distinct(), "mention_id").groupBy("claim_no").agg(F.array_sort(F.collect_set("mention_id")).alias("known"))
    none = F.array().cast("array<string>")
    j = extracted.join(each, "claim_no", "left").withColumn("known", F.coalesce("known", none))
    own = (F.col("scope") == "variant") & (F.size("known") > 0)
    kind = F.when(F.col("kind").isin("functional_experiment", "patient_observation"), F.col("kind")).otherwise("review_summary")
    tested = kind == "functional_experiment"
    how = F.when(F.col("perturbation") == "not_an_experiment", "other").otherwise(F.col("perturbation"))
    return j.select(
        F.concat(F.lit("c_lit_"), F.col("pmid").cast("string"), F.lit("_"), F.col("claim_no").cast("string")).alias("claim_id"), kind.alias("evidence_kind"), F.when(own, "variant").otherwise("gene").alias("scope"),
        F.when(own, F.col("known")).otherwise(none).alias("mentions"), F.substring("quote", 1, 400).alias("claim_text"), F.concat(F.lit("PMID:"), F.col("pmid").cast("string")).alias("publication"),
        F.when(tested, how).alias("perturbation_type"), F.when(tested, F.when(F.col("outcome") == "not_applicable", "inconclusive").otherwise(F.col("outcome"))).alias("outcome_type"),
        F.when(tested & (how == "carrier_comparison"), F.array(F.lit("patient_genetic_background"))).otherwise(none).alias("confound_flags"),
    )


def structured(requests: DataFrame, records: DataFrame, fields: str) -> DataFrame:
    """requests with the parsed reply (a struct of the fields), or why there is none: the first attempt, else one repair.

    records: request_digest, attempt, text. Replies may stand in a fence; a reply that is no JSON object of these fields counts as failed.
    """
    fenced = F.regexp_extract("text", r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(F.length(fenced) > 0, fenced).otherwise(F.col("text")))
    parsed = F.when(F.try_parse_json(body).isNotNull() & F.startswith(body, F.lit("{")), F.from_json(body, fields))
    tried = records.where("attempt <= 2").withColumn("reply", parsed).groupBy("request_digest").agg(F.min_by("reply", F.when(F.col("reply").isNotNull(), F.col("attempt"))).alias("reply"), F.count("*").alias("attempts"))
    j = requests.join(tried, "request_digest", "left")
    return j.withColumn("failure", F.when(F.col("attempts").isNull(), "snapshot_missing").when(F.col("reply").isNull(), "not_structured"))
