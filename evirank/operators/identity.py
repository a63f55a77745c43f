"""From free-form mentions to canonical alleles: unnest, classify, normalise, merge, and record what is excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.canonical import content_id, variant_id
from evirank.sources.sequences import CHUNK, windows_of

MAX_INDEL, FLANK = 50, 1000
ALLOWED = ("snv", "deletion", "insertion", "delins")
_PROTEIN = r"^(p\.)?\(?[A-Z][a-z]{0,2}[0-9]+([A-Z][a-z]{0,2}|\*|=|fs)"
_RSID = r"^rs[0-9]+"


def classify_text(text: Column) -> Column:
    """Status that free text alone implies: a protein change is unsupported, a dbSNP id insufficient, anything else null."""
    t = F.trim(text)
    return F.when(t.rlike(_PROTEIN), "unsupported").when(t.rlike(_RSID), "insufficient")


def allele_type(ref: Column, alt: Column) -> Column:
    same = F.substring(ref, 1, 1) == F.substring(alt, 1, 1)
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), "snv").when(r == a, "mnv").when((a == 1) & (r > 1) & same, "deletion").when((r == 1) & (a > 1) & same, "insertion").otherwise("delins")
    )


def split_multiallelic(mentions: DataFrame, id_col: str = "mention_id", alt_col: str = "alt") -> DataFrame:
    """One row for each comma-separated alternative; several get the suffixes .1, .2 and so on and keep their parent's id."""
    alts = F.split(F.coalesce(F.col(alt_col), F.lit("")), ",")
    out = mentions.select("*", F.size(alts).alias("__n"), F.posexplode(alts).alias("__i", "__alt"))
    many = F.col("__n") > 1
    return (
        out.withColumn("parent_mention_id", F.when(many, F.col(id_col)))
        .withColumn(id_col, F.when(many, F.concat_ws(".", F.col(id_col), (F.col("__i") + 1).cast("string"))).otherwise(F.col(id_col)))
        .withColumn(alt_col, F.when(many, F.trim("__alt")).otherwise(F.col(alt_col)))
        .drop("__n", "__i", "__alt")
    )


def _first_index(stop, most: Column) -> Column:
    """The least i in 0..most for which stop(i) holds or i = most."""
    return F.get(F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | stop(i)), 0)


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i + 1, 1)


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row: the optimiser copies expressions into what uses them, but not through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def left_align(df: DataFrame, flank: str, pos: str, ref: str, alt: str) -> DataFrame:
    """Adds la_pos, la_ref, la_alt. flank: the reference bases that end just before pos.

    Closed form: cut the common suffix; if an allele is empty then, the change is a string s that may move left by as many bases as the
    flank, read backwards, agrees with s repeated backwards; s is rotated by that shift and anchored on the base before it. Otherwise the
    common prefix is cut to leave one base. Null where the flank is used up.
    """
    r, a, f = F.col(ref), F.col(alt), F.col(flank)
    least = F.least(F.length(r), F.length(a))
    rr, ra = F.reverse(r), F.reverse(a)
    cut = evaluated(df, {"__s": _first_index(lambda i: _at(rr, i) != _at(ra, i), least)})
    cut = evaluated(cut, {"__r": F.substring(r, F.lit(1), F.length(r) - F.col("__s")), "__a": F.substring(a, F.lit(1), F.length(a) - F.col("__s"))})
    kept_r, kept_a = F.col("__r"), F.col("__a")
    empty = (F.length(kept_r) == 0) | (F.length(kept_a) == 0)
    cut = cut.withColumn("__u", F.concat(kept_r, kept_a)).withColumn("__n", F.length("__u"))
    u, n = F.reverse(F.col("__u")), F.col("__n")
    rf = F.reverse(f)
    shift = _first_index(lambda i: _at(rf, i) != _at(u, i % n), F.length(f))
    cut = evaluated(cut, {"__k": F.when(empty & (n > 0), shift)})
    k = F.col("__k")
    turn = k % n
    rotated = F.concat(F.substring(F.col("__u"), n - turn + 1, turn), F.substring(F.col("__u"), F.lit(1), n - turn))
    anchor = F.when(k < F.length(f), F.substring(f, F.length(f) - k, F.lit(1)))
    most = F.least(F.length(kept_r), F.length(kept_a)) - 1
    cut = evaluated(cut, {"__p": F.when(~empty, _first_index(lambda i: _at(kept_r, i) != _at(kept_a, i), F.greatest(most, F.lit(0))))})
    p = F.col("__p")
    out = evaluated(cut, {
        "la_pos": F.when(empty, F.when(anchor.isNotNull(), F.col(pos) - k - 1)).otherwise(F.col(pos) + p),
        "la_ref": F.when(empty, F.concat(anchor, F.when(F.length(kept_r) > 0, rotated).otherwise(""))).otherwise(F.expr("substring(__r, __p + 1)")),
        "la_alt": F.when(empty, F.concat(anchor, F.when(F.length(kept_a) > 0, rotated).otherwise(""))).otherwise(F.expr("substring(__a, __p + 1)")),
    })
    return out.drop("__s", "__r", "__a", "__u", "__n", "__k", "__p")


def normalise(mentions: DataFrame, contigs: DataFrame, assembly: str, allowed=ALLOWED, max_indel: int = MAX_INDEL, flank: int = FLANK) -> DataFrame:
    """Adds identity_status, reason, variant_id and the normalised allele.

    contigs: (chrom, accession, offset, sequence), offset being the 1-based place of the first base. The first guard that fails names the
    status. Only `flank` bases before the change are looked at; a run that uses them up is unmapped. Few contigs are sent to all executors only below
    the session's broadcast threshold; the join is on the contig name otherwise.
    """
    c = contigs.select(F.col("chrom").alias("__chrom"), "accession", "offset", "sequence")
    return _judged(mentions.join(c, mentions["chrom"] == c["__chrom"], "left").drop("__chrom"), assembly, allowed, max_indel, flank)


def normalise_in_ranges(mentions: DataFrame, ranges: DataFrame, contigs: DataFrame, assembly: str, allowed=ALLOWED, max_indel: int = MAX_INDEL, flank: int = FLANK, chunk: int = CHUNK) -> DataFrame:
    """normalise() where sequences are chunks (sources.sequences) and contigs (chrom, accession, offset) are only declared: each distinct place reads its own bases."""
    return _judged(windows_of(mentions, ranges, contigs, flank, chunk), assembly, allowed, max_indel, flank)


def _judged(j: DataFrame, assembly: str, allowed, max_indel: int, flank: int) -> DataFrame:
    j = j.withColumn("ref", F.upper("ref")).withColumn("alt", F.upper("alt"))
    at = F.col("pos") - F.col("offset")
    inside = (at >= 0) & (at + F.length("ref") <= F.length("sequence"))
    low = F.greatest(F.lit(0), at - flank)
    j = evaluated(j, {
        "__ref_there": F.when(inside, F.expr("substring(sequence, cast(pos - offset + 1 as int), length(ref))")),
        "__flank": F.when(inside, F.substring(F.col("sequence"), (low + 1).cast("int"), (at - low).cast("int"))).otherwise(""),
    })
    j = left_align(j, "__flank", "pos", "ref", "alt")
    dna = r"^[ACGT]+$"
    kind = allele_type(F.col("la_ref"), F.col("la_alt"))
    guards = [
        (F.col("assembly") != assembly, "unsupported", "assembly differs"),
        (F.col("accession").isNull(), "unmapped", "contig unknown"),
        (~(F.col("ref").rlike(dna) & F.col("alt").rlike(dna)), "unsupported", "not plain bases"),
        (F.col("ref") == F.col("alt"), "insufficient", "no change"),
        (~inside, "unmapped", "outside the reference"),
        (F.col("__ref_there") != F.col("ref"), "ref_mismatch", "reference base differs"),
        (F.col("la_pos").isNull(), "unmapped", "left end of the reference reached"),
        (~kind.isin(*allowed), "unsupported", "allele type not allowed"),
        (F.abs(F.length("la_ref") - F.length("la_alt")) > max_indel, "unsupported", "longer than allowed"),
    ]
    status = reason = None
    for test, name, why in guards:
        test = F.coalesce(test, F.lit(True))
        status = F.when(test, name) if status is None else status.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    out = evaluated(j.drop("identity_status", "reason"), {"identity_status": status.otherwise("resolved"), "reason": reason})
    good = F.col("identity_status") == "resolved"
    out = evaluated(out.drop("allele_type", "variant_id"), {"allele_type": F.when(good, kind), "variant_id": F.when(good, variant_id(F.col("assembly"), F.col("accession"), F.col("la_pos"), F.col("la_ref"), F.col("la_alt")))})
    return out.drop("__ref_there", "__flank", "sequence", "offset")


def resolve(mentions: DataFrame, contigs: DataFrame, assembly: str, **options) -> DataFrame:
    """normalise(), with rows that lack coordinates judged by their given status or their text."""
    whole = F.col("assembly").isNotNull() & F.col("chrom").isNotNull() & F.coalesce(F.col("pos") > 0, F.lit(False)) & F.col("ref").isNotNull() & F.col("alt").isNotNull()
    with_place = normalise(mentions.where(whole), contigs, assembly, **options)
    status = F.coalesce("resolution_status", classify_text(F.col("raw_text")), F.lit("insufficient"))
    without = mentions.where(~whole).withColumn("identity_status", status).withColumn("reason", F.coalesce("resolution_note", F.lit("no complete genomic coordinates")))
    return with_place.unionByName(without, allowMissingColumns=True)


def decisions(resolved: DataFrame) -> DataFrame:
    """One identity decision for each mention."""
    return resolved.select(
        content_id("idd_", F.concat_ws("|", "mention_id", F.coalesce("variant_id", "identity_status")), 24).alias("decision_id"), "mention_id", F.col("identity_status").alias("status"),
        F.when(F.col("variant_id").isNotNull(), F.array("variant_id")).otherwise(F.array().cast("array<string>")).alias("variant_ids"),
        F.when(F.coalesce(F.col("pos") > 0, F.lit(False)), "genomic_normalisation").otherwise("text_classification").alias("mapping_method"), F.col("reason").alias("justification"),
    )


def registry(resolved: DataFrame) -> DataFrame:
    """Alleles with their aliases in order of arrival and all roles of their mentions."""
    return (
        resolved.where("variant_id is not null")
        .groupBy("variant_id")
        .agg(
            F.first("assembly").alias("assembly"), F.first("accession").alias("accession"), F.first("chrom").alias("chrom"), F.first("la_pos").alias("pos"), F.first("la_ref").alias("ref"), F.first("la_alt").alias("alt"), F.first("allele_type").alias("allele_type"),
            F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "mention_id", "raw_text"))), lambda x: F.struct(x["raw_text"].alias("raw_value"), x["mention_id"].alias("mention_id"))).alias("aliases"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("roles", F.array().cast("array<string>")))))).alias("roles"),
        )
    )


def exclusions(resolved: DataFrame) -> DataFrame:
    """What did not resolve, and why; nothing is dropped silently."""
    return resolved.where("variant_id is null").select("mention_id", F.col("identity_status").alias("status"), "reason")


def scope_filter(variants: DataFrame, terms: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, out of scope): rows whose terms meet none of the allowed ones leave; rows without terms stay."""
    ok = F.col(terms).isNull() | F.arrays_overlap(F.col(terms), F.array(*map(F.lit, allowed)))
    return variants.where(ok), variants.where(~ok).withColumn("status", F.lit("out_of_scope"))


def annotation_keys(annotations: DataFrame, contigs: DataFrame, assembly: str, ranges: DataFrame | None = None, **options) -> DataFrame:
    """annotations (allele, ...) with the variant_id of their allele, normalised by the same closed form as mentions; one that cannot be normalised fails the job.

    allele is a struct of chrom, pos, ref and alt. With `ranges`, contigs are only declared and sequences are read by chunk.
    """
    own = [c for c in annotations.columns if c != "allele"]
    rows = annotations.select(F.struct(*own).alias("__row"), F.col("allele.chrom").alias("chrom"), F.col("allele.pos").alias("pos"), F.col("allele.ref").alias("ref"), F.col("allele.alt").alias("alt"), F.lit(assembly).alias("assembly"))
    known = normalise(rows, contigs, assembly, **options) if ranges is None else normalise_in_ranges(rows, ranges, contigs, assembly, **options)
    said = F.concat(F.lit("an annotation's allele cannot be normalised: "), F.concat_ws(" ", F.coalesce("chrom", F.lit("-")), F.coalesce(F.col("pos").cast("string"), F.lit("-")), F.coalesce("ref", F.lit("-")), F.coalesce("alt", F.lit("-")), "reason"))
    return known.where(F.when(F.col("variant_id").isNull(), F.raise_error(said).cast("boolean")).otherwise(True)).select("variant_id", "__row.*")


def annotated(registry: DataFrame, keyed: DataFrame) -> DataFrame:
    """Alleles of the registry with their annotations; annotations of other alleles take no part."""
    return registry.join(keyed, "variant_id")


def scope_exclusions(registry: DataFrame, keyed: DataFrame, decisions: DataFrame, terms: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(registry within scope, exclusions): alleles none of whose selected terms is allowed leave, and each of their mentions is told why.

    An allele without annotation stays. decisions: those of mentions, with variant_ids. Exclusions are (mention_id, decision_id, status, reason, variant_id).
    """
    meets = F.arrays_overlap(F.coalesce(F.col(terms), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    judged = keyed.groupBy("variant_id").agg(F.bool_or(F.coalesce(meets, F.lit(False))).alias("__in"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(terms), F.array().cast("array<string>")))))), ",").alias("__terms"))
    out = judged.where(~F.col("__in")) if allowed else judged.limit(0)
    gone = registry.select("variant_id").join(out, "variant_id")
    what = F.when(F.col("__terms") == "", "no consequence on the selected transcript").otherwise(F.concat(F.lit("consequence "), F.col("__terms")))
    told = decisions.where("status = 'resolved'").select("mention_id", "decision_id", F.explode("variant_ids").alias("variant_id")).join(gone, "variant_id")
    reasons = told.select("mention_id", "decision_id", F.lit("out_of_scope").alias("status"), F.concat(what, F.lit(" outside declared scope")).alias("reason"), "variant_id")
    return registry.join(gone.select("variant_id"), "variant_id", "left_anti"), reasons
