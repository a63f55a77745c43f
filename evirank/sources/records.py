"""Parsers of saved source replies: projections from their JSON, so that no network is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.schema import absent, present


def spdi_to_vcf(df: DataFrame, spdi: str, base: str) -> DataFrame:
    """Adds accession, pos, ref, alt. base: the reference base before the change, used where one allele is empty."""
    parts = F.split(F.col(spdi), ":")
    at, ref, alt = F.get(parts, F.lit(1)).cast("bigint"), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    empty = (F.length(ref) == 0) | (F.length(alt) == 0)
    return (
        df.withColumn("accession", F.get(parts, F.lit(0))).withColumn("pos", F.when(empty, at).otherwise(at + 1))
        .withColumn("ref", F.when(empty, F.concat(F.col(base), ref)).otherwise(ref)).withColumn("alt", F.when(empty, F.concat(F.col(base), alt)).otherwise(alt))
    )


def joint_frequency(exome: Column, genome: Column) -> Column:
    """Allele counts over numbers of both call sets that pass (no filter, some alleles); null if none does."""

    def part(call: Column, name: str) -> Column:
        ok = call.isNotNull() & (F.coalesce(F.size(call["filters"]), F.lit(0)) <= 0) & (F.coalesce(call["an"], F.lit(0)) > 0)
        return F.when(ok, call[name]).otherwise(0)

    return F.try_divide((part(exome, "ac") + part(genome, "ac")).cast("double"), part(exome, "an") + part(genome, "an"))


TRUNCATING = ("stop_gained", "frameshift_variant")


def annotation(df: DataFrame, effect: str, snapshot: Column) -> DataFrame:
    """Adds nmd, splice_delta and alphamissense, each with why it is not there.

    effect: a struct with consequence_terms, lof_info (key:value pairs), alphamissense (a score) and the four splice deltas DS_AG, DS_AL, DS_DG,
    DS_DL. Decay is a question for truncating changes only, a missense score for missense changes only; the splice delta needs all four.
    """
    e = F.col(effect)
    rule = F.try_element_at(F.str_to_map(F.coalesce(e["lof_info"], F.lit("")), F.lit(","), F.lit(":")), F.lit("50_BP_RULE"))
    truncating = F.arrays_overlap(e["consequence_terms"], F.array(*map(F.lit, TRUNCATING)))
    nmd = F.when(~truncating, absent("not_applicable", "string", "not_truncating")).when(rule == "PASS", present(F.lit("triggers"), snapshot)).when(rule == "FAIL", present(F.lit("escapes"), snapshot)).otherwise(absent("not_available", "string", "no_decay_rule"))
    deltas = [e[n] for n in ("DS_AG", "DS_AL", "DS_DG", "DS_DL")]
    whole = deltas[0].isNotNull() & deltas[1].isNotNull() & deltas[2].isNotNull() & deltas[3].isNotNull()
    splice = F.when(whole, present(F.greatest(*deltas).cast("double"), snapshot)).otherwise(absent("not_available", reason="no_splice_score"))
    missense = F.array_contains(e["consequence_terms"], "missense_variant")
    score = F.when(~missense, absent("not_applicable", reason="not_missense")).when(e["alphamissense"].isNotNull(), present(e["alphamissense"].cast("double"), snapshot)).otherwise(absent("not_available", reason="no_missense_score"))
    return df.withColumn("nmd", nmd).withColumn("splice_delta", splice).withColumn("alphamissense", score)


def transcript_effects(consequences: Column, gene_id: str, selected: str) -> Column:
    """Effects on the transcripts of one gene, by transcript id; the selected transcript is flagged. consequences: an array of structs with gene_id,
    transcript_id, hgvsc, hgvsp and consequence_terms."""
    own = F.filter(consequences, lambda t: t["gene_id"] == gene_id)

    def effect(t: Column) -> Column:
        name = F.coalesce(F.nullif(F.substring_index(t["hgvsc"], ":", 1), F.lit("")), t["transcript_id"])
        return F.struct(name.alias("transcript_id"), t["hgvsc"].alias("hgvs_c"), t["hgvsp"].alias("hgvs_p"), t["consequence_terms"].alias("consequences"), (t["transcript_id"] == selected).alias("selected_display"))

    return F.array_sort(F.transform(own, effect))


def functional_domain(start: Column, end: Column, regions: Column, snapshot: Column) -> Column:
    """Whether a protein place lies in a region, and why that is not known; regions: null where the isoform could not be mapped."""
    return F.when(start.isNull(), absent("not_applicable", "boolean", "no_protein_position")).when(regions.isNull(), absent("not_available", "boolean", "isoform_not_mapped")).otherwise(present(in_regions(start, end, regions), snapshot))


def region_names(start: Column, end: Column, regions: Column) -> Column:
    """Names of the regions that meet [start, end], sorted, with a semicolon between; null if none."""
    met = F.filter(regions, lambda r: (r["start"] <= F.coalesce(end, start)) & (start <= r["end"]))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(met, lambda r: r["name"]))), "; "), F.lit(""))


def in_regions(start: Column, end: Column, regions: Column) -> Column:
    """Whether [start, end] meets any of an array of {start, end}; a missing end is the start."""
    return F.exists(regions, lambda r: (r["start"] <= F.coalesce(end, start)) & (start <= r["end"]))


def functional_regions(features: Column) -> Column:
    """Domains, motifs, and regions that describe an interaction."""
    return F.filter(features, lambda f: f["type"].isin("Domain", "Motif") | ((f["type"] == "Region") & F.startswith(f["description"], F.lit("Interaction with"))))


def positional_rows(rows: Column, fields: list[str]) -> Column:
    """Arrays of values as maps from field names."""
    return F.transform(rows, lambda r: F.map_from_arrays(F.array(*map(F.lit, fields)), r))


def recoder_status(df: DataFrame, spdis: str) -> DataFrame:
    """Adds status and spdi: a notation that maps to just one place is unique."""
    n = F.size(F.array_distinct(F.coalesce(F.col(spdis), F.array().cast("array<string>"))))
    status = F.when(F.col(spdis).isNull(), "unsupported").when(n == 0, "unmapped").when(n == 1, "unique").otherwise("ambiguous")
    return df.withColumn("status", status).withColumn("spdi", F.when(n == 1, F.element_at(F.array_distinct(F.col(spdis)), 1)))


def mechanism_rule(df: DataFrame, haploinsufficiency: str, burden_p: str, odds: str, accepted: tuple[str, ...] = ("3", "2"), most_p: float = 0.05) -> DataFrame:
    """Loss of function by curated dosage, else by burden; unknown otherwise. Values that are not numbers are ignored."""
    p, ratio = F.col(burden_p).try_cast("double"), F.col(odds).try_cast("double")
    rule = F.when(F.col(haploinsufficiency).isin(*accepted), "loss_of_function").when((p <= most_p) & (ratio > 1), "loss_of_function").otherwise("unknown")
    return df.withColumn("mechanism", rule)


def literature_pool(routes: list[DataFrame]) -> DataFrame:
    """One row for each document of several routes (pmid, route, variant): its routes and variants as sorted sets."""
    union = routes[0]
    for r in routes[1:]:
        union = union.unionByName(r, allowMissingColumns=True)
    return union.groupBy("pmid").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.array_sort(F.collect_set("variant")).alias("variants"))


def exactly_one(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of groups that have just one; null where there are several."""
    return df.groupBy(*by).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v")).select(*by, F.when(F.col("n") == 1, F.col("v")).alias(value))


def only_one(df: DataFrame, by: list[str], value: str, message: str) -> DataFrame:
    """exactly_one(), where a group with no or several values fails the job."""
    one = exactly_one(df, by, value)
    return one.where(F.when(F.col(value).isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def main_transcripts(genes: DataFrame) -> DataFrame:
    """(gene_id, transcript_id): the one transcript of each gene that carries the main label; none or several fail the job.

    genes: gene_id, transcripts (an array of structs with id and labels).
    """
    labelled = genes.select("gene_id", F.explode(F.filter("transcripts", lambda t: F.array_contains(t["labels"], "MANE_Select"))).alias("t")).select("gene_id", F.col("t.id").alias("transcript_id"))
    every = genes.select("gene_id").join(labelled, "gene_id", "left")
    return only_one(every, ["gene_id"], "transcript_id", "no single main transcript")


def checked_sequences(replies: DataFrame) -> DataFrame:
    """(chrom, start, end, seq) in upper case; a sequence that is not as long as its region fails the job."""
    fits = F.length("seq") == F.col("end") - F.col("start") + 1
    return replies.where(F.when(fits, True).otherwise(F.raise_error(F.lit("sequence length does not match the region")).cast("boolean"))).withColumn("seq", F.upper("seq"))


def complete_lists(replies: DataFrame) -> DataFrame:
    """(query, id) of search replies (query, count, ids); a reply that lists fewer ids than it counts fails the job."""
    whole = F.col("count").cast("bigint") == F.size("ids")
    return replies.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("truncated list for "), F.col("query"))).cast("boolean"))).select("query", F.explode("ids").alias("id"))


def checked_reply(replies: DataFrame) -> DataFrame:
    """Replies without errors; one with errors fails the job, with its first 300 characters."""
    bad = F.coalesce(F.size("errors"), F.lit(0)) > 0
    return replies.where(F.when(bad, F.raise_error(F.substring(F.array_join("errors", "; "), 1, 300)).cast("boolean")).otherwise(True))


def classification(record: Column) -> Column:
    """Accession, description, review status and the sorted distinct traits of a classification record."""
    g = record["germline_classification"]
    traits = F.array_sort(F.array_distinct(F.filter(F.transform(g["trait_set"], lambda t: t["trait_name"]), lambda t: F.coalesce(t, F.lit("")) != "")))
    none = F.array().cast("array<string>")
    return F.struct(record["accession"].alias("accession"), F.nullif(g["description"], F.lit("")).alias("description"), F.nullif(g["review_status"], F.lit("")).alias("review_status"), F.coalesce(traits, none).alias("traits"))


def gene_symbols(record: Column) -> Column:
    return F.array_distinct(F.transform(record["genes"], lambda g: g["symbol"]))


def merged_classifications(alleles: DataFrame, records: DataFrame) -> DataFrame:
    """alleles (variant_id) with the distinct descriptions of their records (variant_id, description) as one sorted text; null without any."""
    said = records.where("description is not null").groupBy("variant_id").agg(F.array_join(F.array_sort(F.collect_set("description")), "; ").alias("classification"))
    return alleles.join(said, "variant_id", "left")


def headed_rows(lines: DataFrame, column: str, mark: str, ordinal: str) -> DataFrame:
    """Rows of a tab-separated text whose header is the comment line that begins with mark, as maps; other comments are skipped."""
    head = lines.where(F.startswith(F.col(column), F.lit(mark))).orderBy(F.desc(ordinal)).select(F.expr(f"substring({column}, 2)").alias("h"), F.col(ordinal).alias("o")).first()
    if head is None:
        raise ValueError(f"no header that begins with {mark}")
    names = head["h"].split("\t")
    cells = F.split(F.col(column), "\t", -1)
    body = lines.where((F.col(ordinal) > head["o"]) & ~F.startswith(F.col(column), F.lit("#")) & (F.col(column) != ""))
    return body.select(*(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)))


def counted_rows(rows: DataFrame, fields: list[str], group_fields: list[str]) -> DataFrame:
    """(index, record, counts) of rows of values (index, values, groups): only those with one group of counts; index is kept for pointers."""
    named = lambda names, c: F.map_from_arrays(F.array(*map(F.lit, names)), c)
    return rows.where(F.size("groups") == 1).select("index", named(fields, F.col("values")).alias("record"), named(group_fields, F.element_at("groups", 1)).alias("counts"))


def recoder_input(name: Column, transcript: str, protein: str) -> Column:
    """What to ask a recoder for a notation; null where it does not determine a change of DNA."""
    return F.when(F.startswith(name, F.lit("p.")) & ~F.contains(name, F.lit("fs")), F.concat(F.lit(protein + ":"), name)).when(F.startswith(name, F.lit("c.")), F.concat(F.lit(transcript + ":"), name))


def stated_deletion_fits(name: Column, spdi: Column) -> Column:
    """Whether the bases that a notation says are deleted are as many as its place loses."""
    stated = F.regexp_extract(name, "del([ACGT]+)$", 1)
    parts = F.split(spdi, ":")
    return (stated == "") | (F.length(F.get(parts, F.lit(2))) - F.length(F.get(parts, F.lit(3))) == F.length(stated))


def recoded(replies: DataFrame) -> DataFrame:
    """(input, spdis): the sorted distinct places of each input over all replies (input, spdi array); inputs are matched by name."""
    return replies.groupBy("input").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spdi")))).alias("spdis"))


def resolved_notations(items: DataFrame, mapped: DataFrame, accession: str, transcript: str, protein: str) -> DataFrame:
    """items (mention_id, name, kind) with status, spdi and note: one place on the accession is a candidate, several are ambiguous, so is a
    stated deletion of another length, none is unmapped, and what no recoder can be asked is unsupported."""
    asked = items.withColumn("input", F.when(F.col("kind") == "rsid", F.col("name")).otherwise(recoder_input(F.col("name"), transcript, protein)))
    j = asked.join(mapped, "input", "left")
    own = F.filter(F.coalesce("spdis", F.array().cast("array<string>")), lambda x: F.startswith(x, F.lit(accession + ":")))
    j = j.withColumn("own", own).withColumn("spdi", F.get("own", F.lit(0)))
    fits = stated_deletion_fits(F.col("name"), F.col("spdi"))
    status = F.when(F.col("input").isNull(), "unsupported").when(F.size("own") == 0, "unmapped").when((F.size("own") > 1) | ~fits, "ambiguous").otherwise("candidate")
    return j.withColumn("status", status).withColumn("spdi", F.when(F.col("status") == "candidate", F.col("spdi"))).drop("own", "spdis")


def cursor_pages(pages: DataFrame, most: int = 5000) -> DataFrame:
    """(query, id) of a cursor-paged search from saved pages (query, cursor, next_cursor, ids): from the cursor * on, until a page is empty, has no next
    cursor or repeats its own, or until `most` records are there. One step for each page of the longest search."""
    now = pages.where("cursor = '*'").select("query", "next_cursor", "cursor", "ids", F.size("ids").cast("bigint").alias("seen"))
    found, left = now, True
    while left:
        ahead = now.where((F.size("ids") > 0) & F.col("next_cursor").isNotNull() & (F.col("next_cursor") != F.col("cursor")) & (F.col("seen") < most))
        ahead = ahead.select("query", F.col("next_cursor").alias("cursor"), "seen").join(pages, ["query", "cursor"])
        now = ahead.select("query", "next_cursor", "cursor", "ids", (F.col("seen") + F.size("ids")).alias("seen"))
        left = not now.isEmpty()
        found = found.unionAll(now) if left else found
    return found.select("query", F.explode("ids").alias("id"))


def numbered_pages(pages: DataFrame, most: int = 100) -> DataFrame:
    """(query, id) of a search in numbered pages (query, page, total_pages, ids): up to the page count that the first page states and up to `most`."""
    first = pages.where("page = 1").select("query", F.coalesce(F.col("total_pages").cast("int"), F.lit(0)).alias("total"))
    return pages.join(first, "query").where(F.col("page") <= F.least(F.greatest(F.col("total"), F.lit(1)), F.lit(most))).select("query", F.explode("ids").alias("id"))


def seeded(cache: DataFrame, snapshots: DataFrame, prefixes: list[str]) -> DataFrame:
    """cache (request_key, source, version, body, digest, retrieved_at) with the snapshots of an earlier run whose record ids begin with one of the
    prefixes and whose bodies still have their digests; what is cached already stays."""
    wanted = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("record_id"), p))
    fine = snapshots.where(wanted & F.col("request_key").isNotNull() & (F.sha2("body", 256) == F.col("digest")))
    return cache.unionByName(fine.select(*cache.columns).dropDuplicates(["request_key"]).join(cache.select("request_key"), "request_key", "left_anti").select(*cache.columns))


def recorded_blobs(replies: DataFrame, order: str) -> DataFrame:
    """(snapshot_id, digest, file, ...): one row for each distinct body, the first by order; its name is its digest."""
    digest = F.sha2("body", 256)
    ending = F.when(F.col("media_type") == "application/json", ".json").when(F.col("media_type") == "application/zip", ".zip").otherwise(".txt")
    named = replies.withColumn("digest", digest).withColumn("snapshot_id", F.concat(F.lit("snap_"), digest)).withColumn("file", F.concat(F.col("source"), F.lit("_"), F.substring(digest, 1, 16), ending))
    first = named.groupBy("snapshot_id").agg(F.min_by(F.struct(*named.columns), F.col(order)).alias("r"))
    return first.select("r.*")


#: A population source's reply about one gene, as far as it is read.
POPULATION = """struct<errors:array<struct<message:string>>,data:struct<gene:struct<gene_id:string,gnomad_constraint:struct<pli:double,oe_lof:double,oe_lof_lower:double,oe_lof_upper:double>,
variants:array<struct<variant_id:string,pos:bigint,ref:string,alt:string,exome:struct<ac:bigint,an:bigint,filters:array<string>>,genome:struct<ac:bigint,an:bigint,filters:array<string>>>>>>>"""


def population_variants(replies: DataFrame, body: str = "body") -> DataFrame:
    """(gene_id, variant_id, pos, ref, alt, frequency, reason) of whole replies; a reply that reports errors, or has no gene, fails the job.

    The frequency joins the calls that pass their filters; without one it is null, and the reason says so.
    """
    parsed = replies.select(F.from_json(body, POPULATION, {"mode": "FAILFAST"}).alias("r"))
    wrong = F.when(F.size(F.coalesce("r.errors", F.array().cast("array<struct<message:string>>"))) > 0, F.concat(F.lit("invalid reply: "), F.substring(F.to_json("r.errors"), 1, 300))).when(F.col("r.data.gene").isNull(), F.lit("invalid reply: no gene"))
    sound = parsed.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True))
    each = sound.select(F.col("r.data.gene.gene_id").alias("gene_id"), F.explode("r.data.gene.variants").alias("v")).select("gene_id", "v.*")
    frequency = joint_frequency(F.col("exome"), F.col("genome"))
    return each.select("gene_id", "variant_id", "pos", "ref", "alt", frequency.alias("frequency"), F.when(frequency.isNull(), "no_passing_call").alias("reason"))
