"""Queries over identity, evidence checks, saved replies, literature, exports, evaluation and the composite profile on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from evirank import bundle
from evirank.functions import text as TX
from evirank.operators import composite as CO
from evirank.operators import evaluation as EL
from evirank.operators import evidence as EV
from evirank.operators import features as FE
from evirank.operators import identity as ID
from evirank.operators import literature as LI
from evirank.operators import ranking as RA
from evirank.plans.star import read
from evirank.schema import absent, observed_valid, present
from evirank.sources import records as RE
from evirank.sources import replies as RP

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- identity ------------------------------------------------------------------------------------------------------

_SEQ = "GCTACCAAAAAATGTGTGTGCCATCATCATCATGGGACCTTAGACAGACAGAAA"
_MENTION = f"""SELECT CAST(p_partkey AS STRING) AS mention_id, p_name AS raw_text, CASE WHEN p_partkey % 11 = 0 THEN 'T1' ELSE 'T2' END AS assembly, CASE WHEN p_partkey % 13 = 0 THEN '9' ELSE '1' END AS chrom,
  CASE WHEN p_partkey % 17 = 0 THEN 500 WHEN p_partkey % 19 = 0 THEN 0 ELSE p_size END AS pos, CASE WHEN p_partkey % 7 = 0 THEN 'N' WHEN p_partkey % 5 = 0 THEN 'G' ELSE substr('{_SEQ}', p_size, 1) END AS ref,
  CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'C' ELSE 'T' END AS alt, p_partkey AS ordinal, CASE WHEN p_partkey % 23 = 0 THEN 'ambiguous' END AS resolution_status FROM part"""
_STATUS = f"""m AS ({_MENTION}), s AS (SELECT *, CASE WHEN pos <= 0 THEN coalesce(resolution_status, 'insufficient') WHEN assembly <> 'T2' THEN 'unsupported' WHEN chrom <> '1' THEN 'unmapped' WHEN ref = 'N' THEN 'unsupported' WHEN ref = alt THEN 'insufficient'
  WHEN pos > 54 THEN 'unmapped' WHEN substr('{_SEQ}', pos, 1) <> ref THEN 'ref_mismatch' ELSE 'resolved' END AS status FROM m)"""


def resolved_parts(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    mentions = spark.sql(_MENTION).withColumn("resolution_note", F.lit(None).cast("string")).withColumn("roles", F.array(F.when(F.col("ordinal") % 2 == 0, "comparison").otherwise("seed")))
    mentions = mentions.withColumn("pos", F.col("pos").cast("bigint")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    contigs = spark.createDataFrame([("1", "NC_1", 1, _SEQ)], "chrom string, accession string, offset bigint, sequence string")
    return ID.resolve(mentions, contigs, "T2")


@query(f"WITH {_STATUS} SELECT mention_id, status, CASE WHEN status = 'resolved' AND pos > 0 THEN 1 ELSE 0 END AS n_variants, CASE WHEN pos > 0 THEN 'genomic_normalisation' ELSE 'text_classification' END AS mapping_method FROM s")
def identity_decisions(spark, sf_dir):
    return ID.decisions(resolved_parts(spark, sf_dir)).select("mention_id", "status", F.size("variant_ids").alias("n_variants"), "mapping_method")


@query(f"WITH {_STATUS} SELECT mention_id, status FROM s WHERE status <> 'resolved'")
def exclusion_rows(spark, sf_dir):
    return ID.exclusions(resolved_parts(spark, sf_dir)).select("mention_id", "status")


@query(f"""WITH {_STATUS} SELECT CAST(pos AS BIGINT) AS pos, ref, alt, string_agg(mention_id, ',' ORDER BY ordinal) AS mentions, string_agg(DISTINCT CASE WHEN ordinal % 2 = 0 THEN 'comparison' ELSE 'seed' END, ',') AS roles_seen, 'snv' AS allele_type
  FROM s WHERE status = 'resolved' GROUP BY 1, 2, 3""".replace("string_agg(DISTINCT CASE WHEN ordinal % 2 = 0 THEN 'comparison' ELSE 'seed' END, ',')", "array_to_string(list_sort(list_distinct(list(CASE WHEN ordinal % 2 = 0 THEN 'comparison' ELSE 'seed' END))), ',')"))
def allele_registry(spark, sf_dir):
    r = ID.registry(resolved_parts(spark, sf_dir))
    return r.select("pos", "ref", "alt", F.array_join(F.transform("aliases", lambda a: a["mention_id"]), ",").alias("mentions"), F.array_join("roles", ",").alias("roles_seen"), "allele_type")


@query("SELECT p_partkey, ref, alt, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = length(alt) THEN 'mnv' WHEN length(alt) = 1 AND ref[1] = alt[1] THEN 'deletion' WHEN length(ref) = 1 AND ref[1] = alt[1] THEN 'insertion' ELSE 'delins' END AS allele_type FROM (SELECT p_partkey, left(p_name, 1 + p_size % 3) AS ref, left(p_type, 1 + p_partkey % 3) AS alt FROM part)")
def allele_types_of_parts(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.expr("left(p_name, 1 + p_size % 3)").alias("ref"), F.expr("left(p_type, cast(1 + p_partkey % 3 as int))").alias("alt"))
    return parts.withColumn("allele_type", ID.allele_type(F.col("ref"), F.col("alt")))


# ---- evidence ------------------------------------------------------------------------------------------------------

@query("""SELECT CAST(doc_id AS VARCHAR) AS claim_id, CASE WHEN doc_id % 7 = 0 THEN 'snapshot_missing' WHEN doc_id % 5 = 0 THEN 'snapshot_altered' WHEN doc_id % 3 = 0 THEN 'text_digest_differs' WHEN doc_id % 2 = 0 AND substr(text, 3, 9) <> substr(text, 4, 9) THEN 'excerpt_differs' END AS reason FROM documents WHERE length(text) > 40""")
def locator_checks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("length(text) > 40")
    n, own = F.col("doc_id"), F.col("doc_id").cast("string")
    digest = F.sha2("text", 256)
    snapshots = docs.where(n % 7 != 0).select(own.alias("snapshot_id"), "text", F.when(n % 5 == 0, "other").otherwise(digest).alias("digest"))
    excerpt = F.when(n % 2 == 0, F.expr("substr(text, 4, 9)")).otherwise(F.expr("substr(text, 3, 9)"))
    locators = docs.select(own.alias("claim_id"), F.lit("text_span").alias("kind"), own.alias("snapshot_id"), F.lit(2).alias("start"), F.lit(11).alias("end"), excerpt.alias("excerpt"), F.when(n % 3 == 0, "other").otherwise(digest).alias("text_digest"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("expected_value_digest"))
    return EV.check_locators(locators, snapshots).select("claim_id", F.get("reasons", F.lit(0)).alias("reason"))


_LINK = """SELECT CAST(o_orderkey AS VARCHAR) AS link_id, o_orderkey AS k, o_custkey AS c, o_orderkey % 5 = 0 AS unlocated, o_orderkey % 4 <> 0 AS exact, o_orderkey % 3 = 0 AS geneclaim, o_orderkey % 7 = 0 AS undecided, o_orderkey % 11 = 0 AS unreported, o_orderkey % 13 = 0 AS functional, o_orderkey % 2 = 0 AS untested FROM orders"""


@query(f"""SELECT link_id, concat_ws(',', CASE WHEN unlocated THEN 'citation_location' END, CASE WHEN exact AND geneclaim THEN 'claim_scope' END, CASE WHEN exact AND undecided THEN 'identity_decision' END, CASE WHEN exact AND unreported THEN 'mention_not_reported' END,
  CASE WHEN exact AND functional AND untested THEN 'mention_not_tested' END) AS reasons, CASE WHEN unlocated OR (exact AND (geneclaim OR undecided OR unreported OR (functional AND untested))) THEN 'rejected' ELSE 'mechanically_valid' END AS host_state FROM ({_LINK})""")
def mechanical_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    own, none = k.cast("string"), F.array().cast("array<string>")
    orders = read(spark, sf_dir, "orders")
    variant, mention = F.concat(F.lit("v"), F.col("o_custkey").cast("string")), F.concat(F.lit("m"), own)
    links = orders.select(own.alias("link_id"), own.alias("claim_id"), F.lit(1).alias("claim_revision"), variant.alias("variant_id"), mention.alias("mention_id"), F.when(k % 4 != 0, "exact_genomic").otherwise("gene_only").alias("identity_match"), F.array(own).alias("identity_decision_ids"))
    claims = orders.select(own.alias("claim_id"), F.lit(1).alias("revision"), F.when(k % 3 == 0, "gene").otherwise("variant").alias("scope"), F.when(k % 11 == 0, none).otherwise(F.array(mention)).alias("mentions"), F.when(k % 13 == 0, "functional_experiment").otherwise("association").alias("kind"), F.when(k % 2 == 0, none).otherwise(F.array(mention)).alias("tested_mentions"))
    identity = orders.select(own.alias("decision_id"), F.when(k % 7 == 0, "ambiguous").otherwise("resolved").alias("status"), F.array(variant).alias("variant_ids"))
    located = orders.select(own.alias("claim_id"), (k % 5 != 0).alias("ok"))
    return EV.mechanical_checks(links, claims, identity, located).select("link_id", F.array_join("reasons", ",").alias("reasons"), "host_state")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS link_id, CASE WHEN o_totalprice > 300000 THEN 'rejected' ELSE 'mechanically_valid' END AS effective_state, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS sequence FROM orders")
def host_sequence(spark, sf_dir):
    links = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("link_id"), F.lit("c").alias("claim_id"), F.lit(1).alias("claim_revision"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_totalprice") > 300000, "rejected").otherwise("mechanically_valid").alias("host_state"))
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"))
    return EV.host_decisions(links, log).select("link_id", "effective_state", "sequence")


@query("SELECT count(DISTINCT user_id) AS n FROM events WHERE value < 10 AND event_type <> 'click'")
def failing_scope_links(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    checks = F.when(F.col("event_type") != "click", F.create_map(F.lit("scope"), F.when(F.col("value") < 10, "fail").otherwise("pass"))).otherwise(F.create_map(F.lit("other"), F.lit("fail")))
    return EV.out_of_scope_links(events.select(F.col("user_id").alias("link_id"), checks.alias("checks")))


@query("""WITH f AS (SELECT l_partkey AS v, list(DISTINCT l_returnflag) AS r, list(DISTINCT 'S' || l_suppkey) AS s FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1),
a AS (SELECT l_partkey AS v, list(DISTINCT 'PMID:' || l_suppkey || ' functional_experiment:exact_allele_edit/' || CASE l_returnflag WHEN 'A' THEN 'altered' ELSE 'rescue' END) AS l FROM lineitem WHERE l_quantity > 49 AND l_suppkey % 2 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(array_to_string(list_sort(r), ';'), '') AS routes, coalesce(array_to_string(list_sort(s), ';'), '') AS refs, coalesce(array_to_string(list_sort(l), ';'), '') AS lit, 'c.' || p_size || 'A>G' AS hgvs_c FROM part LEFT JOIN f ON f.v = p_partkey LEFT JOIN a ON a.v = p_partkey""")
def provenance_sets(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    mention = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    mentions = lines.select(mention.alias("mention_id"), F.col("l_returnflag").alias("route"), F.array(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("source_refs"))
    decisions = lines.select(mention.alias("mention_id"), "l_partkey").distinct().select("mention_id", F.when(F.col("l_partkey") % 3 != 0, "resolved").otherwise("unmapped").alias("status"), F.array("l_partkey").alias("variant_ids"))
    accepted = lines.where("l_quantity > 49").select(F.col("l_partkey").alias("variant_id"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "PMID:").otherwise("X:"), F.col("l_suppkey").cast("string")).alias("publication"), F.lit("functional_experiment").alias("kind"), F.lit("exact_allele_edit").alias("perturbation_type"), F.when(F.col("l_returnflag") == "A", "altered").otherwise("rescue").alias("outcome_type"))
    effects = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), F.concat(F.lit("NM_1.2:c."), F.col("p_size").cast("string"), F.lit("A>G")).alias("hgvs_c"), F.lit(None).cast("string").alias("hgvs_p"))
    out = EV.provenance(mentions, decisions, accepted, effects)
    return out.select(F.col("variant_id").alias("p_partkey"), F.array_join("routes", ";").alias("routes"), F.array_join("refs", ";").alias("refs"), F.array_join("lit", ";").alias("lit"), "hgvs_c")


@query("""WITH e AS (SELECT l_partkey, l_orderkey || '.' || l_linenumber AS link, l_linenumber % 4 <> 0 AS exact, l_returnflag = 'A' AS functional, l_linestatus = 'O' AS installs, l_tax > 0.04 AS altered, l_quantity >= 10 AS has_cases, l_discount > 0.05 AS controlled, CASE l_linenumber % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'related' ELSE 'unrelated' END AS rel FROM lineitem),
t AS (SELECT *, exact AND functional AND installs AS tested, CASE WHEN exact AND NOT functional AND has_cases AND rel = 'exact' AND controlled THEN 3 WHEN exact AND NOT functional AND has_cases AND rel = 'exact' THEN 2 WHEN exact AND NOT functional AND has_cases AND rel = 'related' THEN 1 ELSE 0 END AS tier FROM e)
SELECT l_partkey, CASE WHEN bool_or(tested AND altered) THEN 'characterized_altered' WHEN bool_or(tested) THEN 'characterized_other' ELSE 'uncharacterized' END AS characterization, max(tier) AS o_tier, bool_or(exact AND functional AND NOT installs) AS carrier_only,
  coalesce(array_to_string(list_sort(list_distinct(list(link) FILTER (WHERE tier > 0))), ','), '') AS observation FROM t GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    line = F.col("l_linenumber")
    evidence = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("variant_id"), F.concat_ws(".", F.col("l_orderkey").cast("string"), line.cast("string")).alias("link_id"), F.when(line % 4 != 0, "exact_genomic").otherwise("same_residue").alias("identity_match"), F.when(F.col("l_returnflag") == "A", "functional_experiment").otherwise("association").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "exact_allele_edit").otherwise("carrier_comparison").alias("perturbation_type"), F.when(F.col("l_tax") > 0.04, "altered").otherwise("rescue").alias("outcome_type"), F.when(F.col("l_quantity") >= 10, 1).otherwise(0).alias("cases"), (F.col("l_discount") > 0.05).alias("controls_known"),
        F.when(line % 3 == 0, "exact").when(line % 3 == 1, "related").otherwise("unrelated").alias("disease_relationship"),
    )
    out = FE.evidence_summary(evidence)
    seen = F.coalesce(F.array_join(F.try_element_at("contributing_link_ids", F.lit("observation")), ","), F.lit(""))
    return out.select(F.col("variant_id").alias("l_partkey"), "characterization", "o_tier", "carrier_only", seen.alias("observation"))


@query("SELECT event_id, '{\"a/b\": [{\"1\": ' || event_id || '}, \"' || event_type || '\"], \"q\": {\"0\": ' || user_id || '}}' AS doc, CAST(event_id AS VARCHAR) AS deep, event_type AS second, CAST(user_id AS VARCHAR) AS digit_key FROM events")
def json_pointer_deep(spark, sf_dir):
    doc = F.concat(F.lit('{"a/b": [{"1": '), F.col("event_id").cast("string"), F.lit('}, "'), F.col("event_type"), F.lit('"], "q": {"0": '), F.col("user_id").cast("string"), F.lit("}}"))
    rows = read(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", "doc", EV.json_pointer(F.col("doc"), "/a~1b/0/1").alias("deep"), EV.json_pointer(F.col("doc"), "/a~1b/1").alias("second"), EV.json_pointer(F.col("doc"), "/q/0").alias("digit_key"))


@query("SELECT p_partkey, p_size % 4 <> 3 AS valid FROM part")
def observed_rules(spark, sf_dir):
    n = F.col("p_size") % 4
    o = F.when(n == 0, present(F.col("p_retailprice"), F.lit("s"))).when(n == 1, absent("failed", reason="http_error")).when(n == 2, absent("not_searched")).otherwise(absent("failed"))
    return read(spark, sf_dir, "part").select("p_partkey", observed_valid(o).alias("valid"))


# ---- exports -------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey, p_partkey || ',' || CASE WHEN p_size % 2 = 0 THEN '"' || p_name || ', a ""quoted"" part"' ELSE p_name END || ',' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS line FROM part""")
def csv_lines(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(', a "quoted" part'))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", bundle.csv_line([F.col("p_partkey"), name, F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))]).alias("line"))


@query("SELECT p_partkey, format('{:g}', p_retailprice) AS price, format('{:g}', p_retailprice / 1e7) AS tiny, format('{:g}', p_retailprice * p_size * 1000.0) AS large FROM part")
def general_numbers(spark, sf_dir):
    price = F.col("p_retailprice")
    return read(spark, sf_dir, "part").select("p_partkey", TX.general(price).alias("price"), TX.general(price / 1e7).alias("tiny"), TX.general(price * F.col("p_size") * 1000.0).alias("large"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS variant_id, CASE WHEN p_size % 7 = 0 THEN 'control' ELSE 'discovery' END AS primary_channel, 'missense' AS stratum, CASE WHEN p_size % 4 = 0 THEN 'not_available' ELSE format('{:g}', p_retailprice / 1000) END AS "P",
  'observation:' || p_size || ',' || p_brand AS contributing_link_ids, CASE WHEN p_partkey % 2 = 0 THEN 'a;b' ELSE '' END AS discovery_routes, 'K=partial|O=none' AS ordering_tuple, 'nomination_v0.1' AS policy_id FROM part""")
def ranked_table_cells(spark, sf_dir):
    parts, none = read(spark, sf_dir, "part"), F.array().cast("array<string>")
    key, missing = F.col("p_partkey").cast("string"), F.col("p_size") % 4 == 0
    ranked = parts.select(
        key.alias("variant_id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 7 == 0, "control").otherwise("discovery").alias("channel"), F.lit("missense").alias("stratum"), F.lit(1).alias("tier_rank"), F.lit("t1").alias("tie_group_id"), F.lit(1).alias("tie_group_size"), F.lit(1).alias("display_index"),
        F.lit("partial").alias("k"), F.lit("class").alias("k_basis"), F.lit("none").alias("o"), F.lit("alphamissense").alias("p_predictor"), F.when(missing, "not_available").otherwise("value_present").alias("p_status"), F.when(~missing, F.col("p_retailprice") / 1000).alias("p"),
        F.array(F.lit("K=partial"), F.lit("O=none")).alias("ordering_tuple"), F.lit("uncharacterized").alias("characterization"), F.array(F.lit("discovery")).alias("roles"), none.alias("consequence_terms"), none.alias("flags"), F.create_map(F.lit("observation"), F.array(F.col("p_size").cast("string"), F.col("p_brand"))).alias("contributing_link_ids"),
    )
    found = parts.where("p_partkey % 2 = 0").select(key.alias("variant_id"), F.array(F.lit("a"), F.lit("b")).alias("routes"), none.alias("refs"), none.alias("lit"), F.lit("").alias("hgvs_c"), F.lit("").alias("hgvs_p"))
    out = bundle.export_rows(ranked, found, "nomination_v0.1", "provisional", "not_searched")
    return out.select("variant_id", "primary_channel", "stratum", "P", "contributing_link_ids", "discovery_routes", "ordering_tuple", "policy_id")


# ---- saved replies -------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'not_applicable' WHEN p_size % 2 = 0 THEN 'value_present' ELSE 'not_available' END AS nmd_status, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'triggers' ELSE 'escapes' END END AS nmd,
  CASE WHEN p_size % 5 <> 0 THEN greatest(p_size / 100.0, p_partkey % 10 / 10.0) END AS splice, CASE WHEN p_size % 3 = 0 THEN 'not_applicable' WHEN p_size % 7 = 0 THEN 'not_available' ELSE 'value_present' END AS score_status FROM part""")
def effect_annotation(spark, sf_dir):
    n = F.col("p_size")
    rule = F.when(n % 2 == 0, F.concat(F.lit("PERCENTILE:1,50_BP_RULE:"), F.when(n % 4 == 0, "PASS").otherwise("FAIL")))
    effect = F.struct(
        F.array(F.when(n % 3 == 0, "stop_gained").otherwise("missense_variant")).alias("consequence_terms"), rule.alias("lof_info"), F.when(n % 7 != 0, F.lit(0.5)).alias("alphamissense"),
        F.when(n % 5 != 0, n / 100).alias("DS_AG"), (F.col("p_partkey") % 10 / 10).alias("DS_AL"), F.lit(0.0).alias("DS_DG"), F.lit(0.0).alias("DS_DL"),
    )
    out = RE.annotation(read(spark, sf_dir, "part").withColumn("e", effect), "e", F.lit("s"))
    return out.select("p_partkey", F.col("nmd.status").alias("nmd_status"), F.col("nmd.value").alias("nmd"), F.col("splice_delta.value").alias("splice"), F.col("alphamissense.status").alias("score_status"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_size <= 20 AND 5 <= p_size + 3 THEN 'Domain:core' END, CASE WHEN p_size <= 40 AND 18 <= p_size + 3 THEN 'Region:Interaction with X' END) AS names, (p_size <= 20 AND 5 <= p_size + 3) OR (p_size <= 40 AND 18 <= p_size + 3) AS inside FROM part""")
def functional_domains(spark, sf_dir):
    rows = [("Domain", "core", 5, 20), ("Region", "Interaction with X", 18, 40), ("Region", "Disordered", 1, 50), ("Chain", "whole", 1, 99)]
    features = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(d).alias("description"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(f"{t}:{d}").alias("name")) for t, d, a, b in rows))
    regions, start = RE.functional_regions(features), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(RE.region_names(start, start + 3, regions), F.lit("")).alias("names"), RE.functional_domain(start, start + 3, regions, F.lit("s"))["value"].alias("inside"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN NULL ELSE array_to_string(list_sort(list_distinct(list(substr(o_orderpriority, 3)))), '; ') END AS classification FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def merged_classifications(spark, sf_dir):
    found = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("variant_id"), F.expr("substr(o_orderpriority, 3)").alias("description"))
    return RE.merged_classifications(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("variant_id")), found).withColumnRenamed("variant_id", "c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS description, 'a;' || o_orderpriority AS traits FROM orders""")
def classification_records(spark, sf_dir):
    trait = lambda c: F.struct(c.alias("trait_name"))
    record = F.struct(F.col("o_orderkey").cast("string").alias("accession"), F.struct(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("description"), F.lit("").alias("review_status"), F.array(trait(F.col("o_orderpriority")), trait(F.lit("a")), trait(F.lit(None).cast("string")), trait(F.col("o_orderpriority"))).alias("trait_set")).alias("germline_classification"))
    found = RE.classification(record)
    order = F.array_sort(found["traits"], lambda a, b: F.when(a == "a", -1).when(b == "a", 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return read(spark, sf_dir, "orders").select("o_orderkey", found["description"].alias("description"), F.array_join(order, ";").alias("traits"))


_NAME = "CASE p_size % 5 WHEN 0 THEN 'p.R' || p_size || 'C' WHEN 1 THEN 'c.' || p_size || 'delAG' WHEN 2 THEN 'p.R' || p_size || 'fs' WHEN 3 THEN 'rs' || p_partkey ELSE 'c.' || p_size || 'A>G' END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 = 3 THEN NULL ELSE {_NAME} END AS name, CASE p_size % 5 WHEN 0 THEN 'P1:p.R' || p_size || 'C' WHEN 1 THEN 'T1:c.' || p_size || 'delAG' WHEN 4 THEN 'T1:c.' || p_size || 'A>G' END AS asked,
  CASE p_size % 5 WHEN 1 THEN 'c.' || p_size || '_' || (p_size + 1) || 'delAG' WHEN 4 THEN 'c.' || p_size || 'A>G' END AS written_out FROM part""")
def variant_names(spark, sf_dir):
    name, rs = F.expr(_NAME), F.when(F.col("p_size") % 5 == 3, "rs")
    found = TX.named_variant(F.concat(F.lit("litvar@#1#"), name), rs)
    asked = F.when(F.col("p_size") % 5 != 3, RE.recoder_input(name, "T1", "P1"))
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("name"), asked.alias("asked"), F.when(F.startswith(name, F.lit("c.")), TX.expand_single_deletion(name)).alias("written_out"))


@query(f"""WITH m AS (SELECT p_partkey, {_NAME} AS name, p_size FROM part), q AS (SELECT *, p_size % 4 AS n FROM m)
SELECT p_partkey, CASE WHEN p_size % 5 = 2 THEN 'unsupported' WHEN n = 0 THEN 'unmapped' WHEN n >= 2 THEN 'ambiguous' WHEN p_size % 5 = 1 AND p_size % 3 <> 0 THEN 'ambiguous' ELSE 'candidate' END AS status FROM q""")
def notation_resolution(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    items = parts.select("p_partkey", F.col("p_partkey").cast("string").alias("mention_id"), F.expr(_NAME).alias("name"), F.when(F.col("p_size") % 5 == 3, "rsid").otherwise("hgvs").alias("kind"))
    asked = parts.select(F.when(F.col("p_size") % 5 == 3, F.expr(_NAME)).otherwise(RE.recoder_input(F.expr(_NAME), "T1", "P1")).alias("input"), "p_size").where("input is not null").distinct()
    place = lambda i: F.concat(F.lit("NC_1:"), F.lit(i).cast("string"), F.when(F.col("p_size") % 3 == 0, ":AG:").otherwise(":A:"))
    spdi = F.concat(F.slice(F.array(*(place(i) for i in range(3))), F.lit(1), F.col("p_size") % 4), F.array(F.lit("NC_9:1:A:C")))
    return RE.resolved_notations(items, RE.recoded(asked.select("input", spdi.alias("spdi"))), "NC_1", "T1", "P1").select("p_partkey", "status")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) WHERE i <= 3 * (CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 4 END)")
def cursor_pages(spark, sf_dir):
    from pyspark.sql import Window

    numbered = read(spark, sf_dir, "customer").withColumn("page", F.floor((F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1) / 3).cast("int"))  # a nation's customers, as pages
    pages = numbered.groupBy("c_nationkey", "page").agg(F.collect_list("c_custkey").alias("ids"))
    last = F.when(F.col("c_nationkey") % 2 == 0, 1).otherwise(3)
    pages = pages.select(F.col("c_nationkey").alias("query"), F.when(F.col("page") == 0, "*").otherwise(F.col("page").cast("string")).alias("cursor"), F.when(F.col("page") < last, (F.col("page") + 1).cast("string")).alias("next_cursor"), "ids")
    return RE.cursor_pages(pages).select(F.col("query").alias("c_nationkey"), F.col("id").alias("c_custkey"))


@query("SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 6 + 1 <= CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 4 END AND EXISTS (SELECT 1 FROM supplier f WHERE f.s_nationkey = supplier.s_nationkey AND f.s_suppkey % 6 = 0)")
def numbered_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("query"), (F.col("s_suppkey") % 6 + 1).cast("int").alias("page")).agg(F.collect_list("s_suppkey").alias("ids"))
    pages = pages.withColumn("total_pages", F.when(F.col("query") % 2 == 0, 2).otherwise(4))
    return RE.numbered_pages(pages).select(F.col("query").alias("s_nationkey"), F.col("id").alias("s_suppkey"))


@query("""SELECT CAST(event_id AS VARCHAR) AS request_key, CASE WHEN event_id % 10 = 0 THEN 'old' ELSE event_type || user_id END AS body FROM events WHERE event_id % 10 = 0 OR ((event_type = 'click' OR starts_with(event_type, 'sign')) AND event_id % 7 <> 0)""")
def seeded_cache(spark, sf_dir):
    events, key = read(spark, sf_dir, "events"), F.col("event_id").cast("string")
    body = F.concat("event_type", F.col("user_id").cast("string"))
    cache = events.where("event_id % 10 = 0").select(key.alias("request_key"), F.lit("old").alias("body"), F.sha2(F.lit("old"), 256).alias("digest"))
    snapshots = events.select(key.alias("request_key"), body.alias("body"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.sha2(body, 256)).alias("digest"), F.concat("event_type", F.lit("/x")).alias("record_id"))
    return RE.seeded(cache, snapshots, ["click/", "sign"]).select("request_key", "body")


@query("SELECT 'snap_' || sha256(coalesce(text, '')) AS snapshot_id, min(doc_id) AS doc_id, 'web_' || substr(sha256(coalesce(text, '')), 1, 16) || '.txt' AS file FROM documents GROUP BY 1, 3")
def recorded_blobs(spark, sf_dir):
    replies = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.lit("web").alias("source"), F.lit("text/plain").alias("media_type"))
    return RE.recorded_blobs(replies, "doc_id").select("snapshot_id", "doc_id", "file")


@query("""SELECT user_id, max(event_id) FILTER (WHERE event_id % 5 <> 0) AS answered FROM events WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY AND event_id % 5 <> 0 GROUP BY 1""")
def cache_lookup(spark, sf_dir):
    events, key = read(spark, sf_dir, "events"), F.col("user_id").cast("string")
    body = F.col("event_id").cast("string")
    replies = events.select(key.alias("request_key"), F.when(F.col("event_id") % 5 == 0, 500).otherwise(200).alias("status"), F.col("ts").cast("string").alias("retrieved_at"), F.lpad(body, 12, "0").alias("body")).withColumn("digest", F.sha2("body", 256))
    fresh = replies.where(F.to_timestamp("retrieved_at") >= F.expr("timestamp '2024-02-01 00:00:00' - interval 20 days"))
    last = fresh.groupBy("request_key", "status").agg(F.max("body").alias("body"), F.max("retrieved_at").alias("retrieved_at")).withColumn("digest", F.sha2("body", 256))
    hit, _ = RP.lookup(events.select(key.alias("request_key")).distinct(), last, F.lit("2024-02-01 00:00:00").cast("timestamp"), float("inf"))
    return hit.select(F.col("request_key").cast("bigint").alias("user_id"), F.col("body").cast("bigint").alias("answered"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 100 + p_size ELSE 101 + p_size END AS pos, CASE WHEN p_size % 3 = 0 THEN 'G' || 'AT' ELSE 'AT' END AS ref, CASE WHEN p_size % 3 = 0 THEN 'G' ELSE 'C' END AS alt FROM part")
def places_of_spdi(spark, sf_dir):
    spdi = F.concat(F.lit("NC_1:"), (F.col("p_size") + 100).cast("string"), F.when(F.col("p_size") % 3 == 0, ":AT:").otherwise(":AT:C"))
    out = RE.spdi_to_vcf(read(spark, sf_dir, "part").select("p_partkey", spdi.alias("s"), F.lit("G").alias("base")), "s", "base")
    return out.select("p_partkey", F.col("pos").cast("int").alias("pos"), "ref", "alt")


@query("SELECT p_partkey, CASE WHEN p_size % 4 IN (2, 3) THEN 'loss_of_function' WHEN p_size % 5 <> 0 AND p_retailprice / 20000 <= 0.05 AND p_size > 10 THEN 'loss_of_function' ELSE 'unknown' END AS mechanism FROM part")
def mechanism_rules(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).cast("string").alias("h"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise((F.col("p_retailprice") / 20000).cast("string")).alias("p"), (F.col("p_size") / 10).cast("string").alias("o"))
    return RE.mechanism_rule(df, "h", "p", "o").select("p_partkey", "mechanism")


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS n_case FROM part WHERE p_size % 3 <> 0")
def counted_rows(spark, sf_dir):
    groups = F.array_repeat(F.array(F.col("p_size").cast("string"), F.lit("9")), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.array("p_name", "p_brand").alias("values"), groups.alias("groups"))
    return RE.counted_rows(rows, ["name", "brand"], ["n_case", "n_total"]).select(F.col("index").alias("p_partkey"), F.col("record")["name"].alias("name"), F.col("counts")["n_case"].alias("n_case"))


# ---- literature ----------------------------------------------------------------------------------------------------

_GENES = "CASE p_size % 3 WHEN 0 THEN 'SETD1A' WHEN 1 THEN 'SETD 1A' ELSE 'SCN8A' END"


@query(f"""WITH u AS (SELECT p_partkey, {_GENES} AS a, CASE WHEN p_partkey % 4 = 0 THEN 'KMT2D' ELSE 'SETD1A' END AS b, p_size FROM part)
SELECT p_partkey, 'c.' || p_size || 'A>G' AS notation FROM u WHERE a <> 'SCN8A' UNION SELECT p_partkey, 'c.' || (p_size + 100) || 'delAC' FROM u WHERE b = 'SETD1A'""")
def gene_notations(spark, sf_dir):
    n = F.col("p_size")
    text = F.concat(F.expr(_GENES), F.lit(" NM_014712.2 (PVS1) c."), n.cast("string"), F.lit("A>G, then "), F.when(F.col("p_partkey") % 4 == 0, "KMT2D").otherwise("SETD1A"), F.lit(" c."), (n + 100).cast("string"), F.lit("delAC"))
    return LI.scanned_units(read(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text", ["SETD1A"]).select("p_partkey", "notation")


@query("""SELECT doc_id, n_chars % 3 <> 2 AND lang = 'en' AS deep, concat_ws(';', CASE WHEN n_chars % 5 = 0 THEN 'quote_not_found_in_abstract' END, CASE WHEN n_chars % 7 = 0 THEN 'screen_error:refusal' END, CASE WHEN n_chars % 3 <> 2 AND lang <> 'en' THEN 'needs_manual_access' END) AS flags FROM documents""")
def deep_read_flags(spark, sf_dir):
    n = F.col("n_chars")
    deep, flags = LI.deep_flags(F.when(n % 3 == 0, "P1").when(n % 3 == 1, "P2").otherwise("P4"), F.when(F.col("lang") == "en", "full_text_open").otherwise("abstract_only"), F.lit(True), n % 5 != 0, F.when(n % 7 == 0, "refusal"))
    return read(spark, sf_dir, "documents").select("doc_id", deep.alias("deep"), F.array_join(flags, ";").alias("flags"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2000 + doc_id % 20 END DESC, CAST(doc_id AS VARCHAR)) AS position FROM documents")
def document_order(spark, sf_dir):
    from pyspark.sql import Window

    year = F.when(F.col("doc_id") % 4 == 0, "n.d.").otherwise((F.col("doc_id") % 20 + 2000).cast("string"))
    order = Window.partitionBy("source").orderBy(*LI.document_order(year, F.col("doc_id")))
    return read(spark, sf_dir, "documents").select("doc_id", F.row_number().over(order).cast("bigint").alias("position"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 = 0 AS named, 'c.' || (l_linenumber % 2 + 1) || 'A>G' AS note, l_quantity > 25 AS has_note FROM lineitem), k AS (SELECT l_orderkey, list(DISTINCT note) FILTER (WHERE named AND has_note) AS notes FROM u GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN named AND has_note THEN 0 WHEN named THEN 1 WHEN has_note AND list_contains(notes, note) THEN 2 END AS class FROM u JOIN k USING (l_orderkey)""")
def passage_classes(spark, sf_dir):
    line = F.col("l_linenumber")
    text = F.concat(F.when(line % 3 == 0, "in SETD1A ").otherwise("in none "), F.when(F.col("l_quantity") > 25, F.concat(F.lit("c."), (line % 2 + 1).cast("string"), F.lit("A>G"))).otherwise("nothing"))
    units = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    return LI.passage_class(units, "l_orderkey", "text", TX.alias_pattern(["SETD1A"])).drop("text")


@query("""SELECT 'c_lit_' || o_custkey || '_' || o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN 'functional_experiment' WHEN 1 THEN 'patient_observation' ELSE 'review_summary' END AS evidence_kind, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 4 <> 0 THEN 'variant' ELSE 'gene' END AS scope,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'carrier_comparison' END END AS perturbation_type, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'inconclusive' ELSE 'altered' END END AS outcome_type,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS n_flags FROM orders""")
def literature_claims(spark, sf_dir):
    k, mention = F.col("o_orderkey"), F.concat(F.lit("m"), F.col("o_custkey").cast("string"))
    orders = read(spark, sf_dir, "orders")
    extracted = orders.select(
        k.alias("claim_no"), F.col("o_custkey").alias("pmid"), F.when(k % 3 == 0, "functional_experiment").when(k % 3 == 1, "patient_observation").otherwise("background").alias("kind"), F.when(k % 2 == 0, "variant").otherwise("gene").alias("scope"),
        F.when(k % 5 == 0, "not_an_experiment").otherwise("carrier_comparison").alias("perturbation"), F.when(k % 7 == 0, "not_applicable").otherwise("altered").alias("outcome"), F.lit("q").alias("quote"), F.array(mention).alias("mentions"),
    )
    out = LI.literature_claims(extracted, orders.where("o_custkey % 4 <> 0").select(mention.alias("mention_id")))
    return out.select("claim_id", "evidence_kind", "scope", "perturbation_type", "outcome_type", F.size("confound_flags").alias("n_flags"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown_passage' WHEN doc_id % 5 = 0 THEN 'quote_not_found' WHEN doc_id % 3 = 0 THEN 'allele_not_in_passage' WHEN doc_id % 2 = 0 THEN 'other_gene' END AS reason, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 <> 0 THEN 6 END AS at FROM documents""")
def claim_verification(spark, sf_dir):
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    claims = docs.select("doc_id", n.cast("string").alias("claim_id"), n.cast("string").alias("unit_id"), F.when(n % 5 == 0, "short").otherwise(F.concat(F.lit(" quoted   words "), n.cast("string"))).alias("quote"), F.when(n % 3 == 0, "c.9A>G").otherwise("c.1A>G").alias("allele"))
    passages = docs.where(n % 7 != 0).select(n.cast("string").alias("unit_id"), F.concat(F.lit("start quoted  words "), n.cast("string"), F.lit(" with c.1A>G")).alias("text"))
    return LI.verify_claims(claims, passages, n % 2 != 0).select("doc_id", "reason", F.col("start").cast("int").alias("at"))


@query("""SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'snapshot_missing' WHEN conv_id % 3 = 0 THEN 'not_structured' END AS failure, CASE WHEN conv_id % 5 <> 0 AND conv_id % 3 <> 0 THEN CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END END AS answer FROM (SELECT DISTINCT conv_id FROM conversations)""")
def structured_replies(spark, sf_dir):
    convs = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    key, n = F.col("conv_id").cast("string").alias("request_digest"), F.col("conv_id")
    first = convs.where(n % 5 != 0).select(key, F.lit(1).alias("attempt"), F.when((n % 2 == 0) & (n % 3 != 0), '```json\n{"answer": 1}\n```').otherwise("no json {").alias("text"))
    repair = convs.where((n % 5 != 0) & (n % 2 != 0)).select(key, F.lit(2).alias("attempt"), F.when(n % 3 == 0, "still none").otherwise('{"answer": 2}').alias("text"))
    out = LI.structured(convs.select("conv_id", key), first.unionAll(repair), "answer int")
    return out.select("conv_id", "failure", F.col("reply.answer").alias("answer"))


@query("SELECT DISTINCT lower(split_part(p_brand, '/', 1)) AS core FROM part")
def model_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(TX.model_core(F.concat(F.lit("gateway/"), F.col("p_brand"))).alias("core")).distinct()


# ---- evaluation ----------------------------------------------------------------------------------------------------

_MAVE = "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'p.Ala1_Gly2del' ELSE 'p.Ala' || l_partkey || 'Gly' END AS hgvs_pro, CASE WHEN l_discount = 0 THEN 'NA' ELSE CAST(l_discount AS STRING) END AS score FROM lineitem"
_SCORES = "s AS (SELECT 'p.Ala' || l_partkey || 'Gly' AS hgvs_p, avg(l_discount) AS score FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_discount <> 0 GROUP BY 1)"
_ROWS = """r AS (SELECT 'p.Ala' || p_partkey || 'Gly' AS hgvs_p, p_size AS tier, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS k_order, CASE WHEN p_size % 6 <> 0 THEN p_retailprice END AS predicted, p_size % 3 AS c FROM part WHERE p_partkey % 10 <> 0)"""


def measured(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return EL.measured_scores(spark.sql(_MAVE))


def ranked_for_evaluation(spark, sf_dir):
    n = F.col("p_size")
    table = read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("variant_id"), F.when(F.col("p_partkey") % 10 == 0, "control").otherwise("discovery").alias("primary_channel"), F.lit("missense").alias("stratum"), F.concat(F.lit("p.Ala"), F.col("p_partkey").cast("string"), F.lit("Gly")).alias("hgvs_p"),
        n.cast("string").alias("tier_rank"), F.when(n % 4 == 0, "concordant").when(n % 4 == 1, "partial").when(n % 4 == 2, "discordant").otherwise("not_assessable").alias("K"), F.when(n % 6 == 0, "not_available").otherwise(F.col("p_retailprice").cast("string")).alias("P"),
    )
    notes = read(spark, sf_dir, "part").where("p_size % 3 < 2").select(F.col("p_partkey").cast("string").alias("variant_id"), F.when(n % 3 == 0, "Likely pathogenic").otherwise("Benign").alias("classification"))
    return EL.ranked_rows(table, notes)


@query(f"WITH {_SCORES} SELECT hgvs_p, round(score, 6) AS score FROM s")
def measured_scores(spark, sf_dir):
    return measured(spark, sf_dir).select("hgvs_p", F.round("score", 6).alias("score"))


@query(f"WITH {_ROWS} SELECT hgvs_p, tier, k_order, predicted, CASE c WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS lookup FROM r")
def evaluated_rows(spark, sf_dir):
    return ranked_for_evaluation(spark, sf_dir).select("hgvs_p", "tier", "k_order", "predicted", EL.lookup_key(F.col("classification")).alias("lookup"))


@query(f"""WITH {_SCORES}, {_ROWS}, j AS (SELECT *, CASE WHEN score <= 0.045 THEN 1 WHEN score > 0.055 THEN 0 END AS label FROM r JOIN s USING (hgvs_p))
SELECT count(*) AS n_scored, CAST(sum(label) AS BIGINT) AS n_abnormal, CAST(count(label) - sum(label) AS BIGINT) AS n_normal, round(avg(label), 6) AS random_precision FROM j""")
def evaluation_counts(spark, sf_dir):
    scored = EL.scored_rows(ranked_for_evaluation(spark, sf_dir), measured(spark, sf_dir), 0.045, 0.055)
    return EL.class_counts(scored).withColumn("random_precision", F.round("random_precision", 6))


@query(f"""WITH {_SCORES}, {_ROWS}, j AS (SELECT *, CASE WHEN score <= 0.045 THEN 1 WHEN score > 0.055 THEN 0 END AS label FROM r JOIN s USING (hgvs_p)),
k AS (SELECT 'tiers' AS o, CAST(-tier AS DOUBLE) AS key, score, label FROM j UNION ALL SELECT 'predictor_only', coalesce(predicted, -1.0), score, label FROM j UNION ALL SELECT 'domain_only', k_order, score, label FROM j UNION ALL SELECT 'lookup', CASE c WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, score, label FROM j),
a AS (SELECT p.o, avg(CASE WHEN p.key > q.key THEN 1.0 WHEN p.key = q.key THEN 0.5 ELSE 0 END) AS v FROM k p JOIN k q ON p.o = q.o AND p.label = 1 AND q.label = 0 GROUP BY 1),
n AS (SELECT o, key, score, rank() OVER (PARTITION BY o ORDER BY key) + (count(*) OVER (PARTITION BY o, key) - 1) / 2.0 AS x, rank() OVER (PARTITION BY o ORDER BY score) + (count(*) OVER (PARTITION BY o, score) - 1) / 2.0 AS y FROM k),
g AS (SELECT o, key, count(*) AS n, sum(label) AS h FROM k WHERE label IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o ORDER BY key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
t AS (SELECT o, m, sum(CAST(least(greatest(m - b, 0), n) AS DOUBLE) / n * h) AS hits, sum(h) AS h FROM w, (VALUES (10), (25), (50)) AS v(m) GROUP BY 1, 2 HAVING m <= sum(n))
SELECT o AS "order", 'precision@' || m AS measure, round(hits / m, 6) AS value FROM t UNION ALL SELECT o, 'recall@' || m, round(hits / greatest(1, h), 6) FROM t UNION ALL SELECT o, 'auroc' AS measure, round(v, 6) AS value FROM a UNION ALL SELECT o, 'spearman_agreement', round(-corr(x, y), 6) FROM n GROUP BY o UNION ALL SELECT o, 'distinct_keys', CAST(count(DISTINCT key) AS DOUBLE) FROM k GROUP BY o""")
def evaluation_agreement(spark, sf_dir):
    scored = EL.scored_rows(ranked_for_evaluation(spark, sf_dir), measured(spark, sf_dir), 0.045, 0.055)
    return EL.agreement(scored).withColumn("value", F.round("value", 6))


# ---- composite -----------------------------------------------------------------------------------------------------

@query("""SELECT l_partkey, CASE min(CASE WHEN l_linestatus = 'O' AND l_tax > 0.02 THEN l_linenumber % 7 END) WHEN 0 THEN 'de_novo_confirmed' WHEN 1 THEN 'segregates_in_family' WHEN 2 THEN 'de_novo_unconfirmed' WHEN 3 THEN 'case_control_only' WHEN 4 THEN 'single_case_report' ELSE 'none' END AS segregation,
  greatest(coalesce(max(CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.2 END END), 0.0), 0.5) AS match FROM lineitem GROUP BY 1""")
def best_evidence(spark, sf_dir):
    line = F.col("l_linenumber") % 7
    kind = RA.first_match([(line == i, k) for i, k in enumerate(CO.SEGREGATION)], "other")
    evidence = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("variant_id"), (F.col("l_linestatus") == "O").alias("usable"), (F.col("l_tax") > 0.02).alias("variant_specific"), kind.alias("evidence_type"), F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "related").otherwise("unrelated").alias("disease_match"))
    both = CO.segregation(evidence).join(CO.best_match(evidence, {"exact": 1.0, "related": 0.5, "unrelated": 0.2}), "variant_id")
    return both.select(F.col("variant_id").alias("l_partkey"), "segregation", "match")


@query("""SELECT p_partkey, round((coalesce(0.30 * f, 0) + coalesce(0.25 * c, 0) + coalesce(0.20 * r, 0) + 0.15 * a + 0.10 * 0.5) / (CASE WHEN f IS NULL THEN 0 ELSE 0.30 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END + CASE WHEN r IS NULL THEN 0 ELSE 0.20 END + 0.25), 6) AS disease,
  round((0.45 * f2 + 0.20 * 0.5 + coalesce(0.12 * c, 0)) / (0.65 + CASE WHEN c IS NULL THEN 0 ELSE 0.12 END), 6) AS editability FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size / 50.0 WHEN p_size % 3 = 1 THEN 0.25 END AS f, p_size / 50.0 AS f2, CASE WHEN p_size % 2 = 0 THEN 0.8 * 0.5 END AS c,
  CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_size % 5 = 1 THEN 0.9 END AS r, p_partkey % 10 / 10.0 AS a FROM part)""")
def disease_and_editability(spark, sf_dir):
    n = F.col("p_size")
    none = F.lit(None).cast("double")
    clinical = F.when(n % 2 == 0, F.lit(0.8))
    recurrence = CO.entering(F.when(n % 5 == 0, "searched_not_found").when(n % 5 == 1, "present").otherwise("not_searched"), F.lit(0.9))
    score = CO.disease_score(F.when(n % 3 == 0, n / 50), F.when(n % 3 != 2, F.lit(0.25)), clinical, F.lit(1.0), F.lit(0.5), recurrence, F.col("p_partkey") % 10 / 10, F.lit(0.5))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("disease"), F.round(CO.editability(n / 50, F.lit(0.5), F.when(n % 2 == 0, F.lit(0.4)), none, none), 6).alias("editability"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'not_editable_in_host_line' WHEN p_size % 5 = 0 THEN 'not_editable_no_pam' WHEN p_size % 3 = 0 THEN 'editability_unknown' WHEN p_size % 2 = 0 THEN 'not_editable_no_pam' ELSE 'editable' END AS status FROM part")
def editing_status(spark, sf_dir):
    n = F.col("p_size")
    status = CO.editing_status(F.when(n % 7 == 0, "cnv"), F.when(n % 5 == 0, F.lit(False)), n % 3 != 0, F.when(n % 2 == 0, 0).otherwise(2))
    return read(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@query("SELECT p_partkey, 'p_size' AS input, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def raw_inputs(spark, sf_dir):
    return CO.long_inputs(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
