"""Queries over assemblies, reference sequences and journals on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from evirank.functions import text as TX
from evirank.operators import assembly as AS
from evirank.operators import evidence as EV
from evirank.operators import identity as ID
from evirank.plans.more import _SEQ, _STATUS, resolved_parts
from evirank.plans.star import _state_sql, decision_log, read
from evirank.profile import Profile
from evirank.sources import journal as JO
from evirank.sources import records as RE
from evirank.sources import requests as RQ
from evirank.sources import sequences as SE
from evirank.storage import shared_path, stored
from evirank.streaming import states as ST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- assemblies ----------------------------------------------------------------------------------------------------

#: Each run of 20 parts is a chain, a part is a block, and gaps come from sizes; runs overlap on the source, so that scores decide.
_BLOCKS = """p AS (SELECT *, p_partkey // 20 AS id, 10 + p_size AS len, p_size % 5 AS dt, p_size % 3 AS dq, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) = count(*) OVER (PARTITION BY p_partkey // 20) AS final FROM part),
g AS (SELECT *, CASE WHEN final THEN 0 ELSE dt END AS gt, CASE WHEN final THEN 0 ELSE dq END AS gq FROM p),
w AS (SELECT *, CAST(coalesce(sum(len + gt) OVER (PARTITION BY id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t, CAST(coalesce(sum(len + gq) OVER (PARTITION BY id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS q FROM g),
b AS (SELECT id AS chain_id, 100 + id % 4 AS score, 'c' || id % 3 AS t_name, 600 * (id // 3) + t AS t_start, 600 * (id // 3) + t + len AS t_end, 'd' || id % 2 AS q_name, CAST(1000000 AS BIGINT) AS q_size, CASE WHEN id % 3 = 1 THEN '-' ELSE '+' END AS q_strand, 900 * id + q AS q_start FROM w)"""


def part_chains(spark, sf_dir):
    """Chain files of the parts, read back as blocks."""
    part = read(spark, sf_dir, "part").select(F.expr("p_partkey div 20").alias("id"), "p_partkey", (F.col("p_size") + 10).cast("bigint").alias("len"), (F.col("p_size") % 5).alias("dt"), (F.col("p_size") % 3).alias("dq"))
    blocks = F.array_sort(F.collect_list(F.struct("p_partkey", "len", "dt", "dq")))
    runs = part.groupBy("id").agg(blocks.alias("b"))
    total = lambda gap: F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["len"] + x[gap]) - F.element_at("b", -1)[gap]
    t, q = F.expr("600 * (id div 3)"), F.col("id") * 900
    head = F.concat_ws(" ", F.lit("chain"), F.lit(100) + F.col("id") % 4, F.concat(F.lit("c"), (F.col("id") % 3).cast("string")), F.lit("1000000"), F.lit("+"), t, t + total("dt"), F.concat(F.lit("d"), (F.col("id") % 2).cast("string")), F.lit("1000000"), F.when(F.col("id") % 3 == 1, "-").otherwise("+"), q, q + total("dq"), F.col("id"))
    body = F.transform("b", lambda x, i: F.when(i == F.size("b") - 1, x["len"].cast("string")).otherwise(F.concat_ws("\t", x["len"], x["dt"], x["dq"])))
    path = shared_path(spark, "chains")
    runs.select(F.concat(head, F.lit("\n"), F.array_join(body, "\n"), F.lit("\n")).alias("value")).write.text(path)
    return AS.read_chains(spark, path)


@query(f"WITH {_BLOCKS} SELECT * FROM b")
def chain_blocks(spark, sf_dir):
    return part_chains(spark, sf_dir)


_LOCI = "SELECT l_orderkey, l_linenumber, l_partkey, 'c' || l_linenumber % 4 AS chrom, (l_partkey * 37 + l_suppkey * 11) % 24000 AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'CAG' ELSE 'TG' END AS ref, CASE l_linestatus WHEN 'O' THEN 'G' ELSE 'TC' END AS alt FROM lineitem"


@query(f"""WITH {_BLOCKS}, l AS ({_LOCI}), u AS (SELECT DISTINCT chrom, pos - 1 AS a, pos - 1 + length(ref) AS e FROM l WHERE pos > 0),
m AS (SELECT u.*, b.*, t_start <= a AND e <= t_end AS whole FROM u JOIN b ON t_name = chrom AND ((t_start <= a AND a < t_end) OR (t_start <= e - 1 AND e - 1 < t_end))),
r AS (SELECT *, rank() OVER (PARTITION BY chrom, a, e ORDER BY whole DESC, score DESC) AS r FROM m), k AS (SELECT *, count(*) OVER (PARTITION BY chrom, a, e) AS n FROM r WHERE r = 1),
v AS (SELECT DISTINCT chrom, a, e, CASE WHEN NOT whole THEN 'split' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS s, CASE WHEN whole AND n = 1 THEN q_name END AS q_name, CASE WHEN whole AND n = 1 THEN chain_id END AS chain_id, CASE WHEN whole AND n = 1 THEN q_strand END AS q_strand,
  CASE WHEN whole AND n = 1 THEN CASE q_strand WHEN '+' THEN q_start + a - t_start ELSE q_size - (q_start + a - t_start) - (e - a) END + 1 END AS to_pos FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l.chrom, pos, ref, alt, CASE WHEN pos <= 0 THEN 'insufficient' ELSE coalesce(s, 'unmapped') END AS map_status, q_name AS to_chrom, to_pos, CASE q_strand WHEN '+' THEN ref WHEN '-' THEN reverse(translate(ref, 'ACGT', 'TGCA')) END AS to_ref,
  CASE q_strand WHEN '+' THEN alt WHEN '-' THEN reverse(translate(alt, 'ACGT', 'TGCA')) END AS to_alt, chain_id AS map_chain, coalesce(q_strand = '-' AND length(ref) <> length(alt), false) AS to_normalise FROM l LEFT JOIN v ON v.chrom = l.chrom AND a = pos - 1 AND e = pos - 1 + length(ref)""")
def carried_alleles(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "CAG").otherwise("TG")
    pos = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 24000
    alleles = line.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("c"), (F.col("l_linenumber") % 4).cast("string")).alias("chrom"), pos.alias("pos"), ref.alias("ref"), F.when(F.col("l_linestatus") == "O", "G").otherwise("TC").alias("alt"))
    return AS.carried(alleles, part_chains(spark, sf_dir))


# ---- reference sequences -------------------------------------------------------------------------------------------

_BASES = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def part_sequences(spark, sf_dir):
    """FASTA files with a contig for each run of 100 parts and a line for each part, read back in splits."""
    line = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    part = read(spark, sf_dir, "part").select(F.expr("p_partkey div 100").alias("id"), "p_partkey", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n")
    path = shared_path(spark, "fasta")
    part.groupBy("id").agg(lines.alias("lines")).select(F.concat(F.lit(">s"), F.col("id").cast("string"), F.lit(" a contig\n"), F.col("lines")).alias("value")).write.text(path)
    return SE.sequence_ranges(spark, path, 1000)


@query(f"""WITH s AS (SELECT 's' || p_partkey // 100 AS chrom, string_agg({_BASES}, '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(substr(seq, CAST(l_suppkey * 33 % 3300 + 1 AS BIGINT), CAST(l_quantity AS BIGINT)), '') AS bases FROM lineitem LEFT JOIN s ON chrom = 's' || (l_partkey + 50) // 100""")
def reference_bases(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat(F.lit("s"), F.expr("(l_partkey + 50) div 100").cast("string")).alias("chrom"))
    start = F.col("l_suppkey") * 33 % 3300
    return SE.bases_between(line, part_sequences(spark, sf_dir), start, start + F.col("l_quantity").cast("bigint"), "bases", 1000).drop("chrom", "l_quantity")


# ---- journals ------------------------------------------------------------------------------------------------------

@query("""SELECT 'claims' AS tbl, CAST(1 AS BIGINT) AS version, 'c' || o_orderkey AS id, o_orderstatus AS state FROM orders UNION ALL SELECT 'links', 1, 'l' || l_orderkey || '.' || l_linenumber, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT 'decisions', CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END, 'd' || event_id, event_type FROM events""")
def published_rows(spark, sf_dir):
    """Claims, links and two batches of decisions; each write is made twice, as after a failure, and counts once."""
    path = shared_path(spark, "journal")
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("state"))
    links = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("state"))
    links = stored(links.select(F.concat(F.lit("l"), F.concat_ws(".", "l_orderkey", "l_linenumber")).alias("id"), "state"), "links")  # written twice
    events = read(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("state"), "event_id")
    batches = [("claims", orders), ("links", links), ("decisions", events.where("event_id % 2 = 0").drop("event_id")), ("decisions", events.where("event_id % 2 <> 0").drop("event_id"))]
    for table, rows in batches:
        for _ in range(2):
            JO.append(rows, path, table, rows_per_blob=5000)
    out = None
    for table in ("claims", "links", "decisions"):
        rows = JO.rows_of(spark, path, table, "id string, state string").select(F.lit(table).alias("tbl"), "version", "id", "state")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- streams -------------------------------------------------------------------------------------------------------

@query(_state_sql("user_id, day"))
def streamed_states(spark, sf_dir):
    """The decision log as a stream of files, folded link by link in the state store."""
    log, out = shared_path(spark, "decisions"), shared_path(spark, "states")
    decision_log(spark, sf_dir).repartition(3).write.parquet(log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 1).parquet(log)
    return ST.latest(stream, ["user_id", "day"], out, shared_path(spark, "checkpoint")).drop("version")


# ---- requests ------------------------------------------------------------------------------------------------------

_ALLELE = "'c' || l_linenumber AS chrom, l_partkey AS pos, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'CAG' ELSE 'TG' END AS ref, CASE l_linestatus WHEN 'O' THEN 'G' ELSE 'TC' END AS alt"


@query(f"""WITH a AS (SELECT DISTINCT {_ALLELE} FROM lineitem), n AS (SELECT *, row_number() OVER (ORDER BY chrom, pos, ref, alt) - 1 AS n FROM a)
SELECT n // 200 AS batch, n % 200 AS place, chrom, pos, ref, alt, CASE WHEN (n // 200) % 10 = 7 THEN 'unanswered' WHEN pos % 17 = 0 THEN 'missing' WHEN pos % 19 = 0 THEN 'doubled' ELSE 'matched' END AS status,
  CASE WHEN (n // 200) % 10 <> 7 AND pos % 17 <> 0 THEN 'effect ' || n % 200 || CASE WHEN pos % 19 = 0 THEN '' ELSE ' alone' END END AS effect FROM n""")
def matched_batches(spark, sf_dir):
    """Alleles asked for in batches, with replies that leave out some inputs, echo some twice and one batch in ten without any."""
    line = read(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "CAG").otherwise("TG")
    alleles = line.select(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), ref.alias("ref"), F.when(F.col("l_linestatus") == "O", "G").otherwise("TC").alias("alt"))
    plan = RQ.planned(alleles, ["chrom", "pos", "ref", "alt"], RQ.allele_input())
    asked = RQ.requests(plan, "annotation")
    effect = lambda tail: F.struct("input", F.concat(F.lit("effect "), F.col("place").cast("string"), F.lit(tail)).alias("effect"))
    records = F.when(F.col("pos") % 19 == 0, F.array(effect(" again"), effect(""))).otherwise(F.array(effect(" alone")))
    saved = plan.where("batch % 10 <> 7 and pos % 17 <> 0").select("batch", F.explode(records).alias("r")).groupBy("batch").agg(F.to_json(F.collect_list("r")).alias("body"))
    replies = saved.join(asked.select("batch", "request_key"), "batch").select("request_key", "body")
    out = RQ.matched_back(plan, asked, replies, "struct<input:string,effect:string>", strict=False)
    return out.select("batch", "place", "chrom", "pos", "ref", "alt", "status", F.col("record.effect").alias("effect"))


# ---- annotations ---------------------------------------------------------------------------------------------------

#: Annotations name an allele with the base behind it, so that keys only meet once both are normalised.
_NOTED = f"n AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS pos, substr('{_SEQ}', p_size, 1) AS ref, CASE WHEN substr('{_SEQ}', p_size, 1) = 'A' THEN 'C' ELSE 'A' END AS alt, p_type, p_brand FROM part WHERE p_partkey % 4 = 0)"


def noted(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    base = lambda at: F.substring(F.lit(_SEQ), at, F.lit(1))
    ref, behind = base(F.col("p_size")), base(F.col("p_size") + 1)
    alt = F.when(ref == "A", "C").otherwise("A")
    allele = F.struct(F.lit("1").alias("chrom"), F.col("p_size").cast("bigint").alias("pos"), F.concat(ref, behind).alias("ref"), F.concat(alt, behind).alias("alt"))
    contigs = spark.createDataFrame([("1", "NC_1", 1, _SEQ)], "chrom string, accession string, offset bigint, sequence string")
    rows = part.select(allele.alias("allele"), F.col("p_partkey").alias("note_id"), F.array("p_type").alias("terms"))
    return ID.annotation_keys(rows, contigs, "T2")


@query(f"""WITH {_STATUS}, {_NOTED}, r AS (SELECT DISTINCT pos, ref, alt FROM s WHERE status = 'resolved' AND pos > 0) SELECT CAST(n.pos AS BIGINT) AS pos, n.ref, n.alt, n.p_partkey AS note_id FROM n JOIN r ON r.pos = n.pos AND r.ref = n.ref AND r.alt = n.alt""")
def annotated_alleles(spark, sf_dir):
    return ID.annotated(ID.registry(resolved_parts(spark, sf_dir)), noted(spark, sf_dir)).select(F.col("pos").cast("bigint").alias("pos"), "ref", "alt", "note_id")


@query(f"""WITH {_STATUS}, {_NOTED}, j AS (SELECT pos, ref, alt, bool_or(p_type IN ('ECONOMY', 'PROMO')) AS inside, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS t FROM n GROUP BY 1, 2, 3)
SELECT mention_id, 'out_of_scope' AS status, 'consequence ' || t || ' outside declared scope' AS reason FROM s JOIN j ON j.pos = s.pos AND j.ref = s.ref AND j.alt = s.alt WHERE status = 'resolved' AND NOT inside""")
def scope_exclusions(spark, sf_dir):
    """A row for each mention of an allele that is out of scope."""
    found = resolved_parts(spark, sf_dir)
    _, gone = ID.scope_exclusions(ID.registry(found), noted(spark, sf_dir), ID.decisions(found), "terms", ["ECONOMY", "PROMO"])
    return gone.select("mention_id", "status", "reason")


# ---- profiles ------------------------------------------------------------------------------------------------------

def small_profile() -> Profile:
    """A profile of our own, in which every anchor kind and an inherited mode occur."""
    share = {"type": "identity"}
    anchors = {n: share for n in ("gwas_pip", "disease_match_type", "segregation_support", "evidence_directness", "model_system_relevance", "replication_count", "mave_functional_class", "pegrna_predicted_efficiency", "bystander_risk", "off_target_risk", "alphamissense_score")}
    anchors |= {
        "gwas_log10_p": {"type": "piecewise", "breakpoints": [0, 10, 50], "values": [0.0, 0.5, 1.0]}, "clinvar_classification": {"type": "categorical", "map": {"economy": 0.9, "promo": 0.4, "large": 0.2}, "unmapped": 0.1},
        "clinvar_review_stars": {"type": "categorical", "map": {"0": 0.2, "1": 0.5, "2": 1.0}}, "cohort_normalized_recurrence": {"type": "linear_clamp", "lo": 900, "hi": 1900}, "gnomad_af": {"type": "piecewise", "breakpoints": [0.001, 0.1], "values": [0.0, 1.0], "log_scale": True, "invert": True},
        "pegrna_design_count": {"type": "piecewise", "breakpoints": [0, 3], "values": [0.0, 1.0]}, "indel_length": {"type": "linear_clamp", "lo": 0, "hi": 50, "invert": True}, "in_domain": {"type": "boolean", "map": {True: 1.0, False: 0.25}},
    }
    branches = {"missense": {"alphamissense_score": 0.75, "in_domain": 0.25}, "ptv": {"in_domain": 0.5, "indel_length": 0.5}, "other": {"indel_length": 1.0}}
    gating = {"loss": {"ptv": 1.0, "missense_predicted_lof": 0.8, "missense_predicted_tolerated": 0.2}, "mixed": {"default": 0.9}}
    even = {"disease": 0.4, "functional": 0.2, "mechanism": 0.3, "editability": 0.1}
    parts = {"disease": {"fine_mapping": 0.3, "clinical_evidence": 0.25, "recurrence": 0.2, "rarity": 0.15, "segregation": 0.1}, "functional": {"aggregation": "max"}, "editability": {"predicted_efficiency": 0.4, "design_count": 0.2, "bystander": 0.1, "off_target": 0.1, "indel_length": 0.2}}
    scoring = {"version": "1", "ranking_modes": {"even": {"weights": even, "novelty_alpha": 0.2}, "novel": {"inherits": "even", "novelty_alpha": 0.5}}, "components": parts}
    return Profile.read(scoring, {"version": "1", "anchors": anchors}, {"version": "1", "branches": branches}, {"version": "1", "gating": gating})


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 50.0 END AS am, p_size % 2 = 0 AS dom, CASE WHEN p_type = 'ECONOMY' THEN 'ptv' WHEN p_type = 'PROMO' THEN 'other' ELSE 'missense' END AS cls, CASE p_partkey % 4 WHEN 0 THEN 'loss' WHEN 1 THEN 'mixed' ELSE 'unknown' END AS mech, *  FROM part),
a AS (SELECT *, CASE WHEN p_size <= 10 THEN p_size / 20.0 ELSE 0.5 + (p_size - 10) / 80.0 END AS fm, CASE p_type WHEN 'ECONOMY' THEN 0.9 WHEN 'PROMO' THEN 0.4 WHEN 'LARGE' THEN 0.2 ELSE 0.1 END * CASE p_partkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1.0 END AS cl, least(1, greatest(0, (p_retailprice - 900) / 1000)) AS rec,
  1 - least(1, greatest(0, (log10(p_size / 1000.0) + 3) / 2)) AS rare, 1 - p_size / 50.0 AS ind, CASE WHEN dom THEN 1.0 ELSE 0.25 END AS d FROM i),
s AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN (0.3 * fm + 0.25 * cl + 0.15 * rare) / 0.7 ELSE (0.3 * fm + 0.25 * cl + 0.2 * rec + 0.15 * rare) / 0.9 END AS disease, CASE cls WHEN 'ptv' THEN 0.5 * d + 0.5 * ind WHEN 'other' THEN ind ELSE CASE WHEN am IS NULL THEN d ELSE 0.75 * am + 0.25 * d END END AS m,
  CASE cls WHEN 'ptv' THEN 'ptv' WHEN 'other' THEN 'default' ELSE CASE WHEN am <= 0.3 THEN 'missense_predicted_tolerated' ELSE 'missense_predicted_lof' END END AS k, (0.2 * least(1, p_size / 3.0) + 0.2 * ind) / 0.4 AS edit FROM a),
g AS (SELECT *, CASE mech WHEN 'loss' THEN CASE k WHEN 'ptv' THEN 1.0 WHEN 'missense_predicted_lof' THEN 0.8 WHEN 'missense_predicted_tolerated' THEN 0.2 ELSE 1.0 END WHEN 'mixed' THEN 0.9 ELSE 1.0 END AS gate, CASE mech WHEN 'loss' THEN CASE WHEN k = 'default' THEN 'ungated' ELSE k END WHEN 'mixed' THEN 'default' ELSE 'ungated' END AS gate_key FROM s)
SELECT p_partkey, round(disease, 6) AS disease, round(m, 6) AS mechanism_before, gate_key, CAST(gate AS DOUBLE) AS gate, round(m * gate, 6) AS mechanism, round(edit, 6) AS editability, round((0.4 * disease + 0.3 * m * gate + 0.1 * edit) / 0.8 * (1 + 0.5 * (1 - CASE WHEN p_size > 25 THEN 1.0 ELSE 0.5 END)), 6) AS composite FROM g""")
def profiled_parts(spark, sf_dir):
    part, size = read(spark, sf_dir, "part"), F.col("p_size")
    inputs = {
        "gwas_log10_p": size, "clinvar_classification": F.col("p_type"), "clinvar_review_stars": F.col("p_partkey") % 3, "disease_match_type": F.lit(1.0), "cohort_normalized_recurrence": F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")), "gnomad_af": size / 1000.0,
        "pegrna_design_count": size, "indel_length": size, "in_domain": size % 2 == 0, "alphamissense_score": F.when(F.col("p_partkey") % 3 == 0, size / 50.0),
    }
    cls = F.when(F.col("p_type") == "ECONOMY", "ptv").when(F.col("p_type") == "PROMO", "other").otherwise("missense")
    mechanism = F.when(F.col("p_partkey") % 4 == 0, "loss").when(F.col("p_partkey") % 4 == 1, "mixed").otherwise("unknown")
    out = small_profile().scored(part, "novel", inputs, cls, mechanism, F.lit(None).cast("double"), F.when(size > 25, 1.0).otherwise(0.5), F.lit(False))
    return out.select("p_partkey", "gate_key", "gate", *(F.round(c, 6).alias(c) for c in ("disease", "mechanism_before", "mechanism", "editability", "composite")))


# ---- evidence, notations and replies -------------------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_size > 40 THEN 'scope=fail' WHEN r = '' THEN 'mechanical=pass' ELSE array_to_string(list_transform(string_split(r, ','), lambda x: x || '=fail'), ',') END AS checks,
  CASE WHEN p_size > 40 THEN 'allele outside declared consequence scope' ELSE r END AS reasons, CASE WHEN p_size > 40 OR r <> '' THEN 'rejected' ELSE 'mechanically_valid' END AS host_state
FROM (SELECT *, concat_ws(',', CASE WHEN l_discount > 0.07 THEN 'citation_location' END, CASE WHEN l_tax > 0.06 THEN 'identity_decision' END) AS r FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def scoped_states(spark, sf_dir):
    """Checked links, of which those to large parts lie out of scope."""
    reasons = F.array_compact(F.array(F.when(F.col("l_discount") > 0.07, "citation_location"), F.when(F.col("l_tax") > 0.06, "identity_decision")))
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("variant_id"), reasons.alias("reasons"))
    links = links.withColumn("host_state", F.when(F.size("reasons") > 0, "rejected").otherwise("mechanically_valid"))
    out = EV.scoped_checks(links, read(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("variant_id")))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("checks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", told.alias("checks"), F.array_join("reasons", ",").alias("reasons"), "host_state")


@query("""WITH w AS (SELECT doc_id, n_chars, coalesce(text, '') AS text FROM documents)
SELECT doc_id, 'c.' || n_chars || 'A>G' || CASE WHEN doc_id % 2 = 0 THEN ',c.' || (n_chars + 1) || '_' || (n_chars + 2) || 'delAG' ELSE '' END AS notations, 'NM_' || doc_id || '.1' AS transcripts FROM w WHERE NOT regexp_matches(text, '[cp][.]')""")
def transcript_notations(spark, sf_dir):
    """Notations that are put into the texts of documents, with references and blanks, and read out again."""
    texts = read(spark, sf_dir, "documents").where(~F.coalesce("text", F.lit("")).rlike(r"[cp]\."))
    n = F.col("n_chars").cast("string")
    noted = F.concat(F.coalesce("text", F.lit("")), F.lit(" NM_"), F.col("doc_id").cast("string"), F.lit(".1 : c."), n, F.lit("A &#62; G/+ / p.(Arg"), n, F.lit("Ter) "))
    noted = F.concat(noted, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("; c."), (F.col("n_chars") + 1).cast("string"), F.lit("del&nbsp;AG."))).otherwise(""))
    found = texts.select("doc_id", TX.cleaned_notations(noted).alias("f"))
    return found.select("doc_id", F.array_join(F.transform("f", lambda x: x["notation"]), ",").alias("notations"), F.array_join(F.array_compact(F.transform("f", lambda x: x["transcript"])), ",").alias("transcripts"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, CAST(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS ea, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS en, bool_or(l_tax > 0.07) AS bad, CAST(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'A') AS BIGINT) AS ga, CAST(sum(l_quantity) FILTER (WHERE l_returnflag <> 'A') AS BIGINT) AS gn FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN bad OR en IS NULL THEN 0 ELSE ea END + coalesce(ga, 0) AS ac, CASE WHEN bad OR en IS NULL THEN 0 ELSE en END + coalesce(gn, 0) AS an FROM c)
SELECT 'g' || l_partkey AS gene_id, l_suppkey AS pos, round(ac / nullif(CAST(an AS DOUBLE), 0), 9) AS frequency, CASE WHEN an = 0 THEN 'no_passing_call' END AS reason FROM f""")
def population_frequencies(spark, sf_dir):
    """Whole replies, one for each part, read back as frequencies of variants."""
    line = read(spark, sf_dir, "lineitem")
    exome, number = F.col("l_returnflag") == "A", lambda c: c.cast("bigint")
    total = lambda c, t: number(F.sum(F.when(t, F.col(c))))
    calls = line.groupBy("l_partkey", "l_suppkey").agg(total("l_linenumber", exome).alias("ea"), total("l_quantity", exome).alias("en"), F.bool_or(F.col("l_tax") > 0.07).alias("bad"), total("l_linenumber", ~exome).alias("ga"), total("l_quantity", ~exome).alias("gn"))
    none = F.array().cast("array<string>")
    call = lambda a, n, filters: F.when(F.col(n).isNotNull(), F.struct(F.col(a).alias("ac"), F.col(n).alias("an"), filters.alias("filters")))
    variant = F.struct(F.col("l_suppkey").alias("pos"), call("ea", "en", F.when(F.col("bad"), F.array(F.lit("AC0"))).otherwise(none)).alias("exome"), call("ga", "gn", none).alias("genome"))
    genes = calls.groupBy("l_partkey").agg(F.collect_list(variant).alias("variants"))  # the suppliers of one part
    body = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id"), F.col("variants")).alias("gene")).alias("data")))
    return RE.population_variants(genes.select(body.alias("body"))).select("gene_id", "pos", F.round("frequency", 9).alias("frequency"), "reason")
