"""The engine's operators on the star schema: parts are alleles, line items mentions, events a decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank import canonical
from evirank.functions import text as TX
from evirank.operators import composite as CO
from evirank.operators import evidence as EV
from evirank.operators import features as FE
from evirank.operators import identity as ID
from evirank.operators import literature as LI
from evirank.operators import metrics as ME
from evirank.operators import ranking as RA
from evirank.policy import default_policy
from evirank.sources import records as RE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ranking -------------------------------------------------------------------------------------------------------

_FEATURES = """
li AS (SELECT l_partkey, max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS o, max(l_discount) AS p FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'control' ELSE 'discovery' END AS channel,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'ptv' WHEN p_name LIKE '%widget%' THEN 'splice' WHEN p_type = 'LARGE' THEN 'missense' ELSE 'other' END AS stratum,
  CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS k, coalesce(o, 0) AS o, p FROM part LEFT JOIN li ON l_partkey = p_partkey)"""
_RANKED = f"""WITH {_FEATURES},
r AS (SELECT *, dense_rank() OVER (PARTITION BY channel, stratum ORDER BY k DESC, o DESC, (p IS NOT NULL) DESC, coalesce(p, 0) DESC) AS tier_rank,
  row_number() OVER (PARTITION BY channel, stratum ORDER BY k DESC, o DESC, (p IS NOT NULL) DESC, coalesce(p, 0) DESC, p_partkey) AS display_index FROM f),
t AS (SELECT *, count(*) OVER (PARTITION BY channel, stratum, tier_rank) AS tie_group_size FROM r)"""


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = RA.ordinal(F.col("l_returnflag"), {"A": 3, "N": 2}, 1)
    mentions = read(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.max(flag).alias("o"), F.max("l_discount").alias("p"))
    part = read(spark, sf_dir, "part")
    stratum = RA.first_match([(F.col("p_type").isin("ECONOMY", "PROMO"), "ptv"), (F.contains("p_name", F.lit("widget")), "splice"), (F.col("p_type") == "LARGE", "missense")], "other")
    k = RA.ordinal(F.col("p_size") % 4, {0: 3, 1: 2, 2: 1}, 0)
    j = part.join(mentions, part["p_partkey"] == mentions["l_partkey"], "left")
    return j.select("p_partkey", F.when(F.col("p_size") % 7 == 0, "control").otherwise("discovery").alias("channel"), stratum.alias("stratum"), k.alias("k"), F.coalesce("o", F.lit(0)).alias("o"), "p")


def ranked_parts(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("k", "o", "p")) -> DataFrame:
    return RA.rank(part_features(spark, sf_dir), ["channel", "stratum"], list(keys), [F.col("p_partkey").asc()], ("p",))


@query(_RANKED + " SELECT p_partkey, channel, stratum, k, o, p, tier_rank, display_index, tie_group_size, channel || ':' || stratum || ':t' || tier_rank AS tie_group_id FROM t")
def rank_tiers(spark, sf_dir):
    return ranked_parts(spark, sf_dir)


@query(_RANKED + """ SELECT channel, stratum, count(*) AS n, max(tier_rank) AS n_tiers, max(tie_group_size) AS largest_tie_group, count(DISTINCT k) AS k_values, count(DISTINCT o) AS o_values,
  count(DISTINCT coalesce(CAST(p AS VARCHAR), 'missing')) AS p_values, count(*) FILTER (WHERE p IS NULL) AS p_missing, count(DISTINCT k) <= 1 AS k_degenerate, count(DISTINCT o) <= 1 AS o_degenerate,
  count(DISTINCT coalesce(CAST(p AS VARCHAR), 'missing')) <= 1 AS p_degenerate FROM t GROUP BY 1, 2""")
def stratum_report(spark, sf_dir):
    return RA.stratum_report(ranked_parts(spark, sf_dir), ["channel", "stratum"], ["k", "o", "p"], "p")


@query(f"""WITH {_FEATURES} SELECT 'k,o' AS key_order, p_partkey, dense_rank() OVER (PARTITION BY channel, stratum ORDER BY k DESC, o DESC) AS tier_rank FROM f
  UNION ALL SELECT 'o,k' AS key_order, p_partkey, dense_rank() OVER (PARTITION BY channel, stratum ORDER BY o DESC, k DESC) AS tier_rank FROM f""")
def key_order_dynamic(spark, sf_dir):
    made = [ranked_parts(spark, sf_dir, keys).select(F.lit(",".join(keys)).alias("key_order"), "p_partkey", "tier_rank") for keys in (("k", "o"), ("o", "k"))]
    return made[0].unionAll(made[1])


@query(f"WITH {_FEATURES} SELECT p_partkey, row_number() OVER (PARTITION BY channel ORDER BY (p IS NOT NULL) DESC, coalesce(p, 0) DESC, p_partkey) AS position FROM f")
def missing_last(spark, sf_dir):
    r = RA.rank(part_features(spark, sf_dir), ["channel"], ["p"], [F.col("p_partkey").asc()], ("p",))
    return r.select("p_partkey", F.col("display_index").alias("position"))


@query("""SELECT p_partkey, CASE WHEN list_has_any(w, ['small', 'red']) THEN 'ptv' WHEN list_has_any(w, ['ring']) THEN 'splice' WHEN list_has_any(w, ['blue', 'widget']) THEN 'missense'
  WHEN list_has_any(w, ['large']) THEN 'splice' ELSE 'other' END AS stratum FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def first_match_rules(spark, sf_dir):
    words = F.split("p_name", " ")
    rules = [(("small", "red"), "ptv"), (("ring",), "splice"), (("blue", "widget"), "missense"), (("large",), "splice")]
    return read(spark, sf_dir, "part").select("p_partkey", RA.first_match([(F.arrays_overlap(words, F.array(*map(F.lit, t))), s) for t, s in rules], "other").alias("stratum"))


_MECH = "CASE o_orderstatus WHEN 'O' THEN 'loss_of_function' WHEN 'F' THEN 'gain_of_function' ELSE 'unknown' END"
_STRAT = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ptv' WHEN '2' THEN 'splice' WHEN '3' THEN 'missense' WHEN '4' THEN 'synonymous' ELSE 'other' END"


@query(f"""SELECT o_orderkey, c.concordance FROM (SELECT o_orderkey, {_MECH} AS m, {_STRAT} AS s FROM orders) LEFT JOIN (VALUES ('loss_of_function', 'ptv', 'concordant'), ('loss_of_function', 'splice', 'concordant'),
  ('loss_of_function', 'missense', 'partial'), ('loss_of_function', 'synonymous', 'discordant'), ('loss_of_function', 'other', 'not_assessable'), ('gain_of_function', 'ptv', 'discordant'), ('gain_of_function', 'splice', 'discordant'),
  ('gain_of_function', 'missense', 'concordant'), ('gain_of_function', 'synonymous', 'discordant'), ('gain_of_function', 'other', 'not_assessable'), ('unknown', 'ptv', 'not_assessable'), ('unknown', 'splice', 'not_assessable'),
  ('unknown', 'missense', 'not_assessable'), ('unknown', 'synonymous', 'not_assessable'), ('unknown', 'other', 'not_assessable')) AS c(m, s, concordance) USING (m, s)""")
def concordance_lookup(spark, sf_dir):
    mechanism = RA.first_match([(F.col("o_orderstatus") == "O", "loss_of_function"), (F.col("o_orderstatus") == "F", "gain_of_function")], "unknown")
    lead = F.substring("o_orderpriority", 1, 1)
    stratum = RA.first_match([(lead == k, v) for k, v in (("1", "ptv"), ("2", "splice"), ("3", "missense"), ("4", "synonymous"))], "other")
    table = default_policy().concordance(spark).where("feature is null").select("mechanism", "stratum", "concordance")
    j = read(spark, sf_dir, "orders").select("o_orderkey", mechanism.alias("mechanism"), stratum.alias("stratum"))
    return j.join(F.broadcast(table), ["mechanism", "stratum"], "left").select("o_orderkey", "concordance")  # one row for each mechanism and stratum


# ---- evidence ------------------------------------------------------------------------------------------------------

_LOG = """log AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, event_id, CASE event_type WHEN 'error' THEN 'host' WHEN 'purchase' THEN 'human' WHEN 'signup' THEN 'importer' ELSE 'model' END AS reviewer_type,
  CASE WHEN event_type = 'purchase' AND value < 5 THEN 'rejected' ELSE 'unreviewed' END AS human_review,
  CASE WHEN event_type = 'error' AND value < 2 THEN 'rejected' WHEN event_type = 'error' THEN 'mechanically_valid' WHEN value > 60 THEN 'accepted_human' WHEN value > 30 THEN 'accepted_auto' ELSE 'draft' END AS s FROM events)"""


def _state_sql(by: str) -> str:
    return f"""WITH {_LOG}, g AS (SELECT {by}, bool_or(reviewer_type = 'host' AND s = 'rejected') AS host_no, bool_or(reviewer_type = 'human' AND (human_review = 'rejected' OR s = 'rejected')) AS human_no,
  arg_max(s, event_id) FILTER (WHERE reviewer_type = 'human') AS human, arg_max(s, event_id) FILTER (WHERE reviewer_type <> 'host') AS other FROM log GROUP BY {by})
SELECT {by}, CASE WHEN host_no OR coalesce(human_no, false) THEN 'rejected' WHEN human IS NOT NULL THEN human WHEN other IS NULL THEN 'mechanically_valid' WHEN other = 'accepted_human' THEN 'quarantined' ELSE other END AS state FROM g"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return read(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("sequence"), RA.first_match([(kind == "error", "host"), (kind == "purchase", "human"), (kind == "signup", "importer")], "model").alias("reviewer_type"),
        F.when((kind == "purchase") & (value < 5), "rejected").otherwise("unreviewed").alias("human_review"),
        RA.first_match([((kind == "error") & (value < 2), "rejected"), (kind == "error", "mechanically_valid"), (value > 60, "accepted_human"), (value > 30, "accepted_auto")], "draft").alias("effective_state"),
    )


@query(_state_sql("user_id"))
def effective_state(spark, sf_dir):
    return EV.effective_state(decision_log(spark, sf_dir), ["user_id"])


@query(_state_sql("user_id, day"))
def effective_state_by_revision(spark, sf_dir):
    return EV.effective_state(decision_log(spark, sf_dir), ["user_id", "day"])


@query("""SELECT c_custkey, coalesce(max(CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 3 WHEN o_totalprice > 100000 AND o_orderstatus = 'O' THEN 2 WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS o_tier
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def obs_tier_max(spark, sf_dir):
    seen = F.col("o_totalprice") > 100000
    own = F.col("o_orderstatus") == "O"
    tier = RA.first_match([(seen & own & (F.col("o_orderpriority") == "1-URGENT"), 3), (seen & own, 2), (seen & (F.col("o_orderstatus") == "F"), 1)], 0)
    best = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(tier).alias("o_tier"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("o_tier", F.lit(0)).alias("o_tier"))


@query("SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 40) THEN 'characterized_altered' WHEN bool_or(l_returnflag = 'R') THEN 'characterized_other' ELSE 'uncharacterized' END AS characterization FROM lineitem GROUP BY 1")
def characterization(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(FE.characterization(F.col("l_returnflag") == "R", F.col("l_quantity") > 40).alias("characterization"))


@query("SELECT l_partkey, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS link_ids, count(DISTINCT l_orderkey) AS n_links FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def contributing_ids(spark, sf_dir):
    ids = F.array_sort(F.collect_set(F.col("l_orderkey").cast("string")))
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.array_join(ids, ",").alias("link_ids"), F.size(ids).cast("bigint").alias("n_links"))


@query("SELECT l_orderkey, bool_and(l_quantity >= 2 AND l_discount < 0.1) AS all_ok, count(*) AS n FROM lineitem GROUP BY 1")
def universal_check(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and((F.col("l_quantity") >= 2) & (F.col("l_discount") < 0.1)).alias("all_ok"), F.count("*").alias("n"))


# ---- identity ------------------------------------------------------------------------------------------------------

@query("""SELECT l_partkey, l_suppkey, count(*) AS n_mentions, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY l_shipdate, l_orderkey, l_linenumber) AS aliases,
  string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles FROM lineitem GROUP BY 1, 2""")
def registry_merge(spark, sf_dir):
    alias = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_linenumber", alias.alias("alias"))))
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_mentions"), F.array_join(F.transform(ordered, lambda x: x["alias"]), ",").alias("aliases"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("roles"))


@query("""SELECT p_partkey, 'var_' || sha256('{"alt":"' || p_type || '","assembly":"GRCh38","identity_version":"1","pos_1based":' || p_partkey || ',"ref":"' || p_brand || '","reference_accession":"' || p_name || '"}') AS variant_id FROM part""")
def canonical_id(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", canonical.variant_id(F.lit("GRCh38"), F.col("p_name"), F.col("p_partkey"), F.col("p_brand"), F.col("p_type")).alias("variant_id"))


@query("""SELECT sha256('[' || string_agg('["' || n || '","' || d || '"]', ',' ORDER BY n) || ']') AS combined_digest FROM (SELECT r_name AS n, sha256(r_name || ':' || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)) AS d FROM region)""")
def combined_digest(spark, sf_dir):
    counts = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).count()
    named = read(spark, sf_dir, "region").join(counts, "r_regionkey", "left").select("r_name", F.sha2(F.concat("r_name", F.lit(":"), F.coalesce("count", F.lit(0)).cast("string")), 256).alias("d"))
    return canonical.combined_digest(named, "r_name", "d")


@query("""SELECT CASE WHEN len(w) > 1 THEN p_partkey || '.' || i ELSE CAST(p_partkey AS VARCHAR) END AS mention_id, CASE WHEN len(w) > 1 THEN CAST(p_partkey AS VARCHAR) END AS parent_mention_id, w[i] AS alt
  FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)""")
def multiallelic_unnest(spark, sf_dir):
    mentions = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("mention_id"), F.translate("p_name", " ", ",").alias("alt"))
    return ID.split_multiallelic(mentions).select("mention_id", "parent_mention_id", "alt")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus <> 'O' THEN 'unsupported' WHEN l_quantity < 5 THEN 'insufficient' WHEN l_discount > 0.08 THEN 'ref_mismatch' WHEN l_tax > 0.06 THEN 'unmapped' ELSE 'resolved' END AS status,
  CASE WHEN l_linestatus <> 'O' THEN 'assembly differs' WHEN l_quantity < 5 THEN 'no change' WHEN l_discount > 0.08 THEN 'reference base differs' WHEN l_tax > 0.06 THEN 'outside the reference' END AS reason, l_extendedprice FROM lineitem""")
def exclusion_ledger(spark, sf_dir):
    guards = [(F.col("l_linestatus") != "O", "unsupported", "assembly differs"), (F.col("l_quantity") < 5, "insufficient", "no change"), (F.col("l_discount") > 0.08, "ref_mismatch", "reference base differs"), (F.col("l_tax") > 0.06, "unmapped", "outside the reference")]
    status, reason = RA.first_match([(t, s) for t, s, _ in guards], "resolved"), RA.first_match([(t, w) for t, _, w in guards], F.lit(None).cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"), reason.alias("reason"), "l_extendedprice")


_BASES_OF = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH p AS (SELECT p_partkey, substr({_BASES_OF}, 1, CAST(1 + p_size % 3 AS BIGINT)) AS r, CASE WHEN p_partkey % 2 = 0 THEN substr({_BASES_OF}, 1, 1) ELSE '' END || substr({_BASES_OF}, 5, CAST(1 + p_partkey % 3 - (p_partkey + 1) % 2 AS BIGINT)) AS a FROM part)
SELECT p_partkey, r AS ref, a AS alt, CASE WHEN length(r) = 1 AND length(a) = 1 THEN 'snv' WHEN length(r) = length(a) THEN 'mnv' WHEN length(a) = 1 AND r[1] = a[1] THEN 'deletion' WHEN length(r) = 1 AND r[1] = a[1] THEN 'insertion' ELSE 'delins' END AS allele_type FROM p WHERE a <> '' AND r <> a""")
def allele_type(spark, sf_dir):
    part, one = read(spark, sf_dir, "part"), F.lit(1)
    bases = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    ref = F.substring(bases, one, (1 + F.col("p_size") % 3).cast("int"))
    alt = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.substring(bases, 1, 1)).otherwise(""), F.substring(bases, F.lit(5), (1 + F.col("p_partkey") % 3 - (F.col("p_partkey") + 1) % 2).cast("int")))
    alleles = part.select("p_partkey", ref.alias("ref"), alt.alias("alt")).where("alt <> '' and ref <> alt")
    return alleles.withColumn("allele_type", ID.allele_type(F.col("ref"), F.col("alt")))


_SEQ = "GCTACCAAAAAATGTGTGTGCCATCATCATCATGGGACCTTAGACAGACAGAAA"
#: A change for each part: its place from the key, its kind from the size.
_PLACED = f"""SELECT p_partkey AS id, 12 + p_partkey % 34 AS pos, substr('{_SEQ}', 12 + p_partkey % 34, CAST(CASE p_size % 6 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS INT)) AS ref,
  CASE p_size % 6 WHEN 0 THEN 'G' WHEN 2 THEN substr('{_SEQ}', 12 + p_partkey % 34, 2) WHEN 4 THEN repeat(substr('{_SEQ}', 12 + p_partkey % 34, 1), 2) WHEN 5 THEN 'TA' ELSE substr('{_SEQ}', 12 + p_partkey % 34, 1) END AS alt FROM part"""


@query(f"""WITH RECURSIVE q AS (SELECT CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos, ref, alt FROM ({_PLACED.replace("INT)", "BIGINT)")}) WHERE ref <> alt), w AS (SELECT id, pos, ref, alt, 0 AS phase FROM q UNION ALL
  SELECT id, CASE WHEN len(ref) = 0 OR len(alt) = 0 THEN pos - 1 ELSE pos END,
    CASE WHEN len(ref) = 0 OR len(alt) = 0 THEN '{_SEQ}'[pos - 1] || ref ELSE left(ref, len(ref) - 1) END, CASE WHEN len(ref) = 0 OR len(alt) = 0 THEN '{_SEQ}'[pos - 1] || alt ELSE left(alt, len(alt) - 1) END, phase + 1
  FROM w WHERE pos > 1 AND (len(ref) = 0 OR len(alt) = 0 OR right(ref, 1) = right(alt, 1))),
d AS (SELECT id, arg_max(pos, phase) AS pos, arg_max(ref, phase) AS ref, arg_max(alt, phase) AS alt FROM w GROUP BY id),
x AS (SELECT id, pos, ref, alt FROM d UNION ALL SELECT id, pos + 1, substr(ref, 2), substr(alt, 2) FROM x WHERE len(ref) > 1 AND len(alt) > 1 AND ref[1] = alt[1])
SELECT id, CAST(max(pos) AS BIGINT) AS la_pos, arg_max(ref, pos) AS la_ref, arg_max(alt, pos) AS la_alt FROM x GROUP BY id""")
def left_align(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    placed = spark.sql(_PLACED).where("ref <> alt").withColumn("flank", F.substring(F.lit(_SEQ), F.lit(1), (F.col("pos") - 1).cast("int")))
    return ID.left_align(placed, "flank", "pos", "ref", "alt").select(F.col("id").cast("bigint").alias("id"), F.col("la_pos").cast("bigint").alias("la_pos"), "la_ref", "la_alt")


@query("SELECT p_partkey, CASE WHEN list_has_any(string_split(p_name, ' '), ['red', 'ring', 'small']) THEN 'kept' ELSE 'out_of_scope' END AS status FROM part")
def scope_filter(spark, sf_dir):
    kept, gone = ID.scope_filter(read(spark, sf_dir, "part").withColumn("terms", F.split("p_name", " ")), "terms", ["red", "ring", "small"])
    return kept.withColumn("status", F.lit("kept")).unionByName(gone).select("p_partkey", "status")


# ---- joins ---------------------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def must_match_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return EV.must_match(lines, orders, ["l_orderkey"], "a line item has no order")


@query("""SELECT p_partkey, CASE WHEN l.l_partkey IS NULL THEN 'searched_not_found' ELSE 'value_present' END AS status, l.frequency FROM part
  LEFT JOIN (SELECT l_partkey, max(l_discount) AS frequency FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R' GROUP BY 1) l ON l.l_partkey = p_partkey""")
def left_join_status(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_discount").alias("frequency"))
    return read(spark, sf_dir, "part").select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.when(F.col("frequency").isNull(), "searched_not_found").otherwise("value_present").alias("status"), "frequency")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_new(spark, sf_dir):
    seen = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS cached FROM customer")
def semi_cached(spark, sf_dir):
    cache = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    hit, miss = LI.cached_and_remaining(read(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey", ttl=float("inf"))
    return hit.withColumn("cached", F.lit(True)).unionAll(miss.withColumn("cached", F.lit(False)))


_REGIONS = [("head", 1, 8), ("core", 6, 20), ("tail", 30, 45), ("end", 50, 50)]


@query("SELECT p_partkey, r.name AS region FROM part JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _REGIONS) + ") AS r(name, s, e) ON p_size - 1 <= r.e AND r.s <= p_size + 1")
def overlap_join(spark, sf_dir):
    regions = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in _REGIONS))
    near = F.filter(regions, lambda r: RE.in_regions(F.col("p_size") - 1, F.col("p_size") + 1, F.array(r)))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(near, lambda r: r["name"])).alias("region"))


@query("""SELECT e.event_id, p.event_id AS nearest_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON e.user_id = p.user_id AND e.event_id > p.event_id""")
def asof_nearest_preceding(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    events = read(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    seen = events.withColumn("nearest_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before))
    return seen.where("event_type = 'purchase'").select("event_id", "nearest_id")


@query("SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1")
def unique_lookup(spark, sf_dir):
    return RE.exactly_one(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey").where("s_suppkey is not null")


@query("""SELECT nationkey, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM (SELECT c_nationkey AS nationkey, 'customer' AS route, c_name AS variant FROM customer WHERE c_acctbal < 0 UNION ALL
  SELECT s_nationkey, 'supplier', NULL FROM supplier UNION ALL SELECT c_nationkey, 'order', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000) GROUP BY 1""")
def route_union(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    a = customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("pmid"), F.lit("customer").alias("route"), F.col("c_name").alias("variant"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pmid"), F.lit("supplier").alias("route"))
    c = read(spark, sf_dir, "orders").where("o_totalprice > 450000").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("pmid"), F.lit("order").alias("route"), F.col("o_orderpriority").alias("variant"))
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return RE.literature_pool([a, b, c]).select(F.col("pmid").alias("nationkey"), said("routes"), said("variants"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf_dir):
    return RA.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY 1")
def counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") > 50).alias("n_high"))


@query("""WITH c AS (SELECT l_partkey, l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS ac, CAST(sum(l_quantity) AS BIGINT) AS an, count(*) % 3 = 0 AS bad FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, round(sum(ac) FILTER (WHERE NOT bad AND an > 0) / nullif(CAST(sum(an) FILTER (WHERE NOT bad AND an > 0) AS DOUBLE), 0), 6) AS frequency FROM c WHERE l_returnflag IN ('A', 'N') GROUP BY 1""")
def joint_af(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_linenumber").cast("bigint").alias("ac"), F.sum("l_quantity").cast("bigint").alias("an"), F.count("*").alias("n"))
    filters = F.when(F.col("n") % 3 == 0, F.array(F.lit("AC0"))).otherwise(F.array().cast("array<string>"))
    call = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.struct("ac", "an", filters.alias("filters")))).alias(flag)
    both = calls.groupBy("l_partkey").agg(call("A"), call("N"))
    return both.select("l_partkey", F.round(RE.joint_frequency(F.col("A"), F.col("N")), 6).alias("frequency"))


# ---- metrics -------------------------------------------------------------------------------------------------------

@query("SELECT p_partkey, CAST(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM part")
def avg_rank(spark, sf_dir):
    return ME.average_rank(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "avg_rank").select("p_partkey", "avg_rank")


@query("""SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS ry
  FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)""")
def spearman(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return ME.spearman(read(spark, sf_dir, "part").join(q, "p_partkey"), "p_size", "q").select(F.round("spearman", 6).alias("spearman"), "n")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT round(avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0 END), 6) AS auroc FROM (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) p,
  (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0) q""")
def auroc(spark, sf_dir):
    return ME.auroc(labelled(spark, sf_dir), "n_chars", "quality").select(F.round("auroc", 6).alias("auroc"))


@query("""WITH g AS (SELECT n_chars // 100 AS key, count(*) AS n, sum(quality) AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY key DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g),
k AS (SELECT unnest([10, 25, 50]) AS k) SELECT CAST(k AS BIGINT) AS k, round(sum(CAST(least(greatest(k - b, 0), n) AS DOUBLE) / n * h), 6) AS hits, round(sum(CAST(least(greatest(k - b, 0), n) AS DOUBLE) / n * h) / k, 6) AS precision_at_k,
  round(sum(CAST(least(greatest(k - b, 0), n) AS DOUBLE) / n * h) / greatest(1, sum(h)), 6) AS recall_at_k FROM w, k GROUP BY k HAVING k <= sum(n)""")
def expected_hits(spark, sf_dir):
    keyed = labelled(spark, sf_dir).withColumn("key", F.expr("n_chars div 100"))
    out = ME.expected_hits(keyed, "key", "quality", (10, 25, 50))
    return out.select("k", *(F.round(c, 6).alias(c) for c in ("hits", "precision_at_k", "recall_at_k")))


def _poisson_sql(mean: str, parts: str) -> str:
    """A Poisson count from a uniform number, by the same rule as metrics.poisson."""
    u = lambda more: f"((('0x' || substr(md5({parts}{more}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    z = f"(sqrt(-2 * ln({u(" || ':r'")})) * cos(2 * pi() * {u(" || ':a'")}))"
    return f"CASE WHEN {mean} <= 0 THEN 0 WHEN {mean} <= 30 THEN (SELECT count(*) FROM cdf WHERE cdf.m = {mean} AND cdf.c <= {u('')}) ELSE CAST(floor(greatest(0, {mean} + {z} * sqrt(CAST({mean} AS DOUBLE)) + ({z} * {z} - 1) / 6 + 0.5)) AS BIGINT) END"


@query(f"""WITH RECURSIVE pmf(m, k, p, c) AS (SELECT m, 0, exp(CAST(-m AS DOUBLE)), exp(CAST(-m AS DOUBLE)) FROM range(1, 31) t(m) UNION ALL SELECT m, k + 1, p * (CAST(m AS DOUBLE) / (k + 1)), c + p * (CAST(m AS DOUBLE) / (k + 1)) FROM pmf WHERE k < m + 12 * floor(sqrt(m)) + 18),
cdf AS (SELECT m, c FROM pmf), g AS (SELECT n_chars // 500 AS key, CAST(sum(quality) AS BIGINT) AS p, CAST(count(*) - sum(quality) AS BIGINT) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1),
d AS (SELECT b, key, {_poisson_sql("g.p", "'42:' || b || ':' || key || ':p'")} AS p, {_poisson_sql("g.m", "'42:' || b || ':' || key || ':m'")} AS m FROM g, range(1, 201) r(b)),
s AS (SELECT b, p, m, coalesce(sum(m) OVER (PARTITION BY b ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM d),
a AS (SELECT b, sum(p * (lower + m / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(m)) AS auroc FROM s GROUP BY b HAVING sum(p) > 0 AND sum(m) > 0), v AS (SELECT list(auroc ORDER BY auroc) AS v, count(*) AS n FROM a)
SELECT round(v[CAST(floor(n * 0.025) AS BIGINT) + 1], 6) AS low, round(v[greatest(1, CAST(floor(n * 0.975) AS BIGINT))], 6) AS high, n FROM v""")
def bootstrap_auroc(spark, sf_dir):
    keyed = labelled(spark, sf_dir).withColumn("key", F.expr("n_chars div 500"))
    return ME.bootstrap_auroc(keyed, "key", "quality", 200).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


_SPEND = "SELECT c_custkey, round(c_acctbal / 500) AS x, o.y FROM customer JOIN (SELECT o_custkey, count(*) AS y FROM orders GROUP BY 1) o ON o_custkey = c_custkey"


@query(f"""WITH d AS ({_SPEND}), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM d a JOIN d b ON a.c_custkey < b.c_custkey)
SELECT round((count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0)) / sqrt(CAST(count(*) FILTER (WHERE NOT tx) AS DOUBLE) * count(*) FILTER (WHERE NOT ty)), 9) AS tau_b, count(*) FILTER (WHERE s > 0) AS concordant, count(*) FILTER (WHERE s < 0) AS discordant, (SELECT count(*) FROM d) AS n FROM p""")
def kendall(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("y"))
    both = read(spark, sf_dir, "customer").join(orders, "c_custkey").withColumn("x", F.round(F.col("c_acctbal") / 500))
    return ME.kendall(both, "x", "y").withColumn("tau_b", F.round("tau_b", 9))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_discount <= 0.02 THEN 1 WHEN l_discount > 0.07 THEN 0 END AS label FROM lineitem WHERE l_discount <= 0.02 OR l_discount > 0.07")
def three_way_label(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", ME.three_way_label(F.col("l_discount"), 0.02, 0.07).alias("label")).where("label is not null")


@query("""SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, o.v AS old_value, n.v AS new_value, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS status
  FROM (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) o FULL JOIN (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) n ON o.o_custkey = n.o_custkey""")
def run_diff(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    old, new = (orders.where(t).groupBy("o_custkey").agg(F.count("*").alias("v")) for t in (early, ~early))
    return ME.run_diff(old, new, "o_custkey", "v")


@query("SELECT round(sum((pow(2, l_linenumber) - 1) / log2(i + 1)) FILTER (WHERE kind = 'got') / sum((pow(2, l_linenumber) - 1) / log2(i + 1)) FILTER (WHERE kind = 'best'), 6) AS ndcg FROM (SELECT 'got' AS kind, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem QUALIFY i <= 50 UNION ALL SELECT 'best', l_linenumber, row_number() OVER (ORDER BY l_linenumber DESC) AS i FROM lineitem QUALIFY i <= 50)")
def ndcg(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return ME.ndcg(read(spark, sf_dir, "lineitem"), order, "l_linenumber", 50).select(F.round("ndcg", 6).alias("ndcg"))


# ---- documents -----------------------------------------------------------------------------------------------------

@query("SELECT doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM documents")
def running_offsets(spark, sf_dir):
    return RA.running_before(read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("size")), ["source"], "doc_id", F.col("size") + 2, "at").select("doc_id", "at")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS BIGINT) AS batch FROM customer")
def batching(spark, sf_dir):
    return RA.batches(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 200)


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), w AS (SELECT source, doc_id, n_chars, i, CAST(0 AS BIGINT) AS bin, n_chars AS used FROM d WHERE i = 1 UNION ALL
  SELECT d.source, d.doc_id, d.n_chars, d.i, CASE WHEN w.used > 0 AND w.used + d.n_chars > 20000 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.used > 0 AND w.used + d.n_chars > 20000 THEN d.n_chars ELSE w.used + d.n_chars END FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1)
SELECT source, doc_id, n_chars AS size, bin FROM w""")
def greedy_pack(spark, sf_dir):
    return LI.greedy_bins(read(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 20_000)


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), w AS (SELECT source, doc_id, n_chars, i, CAST(n_chars <= 30000 AS INT) AS n, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END AS used, n_chars <= 30000 AS kept FROM d WHERE i = 1 UNION ALL
  SELECT d.source, d.doc_id, d.n_chars, d.i, w.n + CAST(w.n < 15 AND w.used + d.n_chars <= 30000 AS INT), w.used + CASE WHEN w.n < 15 AND w.used + d.n_chars <= 30000 THEN d.n_chars ELSE 0 END, w.n < 15 AND w.used + d.n_chars <= 30000 FROM w JOIN d ON d.source = w.source AND d.i = w.i + 1)
SELECT source, doc_id, n_chars AS size, kept FROM w""")
def passage_select(spark, sf_dir):
    return LI.select_passages(read(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 15, 30_000)


_UNITS = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in TX.UNIT_TAGS)


@query(f"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '{_UNITS}', 0, 's')) AS raw, generate_subscripts(regexp_extract_all(html, '{_UNITS}', 0, 's'), 1) AS i FROM pages WHERE html IS NOT NULL),
t AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(CASE WHEN starts_with(raw, '<tr') THEN regexp_replace(raw, '</t[dh]>', ' | ', 'g') ELSE raw END, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS text FROM u)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INTEGER) AS unit, text FROM t WHERE length(text) > 3 GROUP BY page_id, text""")
def markup_units(spark, sf_dir):
    units = F.posexplode(TX.markup_units(F.coalesce("html", F.lit("")))).alias("unit", "text")
    return read(spark, sf_dir, "pages").select("page_id", units)


@query("SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '[\\x{00C0}-\\x{024F}]', 'x', 'g'), '(?i)\\b(?:the|und|que)\\b')) AS BIGINT) AS n_hits FROM documents")
def alias_hits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(TX.alias_pattern(["the", "und", "que"])), F.lit(0))).cast("bigint").alias("n_hits"))


@query("SELECT doc_id, substr(text, greatest(0, strpos(text, 'with') - 1 - 30) + 1, least(30, strpos(text, 'with') - 1) + 4 + 30) AS first_window FROM documents WHERE strpos(text, 'with') > 0")
def context_windows(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.contains("text", F.lit("with"))).select("doc_id", F.get(TX.windows(F.col("text"), "with", 30), F.lit(0)).alias("first_window"))


_SQUASH = "trim(regexp_replace(regexp_replace(lower({0}), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query(f"SELECT item_id, min(doc_id) AS first_doc, count(*) AS n_docs FROM benchmark JOIN documents ON contains({_SQUASH.format('documents.text')}, {_SQUASH.format('benchmark.text')}) AND length(benchmark.text) > 8 GROUP BY 1")
def quote_check(spark, sf_dir):
    """Quotes of three words or more are looked for only in documents that hold their inner words: the first and the last word
    of a quote may be parts of longer ones, those between are whole in any text with the quote. Shorter quotes meet every text.
    """
    parts = F.split("quote", " ")
    inner = F.slice(parts, 2, F.least(F.size(parts) - 2, F.lit(4)))
    quotes = read(spark, sf_dir, "benchmark").where(F.length("text") > 8).select("item_id", TX.squashed(F.col("text")).alias("quote")).groupBy("item_id", "quote").agg(F.count("*").alias("times"))
    long = quotes.where(F.size(parts) > 2).withColumn("n", F.size(inner)).withColumn("lead", F.array_join(inner, " "))
    words = F.col("words")  # a column of its own, so that it is split once for each text
    docs = read(spark, sf_dir, "documents").select("doc_id", TX.squashed(F.col("text")).alias("body"))
    sizes = F.array(*(F.lit(r["n"]) for r in long.select("n").distinct().collect())).cast("array<int>")  # at most 1 to 4
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    leads = F.array_distinct(F.flatten(F.transform(sizes, runs)))
    hits = docs.select("doc_id", F.split("body", " ").alias("words")).select("doc_id", F.explode(leads).alias("lead")).join(long, "lead").select("doc_id", "item_id", "quote", "times").distinct()
    found = hits.join(docs, "doc_id").where(F.contains("body", F.col("quote"))).select("item_id", "doc_id", "times")
    short = docs.join(quotes.where(F.size(parts) < 3), F.contains("body", F.col("quote"))).select("item_id", "doc_id", "times")
    return found.unionAll(short).groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.sum("times").alias("n_docs"))


@query("""SELECT doc_id, split_part(w, '|', 1) AS priority, split_part(w, '|', 2) AS reason FROM (SELECT doc_id, CASE WHEN quality IS NULL THEN CASE WHEN n_chars % 11 = 0 THEN 'P2|full text names variant(s) near the gene' WHEN n_chars % 5 = 0 AND n_chars > 2000 THEN 'P4|LitVar link not confirmed in full text'
    WHEN n_chars % 5 = 0 THEN 'P3|LitVar links named variants; full text unavailable to confirm' WHEN n_chars % 7 >= 3 THEN 'P3|gene discussed in full text' WHEN n_chars % 2 = 0 AND doc_id % 3 = 0 THEN 'P3|gene in abstract; LLM screen not completed'
    WHEN n_chars <= 2000 AND n_chars % 2 = 1 THEN 'P4|gene only outside the abstract and full text unavailable: not assessable' ELSE 'P4|incidental mention' END
  ELSE CASE WHEN toxic = 1 THEN 'P5|not about the human gene' WHEN n_chars % 13 = 0 THEN 'P4|review/commentary: pointer only' WHEN lang = 'fr' THEN 'P4|common_snp_association: not germline rare-allele evidence' WHEN lang = 'de' THEN 'P3|engineered mutants: mechanism, not patient alleles'
    WHEN n_chars % 3 = 0 AND lang = 'en' THEN 'P1|allele-level functional experiment on patient variants' WHEN n_chars % 5 = 0 AND lang = 'en' AND quality = 1 THEN 'P1|rare variants in patients/cohorts' WHEN n_chars % 5 = 0 AND lang = 'en' THEN 'P2|rare variants reported'
    WHEN n_chars % 3 = 0 OR n_chars % 5 = 0 THEN 'P3|variants reported, class unclear' WHEN quality = 1 THEN 'P2|gene-level patient/cohort study (supplements may list alleles)' ELSE 'P3|gene-level mechanism/model study' END END AS w FROM documents LEFT JOIN labels USING (doc_id))""")
def screening_priority(spark, sf_dir):
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    n, lang = F.col("n_chars"), F.col("lang")
    kind = RA.first_match([(lang == "fr", "common_snp_association"), (lang == "de", "engineered_mutation"), (lang == "en", "rare_coding_or_splice")], "none")
    given = F.when(F.col("toxic") == 1, "no").otherwise("yes")
    p = LI.judged(
        named=n % 5 == 0, body_alleles=n % 11 == 0, open_text=n > 2000, mentions=n % 7, in_abstract=n % 2 == 0, error=F.col("doc_id") % 3 == 0, screened=F.col("quality").isNotNull(), human=given, review=n % 13 == 0, kind=kind,
        functional=F.when(n % 3 == 0, "yes").otherwise("no"), cohort=F.when(F.col("quality") == 1, "yes").otherwise("no"), reported=F.lit("none"),
    )
    return j.select("doc_id", p.alias("p")).select("doc_id", "p.priority", "p.reason")


@query("SELECT event_id, (TIMESTAMP '2024-02-01 00:00:00' - ts) <= INTERVAL 7 DAY AS hit FROM events")
def cache_ttl(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400e6)
    hit, miss = LI.cached_and_remaining(events, events, "event_id", age, 7.0)
    return hit.select("event_id", F.lit(True).alias("hit")).unionAll(miss.select("event_id", F.lit(False).alias("hit")))


@query("SELECT event_id, CAST(json_extract_string(props, '/k') AS BIGINT) AS k FROM events")
def json_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", EV.json_pointer(F.col("props"), "/k").cast("bigint").alias("k"))


@query("SELECT doc_id FROM documents ORDER BY sha256('audit' || doc_id) LIMIT greatest(1, (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM documents))")
def audit_sample(spark, sf_dir):
    return RA.audit_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, "audit")


# ---- composite profile ---------------------------------------------------------------------------------------------

_PIECES = [(900.0, 0.0), (1000.0, 0.25), (1500.0, 0.8), (2000.0, 1.0)]
_PIECE_SQL = "CASE WHEN v <= 900 THEN 0.0 WHEN v <= 1000 THEN (v - 900) * 0.0025 WHEN v <= 1500 THEN 0.25 + (v - 1000) * 0.0011 WHEN v <= 2000 THEN 0.8 + (v - 1500) * 0.0004 ELSE 1.0 END"


@query(f"SELECT p_partkey, round({_PIECE_SQL}, 6) AS anchor, round(1 - least(1.0, greatest(0.0, (p_size - 5) / 40.0)), 6) AS inverted FROM (SELECT p_partkey, p_size, p_retailprice AS v FROM part)")
def anchors_piecewise(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(CO.piecewise(F.col("p_retailprice"), _PIECES), 6).alias("anchor"), F.round(CO.linear_clamp(F.col("p_size"), 5.0, 45.0, invert=True), 6).alias("inverted"))


_COMPOSITE = f"""c AS (SELECT p_partkey, p_type, {_PIECE_SQL} AS a, b, d FROM (SELECT p_partkey, p_type, p_retailprice AS v, b, d FROM part LEFT JOIN (SELECT l_partkey, max(l_discount) * 10 AS b FROM lineitem WHERE l_quantity >= 48 GROUP BY 1) x ON x.l_partkey = p_partkey
  LEFT JOIN (SELECT l_partkey, max(l_tax) * 12 AS d FROM lineitem WHERE l_quantity <= 2 GROUP BY 1) y ON y.l_partkey = p_partkey)),
s AS (SELECT *, (0.32 * a + coalesce(0.34 * b, 0) + coalesce(0.18 * d, 0)) / (0.32 + CASE WHEN b IS NULL THEN 0 ELSE 0.34 END + CASE WHEN d IS NULL THEN 0 ELSE 0.18 END) AS w FROM c)"""


def composite_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    b = lines.where("l_quantity >= 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_discount") * 10).alias("b"))
    d = lines.where("l_quantity <= 2").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_tax") * 12).alias("d"))
    j = read(spark, sf_dir, "part").join(b, "p_partkey", "left").join(d, "p_partkey", "left")
    return j.select("p_partkey", "p_type", CO.piecewise(F.col("p_retailprice"), _PIECES).alias("a"), "b", "d")


@query(f"WITH {_COMPOSITE} SELECT p_partkey, round(w, 6) AS mean, round(w * (1 + 0.3 * (1 - coalesce(d, 1.0))), 6) AS score FROM s")
def weighted_renorm(spark, sf_dir):
    terms = [(0.32, F.col("a")), (0.34, F.col("b")), (0.18, F.col("d"))]
    return composite_parts(spark, sf_dir).select("p_partkey", F.round(CO.weighted(terms), 6).alias("mean"), F.round(CO.composite(terms, F.col("d"), 0.3), 6).alias("score"))


@query(f"""WITH {_COMPOSITE}, l AS (SELECT p_type, 'a' AS component, a AS v FROM c UNION ALL SELECT p_type, 'b', b FROM c UNION ALL SELECT p_type, 'd', d FROM c) SELECT p_type, component, count(v) AS n, round(count(v) / count(*), 6) AS coverage, round(var_samp(v), 6) AS variance,
  round(count(*) FILTER (WHERE v <= 0) / nullif(count(v), 0), 6) AS floor_fraction, count(v) >= 2 AND coalesce(var_samp(v), 0) < 1e-6 AS degenerate, count(v) < 2 AS sparse FROM l GROUP BY 1, 2""")
def composite_diag(spark, sf_dir):
    out = CO.diagnose(composite_parts(spark, sf_dir), ["p_type"], ["a", "b", "d"])
    return out.select("p_type", "component", "n", *(F.round(c, 6).alias(c) for c in ("coverage", "variance", "floor_fraction")), "degenerate", "sparse")


@query(f"WITH {_COMPOSITE} SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY round(w, 9) DESC, p_partkey) AS position FROM s")
def stratified_rank(spark, sf_dir):
    scored = composite_parts(spark, sf_dir).withColumn("score", F.round(CO.weighted([(0.32, F.col("a")), (0.34, F.col("b")), (0.18, F.col("d"))]), 9))
    return CO.stratified(scored, ["p_type"], "score", "p_partkey").select("p_partkey", "position")


# ---- more of the composite profile and of sources ------------------------------------------------------------------

@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS kept, count(*) AS n FROM orders GROUP BY 1, 2""")
def distinct_observations(spark, sf_dir):
    kept = CO.distinct_observations(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")])
    return kept.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("kept"), F.col("observations").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_quantity > 45 AND l_returnflag = 'A' THEN 1.0 WHEN l_quantity > 45 THEN 0.7 WHEN l_discount > 0.08 THEN 0.45 WHEN l_tax > 0.06 THEN 0.15 ELSE 0.0 END AS DOUBLE) AS saturation, l_extendedprice,
  CASE greatest(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE WHEN l_tax > 0.04 THEN 2 ELSE 0 END) WHEN 0 THEN 'variant_direct' WHEN 1 THEN 'variant_indirect' ELSE 'gene' END AS level FROM lineitem""")
def saturation_and_level(spark, sf_dir):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    rules = [((q > 45) & (flag == "A"), 1.0), (q > 45, 0.7), (F.col("l_discount") > 0.08, 0.45), (F.col("l_tax") > 0.06, 0.15)]
    levels = ("variant_direct", "variant_indirect", "gene")
    own = RA.first_match([(flag == "A", levels[0]), (flag == "N", levels[1])], levels[2])
    critic = F.when(F.col("l_tax") > 0.04, levels[2])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", CO.saturation(rules).alias("saturation"), "l_extendedprice", CO.effective_level(own, critic, levels).alias("level"))


@query("SELECT c_custkey, round((c_acctbal > 0)::INT * count(o_orderkey) / greatest(count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') * 0.1, 0.5), 6) AS recurrence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def recurrence(spark, sf_dir):
    counted = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    j = read(spark, sf_dir, "customer").join(counted, "c_custkey", "left")
    probands = F.when(F.col("c_acctbal") > 0, F.coalesce("n", F.lit(0))).otherwise(0)
    return j.select("c_custkey", F.round(CO.recurrence(probands, F.coalesce("open", F.lit(0)), 0.1, 0.5), 6).alias("recurrence"))


@query("""SELECT conv_id, count(*) AS n_turns, arg_max(role, turn) FILTER (WHERE role <> 'system') AS last_role, bool_and(length(text) > 0) AS all_said FROM conversations GROUP BY 1""")
def last_by_sequence(spark, sf_dir):
    other = F.col("role") != "system"
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max_by(F.when(other, F.col("role")), F.when(other, F.col("turn"))).alias("last_role"), F.bool_and(F.length("text") > 0).alias("all_said"))


@query("""SELECT doc_id, coalesce(l.toxic = 1 AND n_chars > 500, false) AS review, CASE WHEN n_chars % 2 = 0 AND lang = 'en' THEN 'full_text_open' WHEN length(text) > 0 THEN 'abstract_only' ELSE 'metadata_only' END AS access,
  CASE WHEN n_chars % 3 <> 0 THEN 'none' WHEN n_chars % 2 = 0 AND lang = 'en' THEN 'available' ELSE 'needs_access' END AS supplement FROM documents LEFT JOIN labels l USING (doc_id)""")
def document_rules(spark, sf_dir):
    n = F.col("n_chars")
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    flags = j.select("doc_id", F.col("text").alias("abstract"), (n % 2 == 0).alias("is_open_access"), (F.col("lang") == "en").alias("in_pmc"), (n % 3 == 0).alias("has_suppl"), F.when((F.col("toxic") == 1) & (n > 500), F.array(F.lit("Review"))).otherwise(F.array(F.lit("Article"))).alias("pub_types"))
    return LI.rule_fields(flags).select("doc_id", F.col("rule_review").alias("review"), "access", "supplement")


_SAID = """CASE p_size % 6 WHEN 0 THEN 'p.Arg' || p_partkey || 'Ter' WHEN 1 THEN 'rs' || p_partkey WHEN 2 THEN '  p.(Gly' || p_size || 'Ser)' WHEN 3 THEN 'R' || p_size || 'fs' WHEN 4 THEN 'chr1:' || p_partkey ELSE p_name END"""


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(trim(t), '^(p[.])?[(]?[A-Z][a-z]{{0,2}}[0-9]+([A-Z][a-z]{{0,2}}|[*]|=|fs)') THEN 'unsupported' WHEN regexp_matches(trim(t), '^rs[0-9]+') THEN 'insufficient' END AS status FROM (SELECT p_partkey, {_SAID} AS t FROM part)")
def text_classes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ID.classify_text(F.expr(_SAID)).alias("status"))
