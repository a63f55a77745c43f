"""Operators on small made-up cases: invariants, metamorphic checks and a worked ranking."""

import hashlib
import json
import math
import random
import re

import pytest
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
from evirank.operators import scan
from evirank.policy import DEFAULT_RAW, DEFAULT_TABLE, Policy, PolicyError, default_policy
from evirank.schema import absent, observed_valid, present


def loop_align(seq, pos, ref, alt):
    while True:
        if not ref or not alt:
            if pos == 1:
                return None
            pos -= 1
            ref, alt = seq[pos - 1] + ref, seq[pos - 1] + alt
        elif ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def test_left_align_equals_the_loop(spark):
    rng = random.Random(7)
    seq = "".join(rng.choice("AC") for _ in range(60))
    rows = []
    for i in range(400):
        pos, n = rng.randint(1, 55), rng.randint(1, 4)
        ref = seq[pos - 1 : pos - 1 + n]
        alt = rng.choice([ref[0] + "".join(rng.choice("AC") for _ in range(rng.randint(0, 4))), ref[:1], ref * 2])
        if ref != alt:
            rows.append((i, pos, ref, alt, seq[: pos - 1]))
    df = spark.createDataFrame(rows, "id int, pos bigint, ref string, alt string, flank string")
    got = {r["id"]: (r["la_pos"], r["la_ref"], r["la_alt"]) for r in ID.left_align(df, "flank", "pos", "ref", "alt").collect()}
    for i, pos, ref, alt, _ in rows:
        want = loop_align(seq, pos, ref, alt)
        assert got[i] == want if want else got[i][0] is None


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("1", "NC_1", 1, "GGCTAAAAAACGTTTGCACACACATTG")], "chrom string, accession string, offset bigint, sequence string")


def test_resolve_and_registry(spark, contigs):
    rows = [
        (1, "m2", "a", "T2", "1", 4, "TA", "T", None), (2, "m3", "b", "T2", "1", 9, "AA", "A", None), (3, "m14", "c", "T2", "1", 4, "C", "G", None), (4, "m15", "p.Arg5Ter", None, None, None, None, None, None),
        (5, "m16", "rs123", None, None, None, None, None, None), (6, "m20", "d", "T1", "1", 4, "T", "G", None), (7, "m9", "e", "T2", "1", 12, "G", "A,C", ["negative_control"]), (8, "x", "f", "T2", "9", 4, "T", "G", None), (9, "y", "g", "T2", "1", 400, "T", "G", None),
    ]
    mentions = spark.createDataFrame(rows, "ordinal bigint, mention_id string, raw_text string, assembly string, chrom string, pos bigint, ref string, alt string, roles array<string>")
    mentions = mentions.withColumn("resolution_status", F.lit(None).cast("string")).withColumn("resolution_note", F.lit(None).cast("string"))
    out = ID.resolve(ID.split_multiallelic(mentions), contigs, "T2")
    status = {r["mention_id"]: r["identity_status"] for r in out.collect()}
    assert status == {"m2": "resolved", "m3": "resolved", "m14": "ref_mismatch", "m15": "unsupported", "m16": "insufficient", "m20": "unsupported", "m9.1": "resolved", "m9.2": "resolved", "x": "unmapped", "y": "unmapped"}
    merged = {tuple(a["mention_id"] for a in r["aliases"]): r for r in ID.registry(out).collect()}
    assert set(merged) == {("m2", "m3"), ("m9.1",), ("m9.2",)}
    assert (merged["m2", "m3"]["pos"], merged["m2", "m3"]["ref"], merged["m2", "m3"]["alt"]) == (4, "TA", "T")
    assert ID.exclusions(out).count() + ID.registry(out).select(F.explode("aliases")).count() == out.count() == ID.decisions(out).count()


def test_canonical_equals_python(spark):
    rows = [("é\"/\\", 5, None), ("", 0, "x\n\u0001"), ("plain", None, "🎉")]
    df = spark.createDataFrame(rows, "b string, a bigint, c string")
    got = [r[0] for r in df.select(canonical.canonical_row({"b": F.col("b"), "a": F.col("a"), "c": F.col("c")}, ("a",))).collect()]
    assert got == [json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for b, a, c in rows]
    digest = canonical.combined_digest(spark.createDataFrame([("b", "2"), ("a", "1")], "n string, d string"), "n", "d").first()[0]
    assert digest == hashlib.sha256(b'[["a","1"],["b","2"]]').hexdigest()


def test_effective_state_truth_order(spark):
    logs = {
        "host_no": [("host", "unreviewed", "rejected"), ("human", "accepted", "accepted_human")], "human_no": [("human", "rejected", "accepted_human"), ("model", "unreviewed", "accepted_auto")], "human_last": [("human", "accepted", "accepted_human"), ("human", "accepted", "quarantined"), ("model", "unreviewed", "accepted_auto")],
        "only_host": [("host", "unreviewed", "mechanically_valid")], "machine": [("model", "unreviewed", "accepted_auto")], "overreach": [("model", "unreviewed", "accepted_human")],
    }
    rows = [(k, 1, i, *r) for k, v in logs.items() for i, r in enumerate(v)]
    log = spark.createDataFrame(rows, "link_id string, claim_revision int, sequence bigint, reviewer_type string, human_review string, effective_state string")
    links = spark.createDataFrame([(k, 1) for k in [*logs, "none"]], "link_id string, claim_revision int")
    want = {"host_no": "rejected", "human_no": "rejected", "human_last": "quarantined", "only_host": "mechanically_valid", "machine": "accepted_auto", "overreach": "quarantined", "none": "draft"}
    assert {r["link_id"]: r["state"] for r in EV.link_states(links, log).collect()} == want
    assert {r["link_id"]: r["state"] for r in EV.link_states(links, log.unionAll(log)).collect()} == want  # repeated evidence changes nothing
    checked = links.withColumn("claim_id", F.lit("c")).withColumn("ordinal", F.monotonically_increasing_id()).withColumn("host_state", F.lit("rejected"))
    assert sorted(r["sequence"] for r in EV.host_decisions(checked, log).collect()) == list(range(3, 10))


def test_mechanical_checks_and_locators(spark):
    text = "The éxact words are here."
    digest = hashlib.sha256(text.encode()).hexdigest()
    snapshots = spark.createDataFrame([("s", text, digest), ("t", "changed", digest)], "snapshot_id string, text string, digest string")
    value = hashlib.sha256(b"7").hexdigest()
    rows = [("good", "text_span", "s", 4, 9, "éxact", digest, None, None), ("moved", "text_span", "s", 5, 10, "éxact", digest, None, None), ("altered", "text_span", "t", 0, 7, "changed", digest, None, None), ("gone", "text_span", "u", 0, 1, "x", digest, None, None), ("field", "json_field", "s", None, None, None, None, "7", value)]
    locators = spark.createDataFrame(rows, "claim_id string, kind string, snapshot_id string, start int, end int, excerpt string, text_digest string, value string, expected_value_digest string")
    located = EV.check_locators(locators, snapshots)
    assert {r["claim_id"]: r["ok"] for r in located.collect()} == {"good": True, "moved": False, "altered": False, "gone": False, "field": True}
    claims = spark.createDataFrame([("good", 1, "variant", ["m1"], "functional_experiment", ["m1"]), ("field", 1, "gene", ["m1"], "association", [])], "claim_id string, revision int, scope string, mentions array<string>, kind string, tested_mentions array<string>")
    identity = spark.createDataFrame([("d1", "resolved", ["v1"]), ("d2", "ambiguous", ["v1", "v2"])], "decision_id string, status string, variant_ids array<string>")
    links = spark.createDataFrame(
        [("ok", "good", 1, "v1", "m1", "exact_genomic", ["d1"]), ("unsure", "good", 1, "v1", "m1", "exact_genomic", ["d1", "d2"]), ("none", "good", 1, "v1", "m1", "exact_genomic", []), ("intro", "good", 1, "v1", "m2", "exact_genomic", ["d1"]), ("gene", "field", 1, "v1", "m1", "gene_only", [])],
        "link_id string, claim_id string, claim_revision int, variant_id string, mention_id string, identity_match string, identity_decision_ids array<string>",
    )
    got = {r["link_id"]: r["host_state"] for r in EV.mechanical_checks(links, claims, identity, located).collect()}
    assert got == {"ok": "mechanically_valid", "unsure": "rejected", "none": "rejected", "intro": "rejected", "gene": "mechanically_valid"}


def worked(spark, mechanism, policy=None):
    policy = policy or default_policy()
    kinds = {  # id: terms, nmd, domain, prediction status and score, evidence tier, roles
        "m01": (["stop_gained"], "triggers", None, None, None, 3), "m21": (["stop_gained"], "triggers", None, None, None, 0), "m02": (["frameshift_variant"], "escapes", None, None, None, 0), "m10": (["splice_donor_variant"], None, None, "value_present", 0.8, 0),
        "m11": (["splice_region_variant"], None, None, "value_present", 0.2, 0), "m06": (["missense_variant"], None, True, "value_present", 0.3, 1), "m04": (["missense_variant"], None, True, "value_present", 0.91, 0), "m08": (["missense_variant"], None, True, "value_present", 0.91, 0),
        "m07": (["missense_variant"], None, True, "unsupported", None, 0), "m18": (["missense_variant"], None, False, "value_present", 0.4, 0), "m13": (["synonymous_variant"], None, None, "value_present", 0.05, 0), "m05": (["missense_variant"], None, False, "value_present", 0.95, 0),
    }
    name = {"splice_donor_variant": "splice_delta", "splice_region_variant": "splice_delta", "synonymous_variant": "splice_delta"}
    variants = spark.createDataFrame([(k, k, [], "1", i, "A", "C") for i, k in enumerate(kinds)] + [("bare", "bare", ["negative_control"], "X", 1, "A", "C")], "variant_id string, label string, roles array<string>, chrom string, pos bigint, ref string, alt string")
    notes = spark.createDataFrame(
        [(k, t, nmd, domain, {name.get(t[0], "alphamissense"): (s, p)} if s else {}) for k, (t, nmd, domain, s, p, _) in kinds.items()], "variant_id string, terms array<string>, nmd string, in_functional_domain boolean, predictions map<string, struct<status: string, value: double>>"
    )
    seen = {3: (True, "exact"), 1: (False, "related")}
    rows = [(k, f"l_{k}", "exact_genomic", "association", None, None, 2, *seen[v[5]]) for k, v in kinds.items() if v[5]]
    rows += [("m05", "l_func", "exact_genomic", "functional_experiment", "exact_allele_edit", "altered", None, None, "exact"), ("m18", "l_carrier", "exact_genomic", "functional_experiment", "carrier_comparison", "altered", None, None, "exact")]
    evidence = spark.createDataFrame(rows, "variant_id string, link_id string, identity_match string, kind string, perturbation_type string, outcome_type string, cases bigint, controls_known boolean, disease_relationship string")
    return FE.rank_features(FE.derive_features(variants, notes, evidence, mechanism, policy), policy)


def test_worked_ranking(spark):
    ranked = worked(spark, "loss_of_function").cache()
    rows = {r["variant_id"]: r for r in ranked.collect()}
    tier = {k: (r["channel"], r["stratum"], r["tier_rank"]) for k, r in rows.items()}
    d = "discovery"
    assert tier["m01"] == (d, "ptv", 1) and tier["m21"] == (d, "ptv", 2) and tier["m02"] == (d, "ptv", 3)
    assert tier["m10"] == (d, "splice", 1) and tier["m11"] == (d, "splice", 2)
    assert [tier[k][2] for k in ("m06", "m04", "m08", "m07", "m18")] == [1, 2, 2, 3, 4] and rows["m04"]["tie_group_size"] == 2
    assert tier["m05"] == ("control", "missense", 1) and "positive_control_candidate" in rows["m05"]["roles"] and rows["m05"]["contributing_link_ids"]["characterization"] == ["l_func"]
    assert rows["m07"]["ordering_tuple"][2] == "P=missing:unsupported" and rows["m01"]["ordering_tuple"][2] == "P=no_predictor"
    assert "carrier_or_non_installation_experiment_only" in rows["m18"]["flags"] and rows["m18"]["characterization"] == "uncharacterized"
    assert tier["bare"][:2] == ("control", "other") and "no_annotation" in rows["bare"]["flags"]
    report = {(r["channel"], r["stratum"]): r for r in FE.report(ranked).collect()}
    assert report[d, "splice"]["key_k_degenerate"] and report[d, "missense"]["p_missing"] == 1 and report[d, "missense"]["largest_tie_group"] == 2


def test_mechanism_reorders(spark):
    dominant = {r["variant_id"]: r["tier_rank"] for r in worked(spark, "dominant_negative").where("stratum = 'ptv' and o = 'none'").collect()}
    assert dominant["m02"] < dominant["m21"]
    assert {r["k"] for r in worked(spark, "unknown").collect()} == {"not_assessable"}


def test_policy_refuses_contradictions():
    for change in ({"key_order": ["K", "K"]}, {"predictors": {}}, {"contained_predictors": [["splice_delta", "alphamissense"]]}):
        with pytest.raises(PolicyError):
            Policy.from_dicts({**DEFAULT_RAW, **change}, DEFAULT_TABLE)
    with pytest.raises(PolicyError):
        Policy.from_dicts(DEFAULT_RAW, {"class_level": {"unknown": {}}})


def test_metrics(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 9), rng.randint(0, 1), rng.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, key int, label int, other int")
    pos, neg = [k for _, k, y, _ in data if y], [k for _, k, y, _ in data if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert ME.auroc(df, "key", "label").first()["auroc"] == pytest.approx(want)
    assert ME.auroc(df.where("label = 1"), "key", "label").first()["auroc"] is None
    assert ME.spearman(df.withColumn("c", F.lit(1)), "key", "c").first()["spearman"] is None
    assert ME.spearman(df, "key", "key").first()["spearman"] == pytest.approx(1)
    low, high, n = ME.bootstrap_auroc(df, "key", "label", 200).first()
    assert low <= want <= high and n == 200
    assert (low, high, n) == tuple(ME.bootstrap_auroc(df.repartition(7), "key", "label", 200).first())
    assert ME.bootstrap_auroc(df.where("label = 1"), "key", "label", 20).first()["n"] == 0
    ties = spark.createDataFrame([(3, 1), (2, 1), (2, 0), (1, 0)], "key int, label int")
    assert ME.expected_hits(ties, "key", "label", (2, 10)).first()["hits"] == pytest.approx(1.5)
    labels = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "s double").select(ME.three_way_label(F.col("s"), 0.2, 0.8)).collect()
    assert [r[0] for r in labels] == [1, None, 0]


def test_ranks_hits_and_correlation_of_groups(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([None, *range(6)]), rng.randint(0, 1), rng.random()) for g in ("a", "b", None) for _ in range(80)]
    df = spark.createDataFrame(data, "g string, key int, label int, y double").repartition(5)
    key = lambda k: -1 if k is None else k
    for r in ME.average_rank(df, "key", "at", ("g",)).collect():
        keys = [key(k) for g, k, _, _ in data if g == r["g"]]
        assert r["at"] == sum(k < key(r["key"]) for k in keys) + (sum(k == key(r["key"]) for k in keys) + 1) / 2
    full = df.where("key is not null")
    alone = {g: ME.spearman(full.where(F.col("g").eqNullSafe(g)), "key", "y").first() for g in ("a", "b", None)}
    for r in ME.spearman(full, "key", "y", ("g",)).collect():
        assert (r["spearman"], r["n"]) == (pytest.approx(alone[r["g"]]["spearman"]), alone[r["g"]]["n"])
    hits = {(r["g"], r["k"]): r["hits"] for r in ME.expected_hits(full, "key", "label", (3, 40), ("g",)).collect()}
    for r in ME.expected_hits(full.where("g = 'b'"), "key", "label", (3, 40)).collect():
        assert hits["b", r["k"]] == pytest.approx(r["hits"])


def test_windows_hold_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("key"), (F.col("id") % 7 % 2).alias("label"), (F.col("id") % 31).alias("y"))
    for made in (ME.average_rank(df, "key", "at"), ME.auroc(df, "key", "label"), ME.expected_hits(df, "key", "label", (10,)), ME.spearman(df, "key", "y"), RA.numbered(df, "key", "n")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Window [^\n]*\n(?:[^\n]*(?:Project|Sort|InputAdapter|Shuffle)[^\n]*\n)*[^\n]*Exchange SinglePartition", plan)


def test_scan_over_ranges(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.randint(-9, 9)) for g in ("a", None, "hot") for k in rng.sample(range(5000), 900 if g == "hot" else 20)] + [("n", None, 4), ("n", 1, 5)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    got = {(r["g"], r["k"]): (r["at"], r["before"]) for r in scan.scanned(df, ["g"], [F.col("k").asc()], {"at": F.lit(1).cast("bigint"), "before": F.col("v")}, ranges=9).collect()}
    whole = {(r["g"], r["k"]): r["before"] for r in scan.scanned(df, [], [F.col("k").asc(), F.col("g").asc()], {"before": F.col("v")}, ranges=9).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or "")
    total, own = 0, {}
    for g, k, v in sorted(rows, key=order):
        at, before = own.get(g, (0, 0))
        assert got[g, k] == (at, before) and whole[g, k] == total
        own[g], total = (at + 1, before + v), total + v
    assert scan.scanned(df.limit(0), [], [F.col("k").asc()], {"at": F.lit(1)}).count() == 0


def test_keys_that_meet_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "HOT", 10)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, 1), ("c", 2)] + [(None, i) for i in range(30)], "k string, i int")
    right = spark.createDataFrame([("hot", 50, "x"), (None, 31, "y"), ("c", 1, "z"), ("d", 0, "-")], "k string, n bigint, v string")
    got = scan.looked_up(left, right, ["k"], "n", ["v"]).collect()
    assert len(got) == 82 and {(r["k"], r["v"]) for r in got} == {("hot", "x"), (None, "y"), ("c", "z")}


def test_poisson_counts(spark):
    means = [0, 1, 3, 17, 30, 31, 400, 10**7]
    df = spark.createDataFrame([(m,) for m in means], "m bigint").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    drawn = df.withColumn("w", ME.poisson(F.col("m"), F.lit(7), F.col("m"), F.col("i")))
    for r in drawn.groupBy("m").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("var"), F.min("w").alias("least")).collect():
        assert abs(r["mean"] - r["m"]) <= 5 * math.sqrt(r["m"] / 3000) and r["least"] >= 0
        assert r["m"] == 0 or abs(r["var"] / r["m"] - 1) < 0.15


def test_kendall(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(ME, "FAN", 3)
    data = [(rng.choice([1.5, -2.0, None, *map(float, range(40))]), rng.randint(0, 12)) for _ in range(250)] + [(7.0, 5)] * 60 + [(1.0, None)]
    df = spark.createDataFrame(data, "x double, y int").repartition(4)
    known = [(x, y) for x, y in data if x is not None and y is not None]
    pairs = [(a, b) for i, a in enumerate(known) for b in known[i + 1 :]]
    sign = [((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for a, b in pairs]
    tx, ty = sum(a[0] != b[0] for a, b in pairs), sum(a[1] != b[1] for a, b in pairs)
    r = ME.kendall(df, "x", "y").first()
    assert (r["concordant"], r["discordant"], r["n"]) == (sign.count(1), sign.count(-1), len(known))
    assert r["tau_b"] == pytest.approx((sign.count(1) - sign.count(-1)) / math.sqrt(tx * ty))
    assert ME.kendall(df, "x", "x").first()["tau_b"] == pytest.approx(1)
    assert ME.kendall(df.withColumn("c", F.lit(1)), "x", "c").first()["tau_b"] is None
    assert tuple(ME.kendall(df.limit(0), "x", "y").first()) == (None, 0, 0, 0)


def test_numbering_batches_and_sample(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = {r["v"]: r["n"] for r in RA.numbered(df, "v", "n").collect()}
    assert got == {v: v + 1 for v in range(1000)}
    assert RA.batches(df, "v", 300).groupBy("batch").count().count() == 4
    assert RA.audit_sample(df, "v", 0.0001, "s").count() == 1


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]

    assert one(TX.notations, "saw c.10delinsAT and p.Arg12Ter, c.76A>T") == ["c.10del", "c.76A>T", "p.Arg12Ter"]
    assert one(TX.clean_notation, "c.76A &gt; T") == "c.76A>T"
    assert one(TX.clean_notations, "NM_1.2:c.1067C > T/p.Ser356Phe and c.3930_3940del CCCTG, c.4582–2delAG/+") == ["c.1067C>T", "c.3930_3940delCCCTG", "c.4582-2_4582-1delAG"]
    assert one(TX.clean_notations, "p.(Arg12Ter).") == ["p.Arg12Ter"] and one(TX.clean_notations, "nothing") == []
    for short, long in (("c.100delAG", "c.100_101delAG"), ("c.100+1delAG", "c.100+1_100+2delAG"), ("c.4582-2delAG", "c.4582-2_4582-1delAG"), ("c.100-1delAG", "c.100-1delAG"), ("c.76A>T", "c.76A>T")):
        assert one(TX.expand_single_deletion, short) == long
    assert one(TX.markup_units, "<p>One <b>two</b></p><tr><td>aa</td><td>bb</td></tr><p>One two</p><p>x</p>") == ["One two", "aa | bb |"]
    assert one(lambda c: TX.windows(c, "b+", 2), "aabbccbdd") == ["aabbcc", "ccbdd"]
    assert one(lambda c: TX.nearest_before(c, "[A-Z]{3,}", F.lit(12), 12, "^PVS"), "SET1 PVS1 foo c.5A>T") == "SET"
    values = (0.91, 1e-5, 100000.0, 0.1234567, 123456.0, 0.0, 2.5, 1e6, 999999.7, 1.5e-7, 0.00012345678, -3.25, 1e22, 120.0)
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", TX.general(F.col("v")).alias("g")).collect()
    assert {r["i"]: r["g"] for r in got} == {i: f"{v:g}" for i, v in enumerate(values)}
    words = "see SCN8A c.5C>T; SETD 1A (PVS1) c.10A>G"
    places = one(lambda c: TX.matches_at(c, TX.CODING), words)
    assert [(p["at"], p["text"]) for p in places] == [(words.index("c.5"), "c.5C>T"), (words.index("c.10"), "c.10A>G")]
    assert [one(lambda c, p=p: TX.owned_by(c, F.lit(p["at"]), ["SETD1A"]), words) for p in places] == [False, True] and one(lambda c: TX.names_gene(c, ["setd1a"]), words)
    pointer = spark.createDataFrame([('{"a/b": [{"x": 5}]}',)], "j string").select(EV.json_pointer(F.col("j"), "/a~1b/0/x")).first()[0]
    assert pointer == "5"
    odd = spark.createDataFrame([('{"it\'s": {"0": "x"}, "a": [1, [2]]}',)], "j string").select(EV.json_pointer(F.col("j"), "/it's/0"), EV.json_pointer(F.col("j"), "/a/1/0"), EV.json_pointer(F.col("j"), "/a/9"), EV.json_pointer(F.col("j"), "/b/0")).first()
    assert list(odd) == ["x", "2", None, None]


def test_literature(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 20, 4, 9, 1])], "doc string, i int, size bigint")
    assert [r["kept"] for r in LI.select_passages(df, "doc", ["i"], "size", 3, 15).orderBy("i").collect()] == [True, False, True, False, True]
    assert [r["bin"] for r in LI.greedy_bins(df, "doc", ["i"], "size", 15).orderBy("i").collect()] == [0, 1, 2, 2, 2]
    requests = spark.createDataFrame([("a",), ("b",)], "request_digest string")
    records = spark.createDataFrame([("a", 1, "no"), ("a", 2, '```json\n{"x": 1}\n```')], "request_digest string, attempt int, text string")
    rows = {r["request_digest"]: r for r in LI.replayed(requests, records, strict=False).collect()}
    assert rows["a"]["json"] == '{"x": 1}' and rows["a"]["parsed"] and rows["b"]["json"] is None
    with pytest.raises(Exception, match="no record of b"):
        LI.replayed(requests, records).collect()


def test_composite(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(CO.weighted([(0.6, F.col("a")), (0.4, F.col("b"))])).collect()]
    assert got == [0.5, None, pytest.approx(0.6)]
    assert spark.createDataFrame([("x",)], "c string").select(CO.categorical(F.col("c"), {"x": 0.3})).first()[0] == 0.3
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("y",)], "c string").select(CO.categorical(F.col("c"), {"x": 0.3})).collect()


def test_observed(spark):
    df = spark.range(1).select(present(F.lit(1.5), F.lit("s")).alias("a"), absent("failed").alias("b"), absent("failed", reason="http_error").alias("c"), absent("searched_not_found", snapshots=[F.lit("s")], event="e").alias("d"), absent("not_searched").alias("e"))
    assert list(df.select(*(observed_valid(F.col(c)) for c in "abcde")).first()) == [True, False, True, True, True]
