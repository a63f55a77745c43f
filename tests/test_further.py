"""Assemblies, split sequences, journals, folds, streams of states, planned requests and annotation keys."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evirank.operators import assembly as AS
from evirank.operators import folds
from evirank.operators import identity as ID
from evirank.operators import literature as LI
from evirank.operators.evidence import effective_state
from evirank.sources import journal as JO
from evirank.sources import requests as RQ
from evirank.sources import sequences as SE
from evirank.streaming import states as ST

# ---- assemblies ----------------------------------------------------------------------------------------------------

CHAINS = """# made by hand
chain 900 a 100000 + 10 95 x 5000 + 100 178 1
20 5 0
30 0 3
20 10 5
0

chain 50 a 100000 + 15 40 y 300 - 7 32 2
25


chain 50 a 100000 + 30 60 z 300 + 0 30 3
30
"""


def test_chains_and_carried_alleles(spark, tmp_path):
    (tmp_path / "c.chain").write_text(CHAINS)
    blocks = AS.read_chains(spark, str(tmp_path))
    got = sorted((r["chain_id"], r["t_start"], r["t_end"], r["q_name"], r["q_strand"], r["q_start"]) for r in blocks.collect())
    assert got == [(1, 10, 30, "x", "+", 100), (1, 35, 65, "x", "+", 120), (1, 65, 85, "x", "+", 153), (1, 95, 95, "x", "+", 178), (2, 15, 40, "y", "-", 7), (3, 30, 60, "z", "+", 0)]
    rows = [
        (1, "a", 11, "A", "G"), (2, "a", 31, "CT", "C"), (3, "a", 36, "ACG", "A"), (4, "a", 65, "AC", "G"), (5, "a", 90, "A", "G"), (6, "b", 11, "A", "G"), (7, None, 11, "A", "G"), (8, "a", 0, "A", "G"), (9, "a", 31, "A", None),
        (10, "a", 20, "", "G"), (11, "a", 33, "A", "C"),
    ]
    rows += [(100 + i, "a", 11, "A", "G") for i in range(40)]
    out = {r["id"]: r for r in AS.carried(spark.createDataFrame(rows, "id int, chrom string, pos bigint, ref string, alt string"), blocks).collect()}
    assert len(out) == len(rows)
    told = lambda i: tuple(out[i][c] for c in ("map_status", "to_chrom", "to_pos", "to_ref", "to_alt", "map_chain", "to_normalise"))
    none = (None,) * 5 + (False,)
    assert told(1) == told(123) == ("resolved", "x", 101, "A", "G", 1, False)
    assert told(2) == told(11) == ("ambiguous", *none)  # two chains of equal score and none better
    assert told(3) == ("resolved", "x", 121, "ACG", "A", 1, False)  # the best score of three
    assert told(4) == ("split", *none) and told(5)[0] == told(6)[0] == "unmapped"
    assert {told(i)[0] for i in (7, 8, 9, 10)} == {"insufficient"}
    alone = AS.carried(spark.createDataFrame([(1, "a", 16, "CTT", "C"), (2, "a", 16, "C", "T")], "id int, chrom string, pos bigint, ref string, alt string"), blocks.where("chain_id = 2")).collect()
    # 25 bases from 7 on the - strand of 300 are 268 to 293 on the + strand
    assert {(r["id"], r["to_pos"], r["to_ref"], r["to_alt"], r["to_normalise"]) for r in alone} == {(1, 291, "AAG", "G", True), (2, 293, "G", "A", False)}


@pytest.mark.parametrize("text", ["chain 1 a 10 + 0 5 x 10 + 0 5 1\n4\n", "chain 1 a 10 - 0 5 x 10 + 0 5 1\n5\n", "chain x\n5\n", "chane 1 a 10 + 0 5 x 10 + 0 5 1\n5\n"])
def test_chains_that_are_malformed(spark, tmp_path, text):
    (tmp_path / "c.chain").write_text(text)
    with pytest.raises(Exception, match="no chain|add up|strand"):
        AS.read_chains(spark, str(tmp_path)).collect()


# ---- sequences -----------------------------------------------------------------------------------------------------


def fasta_files(folder):
    rng = random.Random(11)
    made = {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in (("one", 4000), ("two", 61), ("three", 60), ("none", 0), ("four", 1500))}
    wrap = lambda s, k: "\n".join(s[i : i + k] for i in range(0, len(s), k))
    (folder / "a.fa").write_text(f">one first contig\n{wrap(made['one'].lower(), 60)}\n\n>two\n{wrap(made['two'], 60)}\n>none\n>three x\n{made['three']}")
    (folder / "b.fa").write_text(f"\n> four\r\n{wrap(made['four'], 7)}\n".replace("\n", "\r\n").replace("\r\r", "\r"))
    return made


def test_sequences_over_many_splits(spark, tmp_path):
    made = fasta_files(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 8
        ranges = SE.sequence_ranges(spark, str(tmp_path), 100)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = {n: "".join(r["sequence"] for r in sorted(ranges.where(F.col("chrom") == n).collect(), key=lambda r: r["chunk"])) for n in made}
    assert got == made and ranges.where("length(sequence) > 100").count() == 0
    rng = random.Random(3)
    rows = [(i, rng.choice([*made, "absent", None]), (s := rng.randint(-5, 4100)), s + rng.randint(-1, 260)) for i in range(300)] + [(300 + i, "one", 95, 210) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, chrom string, a bigint, b bigint")
    for r in SE.bases_between(df, ranges, F.col("a"), F.col("b"), "bases", 100).collect():
        a, b = max(0, r["a"]), r["b"]
        assert r["bases"] == ((made.get(r["chrom"], "")[a:b] or None) if b > r["a"] and b > 0 else None), r


def test_normalised_in_ranges_as_in_whole_contigs(spark, tmp_path):
    made = fasta_files(tmp_path)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        chrom = rng.choice(["one", "two", "four", "gone"])
        seq = made.get(chrom, "A" * 50)
        at = rng.randint(1, len(seq) + 5)
        ref = seq[at - 1 : at - 1 + rng.randint(1, 4)] or "A"
        rows.append((str(i), "T", chrom, at + (1000 if chrom == "two" else 0), ref if rng.random() < 0.9 else "N", rng.choice(["A", "C", ref[0], ref + ref[-1], ref[0] + "TT"])))
    mentions = spark.createDataFrame(rows, "mention_id string, assembly string, chrom string, pos bigint, ref string, alt string")
    manifest = {"contigs": {"one": "NC1", "two": {"accession": "NC2", "start": 1001}, "four": "NC4"}}
    declared = SE.declared(spark, manifest)
    whole = declared.join(spark.createDataFrame([(n, s) for n, s in made.items()], "chrom string, sequence string"), "chrom")
    columns = ["mention_id", "identity_status", "reason", "variant_id", "la_pos", "la_ref", "la_alt"]
    want = {r["mention_id"]: r for r in ID.normalise(mentions, whole, "T", flank=30).select(columns).collect()}
    got = {r["mention_id"]: r for r in ID.normalise_in_ranges(mentions, SE.sequence_ranges(spark, str(tmp_path), 64), declared, "T", flank=30, chunk=64).select(columns).collect()}
    assert len(want) == 120 and sum(r["variant_id"] is not None for r in want.values()) > 40
    for k, r in want.items():
        same = columns if r["variant_id"] is not None else columns[:4]
        assert [got[k][c] for c in same] == [r[c] for c in same], (k, rows[int(k)])


@pytest.mark.parametrize("texts", [["ACGT\n>a\nA\n"], [">a\nA\n", ">a\nC\n"], [">\nACGT\n"]])
def test_sequences_that_are_malformed(spark, tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fa").write_text(t)
    with pytest.raises(Exception, match="named header|twice"):
        SE.sequence_ranges(spark, str(tmp_path)).collect()


# ---- journals ------------------------------------------------------------------------------------------------------


def test_journal(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    rows = spark.createDataFrame([(i, f"é\n{i % 7}", None) for i in range(200)], "id bigint, text string, none string")
    read = lambda: JO.rows_of(spark, path, "claims", "id bigint, text string, none string")
    assert read().count() == 0
    JO.append(rows.where("id < 150").repartition(5), path, "claims", rows_per_blob=40)
    first = JO.digests_of(path, "claims")
    JO.append(rows.where("id < 150").orderBy(F.desc("id")), path, "claims", rows_per_blob=40)  # the same rows in another order
    assert JO.digests_of(path, "claims") == first and first[0][:2] == (1, 150)
    with pytest.raises(Exception, match="broken row"):
        JO.append(rows.withColumn("text", F.when(F.col("id") == 180, F.raise_error(F.lit("broken row"))).otherwise(F.col("text"))), path, "claims", rows_per_blob=40)
    assert JO.digests_of(path, "claims") == first and read().count() == 150
    JO.append(rows.where("id >= 150"), path, "claims")
    assert [(r["version"], r["id"], r["text"]) for r in read().orderBy("id").collect()] == [(1 if i < 150 else 2, i, f"é\n{i % 7}") for i in range(200)]
    JO.append(rows.limit(0), path, "links")
    assert JO.digests_of(path, "links") == []
    with pytest.raises(Exception):
        rows.write.format(JO.NAME).option("path", path).option("table", "claims").mode("overwrite").save()


def test_journal_of_contents(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    bodies = [b"one", b"two\xff", b"one", b""]
    rows = spark.createDataFrame([(f"s{i}", bytearray(b)) for i, b in enumerate(bodies)] + [("s9", None)], "snapshot_id string, body binary")
    JO.append(rows, path, "snapshots", content="body")
    got = {r["snapshot_id"]: r["body"] for r in JO.rows_of(spark, path, "snapshots", "snapshot_id string, body string").collect()}
    assert got == {**{f"s{i}": hashlib.sha256(b).hexdigest() for i, b in enumerate(bodies)}, "s9": None}
    assert all(JO.blob(path, got[f"s{i}"]) == b for i, b in enumerate(bodies))
    stray = tmp_path / "j" / "blobs" / "00" / ("0" * 64)
    stray.parent.mkdir(parents=True, exist_ok=True)
    stray.write_bytes(b"left by an aborted write")
    assert JO.vacuum(spark, path, {"snapshots": "body"}) == 1 and not stray.exists()
    assert all(JO.blob(path, got[f"s{i}"]) == b for i, b in enumerate(bodies))
    listed = {r["blob"] for r in JO.lines_of(spark, path, "snapshots").collect()}
    changed = tmp_path / "j" / JO.blob_path(listed.pop())
    changed.write_bytes(changed.read_bytes().replace(b"s1", b"s2"))
    with pytest.raises(Exception, match="altered"):
        JO.lines_of(spark, path, "snapshots").collect()


def test_journal_reads_many_blobs_in_a_task_and_keeps_separators_in_lines(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    texts = ["a\u2028b", "c\x85d", "e\u2029", "f\rg\x0b\x1c"] + [f"t{i}" for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    JO.append(rows.unionAll(rows), path, "claims", rows_per_blob=20)  # equal lines count once
    got = JO.rows_of(spark, path, "claims", "id bigint, text string")
    assert sorted((r["id"], r["text"]) for r in got.collect()) == list(enumerate(texts))
    assert JO.lines_of(spark, path, "claims").select("blob").distinct().count() > 20 and got.rdd.getNumPartitions() == 1


# ---- folds ---------------------------------------------------------------------------------------------------------


def test_folds_carry_their_state_over_batches(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.choice([0, 1, 2, 3, 5, 9, 15, None])) for g in ("a", None, "hot") for i in range(500 if g == "hot" else 12)] + [("b", None, 4)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        bins = {(r["g"], r["i"]): r["bin"] for r in LI.greedy_bins(df, "g", ["i"], "n", 10).collect()}
        kept = {(r["g"], r["i"]): r["kept"] for r in LI.select_passages(df, "g", ["i"], "n", 20, 60).collect()}
        assert folds.folded(df.limit(0), ["g"], ["i"], "n", (0, 0), folds.next_fit(5), "bin", "bigint").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state = {}
    for g, i, n in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0)):
        b, used, units, taken = state.get(g, (0, 0, 0, 0))
        b, used = (b + 1, n or 0) if used > 0 and used + (n or 0) > 10 else (b, used + (n or 0))
        fits = units < 20 and taken + (n or 0) <= 60
        state[g] = (b, used, units + fits, taken + (n or 0) * fits)
        assert (bins[g, i], kept[g, i]) == (b, fits)


# ---- streams -------------------------------------------------------------------------------------------------------


def test_stream_keeps_states_as_the_log_has_them(spark, tmp_path):
    rng = random.Random(1)
    kinds, outcomes = ["host", "human", "model", "importer"], ["rejected", "accepted_human", "accepted_auto", "draft", "mechanically_valid"]
    rows = [(f"l{rng.randint(0, 40)}", i, rng.choice(kinds), rng.choice(outcomes[1:] if rng.random() < 0.8 else outcomes), rng.choice(["unreviewed"] * 9 + ["rejected"])) for i in range(200)]
    log = spark.createDataFrame(rows, "link_id string, sequence bigint, reviewer_type string, effective_state string, human_review string")
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: {r["link_id"]: (r["state"], r["version"]) for r in ST.latest(stream(), ["link_id"], f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()}
    first = run()
    assert {k: v[0] for k, v in first.items()} == {r["link_id"]: r["state"] for r in effective_state(log, ["link_id"]).collect()}
    more = [("l1", 500, "human", "accepted_human", "unreviewed"), ("l2", 501, "host", "rejected", "unreviewed"), ("new", 1, "host", "mechanically_valid", "unreviewed"), ("l3", -1, "model", "draft", "unreviewed")]
    spark.createDataFrame(more, log.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    second = run()  # from its checkpoint: the first log is not read again
    whole = effective_state(log.unionByName(spark.createDataFrame(more, log.schema)), ["link_id"])
    assert {k: v[0] for k, v in second.items()} == {r["link_id"]: r["state"] for r in whole.collect()}
    assert second["l2"][0] == "rejected" and second["new"] == ("mechanically_valid", 1)


def test_stream_states_are_aggregates_and_versions_count_changes(spark, tmp_path):
    schema = "link_id string, sequence bigint, reviewer_type string, effective_state string, human_review string"
    for n, state in enumerate(["draft", "draft", "accepted_auto", None]):
        spark.createDataFrame([("l1", n, "model", state, "unreviewed")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = ST.latest(stream, ["link_id"], f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()
        assert [(r["state"], r["version"]) for r in got] == [(state or "accepted_auto", 1 if state == "draft" else 2)]
    assert "TransformWithState" not in ST.states(stream, ["link_id"])._jdf.queryExecution().logical().toString()  # no Python call for each link


# ---- requests ------------------------------------------------------------------------------------------------------


def test_planned_requests_are_matched_back(spark):
    rows = [("1", p, "A", "C") for p in range(450)] * 2 + [("2", 5, "AC", "A"), (None, 5, "A", "C"), ("2", None, "A", "C")]
    alleles = spark.createDataFrame(rows, "chrom string, pos bigint, ref string, alt string").repartition(4)
    plan = RQ.planned(alleles, ["chrom", "pos", "ref", "alt"], RQ.allele_input())
    assert sorted((r["batch"], r["n"]) for r in plan.groupBy("batch").agg(F.count("*").alias("n")).collect()) == [(0, 200), (1, 200), (2, 51)]
    asked = RQ.requests(plan, "vep")
    assert asked.select("request_key").distinct().count() == 3
    assert {r["request_key"] for r in asked.collect()} == {r["request_key"] for r in RQ.requests(RQ.planned(alleles.orderBy(F.desc("pos")), ["chrom", "pos", "ref", "alt"], RQ.allele_input()), "vep").collect()}
    assert plan.where("chrom = '2'").first()["input"] == "2 5 . AC A . . ."
    keys = {r["batch"]: r["request_key"] for r in asked.collect()}
    inputs = {(r["batch"], r["place"]): r["input"] for r in plan.collect()}
    record = "struct<input:string,effect:string>"

    def replied(batches):
        import json

        return spark.createDataFrame([(keys[b], json.dumps(rs)) for b, rs in batches.items()], "request_key string, body string")

    good = replied({b: [{"input": x, "effect": "e"} for (k, p), x in inputs.items() if k == b and p % 5] for b in (0, 2)})
    got = {r["input"]: r["status"] for r in RQ.matched_back(plan, asked, good, record).collect()}
    assert len(got) == 451 and all(got[x] == ("unanswered" if b == 1 else "matched" if p % 5 else "missing") for (b, p), x in inputs.items())
    odd = replied({0: [{"input": inputs[0, 1], "effect": "b"}, {"input": inputs[0, 1], "effect": "a"}, {"input": inputs[1, 0], "effect": "of another batch"}, {"input": None, "effect": "x"}]})
    with pytest.raises(Exception, match="foreign|doubled"):
        RQ.matched_back(plan, asked, odd, record).collect()
    loose = RQ.matched_back(plan, asked, odd, record, strict=False).collect()
    assert sorted(r["status"] for r in loose if r["status"] in ("foreign", "doubled", "matched")) == ["doubled", "foreign", "foreign"]
    assert next(r for r in loose if r["status"] == "doubled")["record"]["effect"] == "a"


# ---- annotation keys -----------------------------------------------------------------------------------------------


def test_annotations_meet_alleles_by_normalised_keys(spark):
    seq = "GGCAAAAATTCG"
    contigs = spark.createDataFrame([("1", "NC", 1, seq)], "chrom string, accession string, offset bigint, sequence string")
    mention = "mention_id string, raw_text string, assembly string, chrom string, pos bigint, ref string, alt string, roles array<string>, ordinal bigint, resolution_status string, resolution_note string"
    mentions = spark.createDataFrame([("m1", "x", "T", "1", 8, "A", "AA", ["r"], 1, None, None), ("m2", "y", "T", "1", 3, "C", "CA", ["s"], 2, None, None), ("m3", "z", "T", "1", 11, "C", "T", [], 3, None, None)], mention)
    found = ID.resolve(mentions, contigs, "T")
    registry = ID.registry(found)
    notes = spark.createDataFrame([(("1", 5, "A", "AA"), 1, ["stop_gained"]), (("1", 10, "TC", "TT"), 2, None), (("1", 1, "G", "T"), 3, ["x"])], "allele struct<chrom:string,pos:bigint,ref:string,alt:string>, note int, terms array<string>")
    keyed = ID.annotation_keys(notes, contigs, "T")
    assert {(r["pos"], r["note"]) for r in ID.annotated(registry, keyed).collect()} == {(3, 1), (11, 2)}  # three spellings of one insertion
    kept, gone = ID.scope_exclusions(registry, keyed, ID.decisions(found), "terms", ["missense"])
    assert kept.count() == 0
    assert {(r["mention_id"], r["reason"]) for r in gone.collect()} == {("m1", "consequence stop_gained outside declared scope"), ("m2", "consequence stop_gained outside declared scope"), ("m3", "no consequence on the selected transcript outside declared scope")}
    assert ID.scope_exclusions(registry, keyed.where("note = 9"), ID.decisions(found), "terms", ["missense"])[0].count() == 2
    assert ID.scope_exclusions(registry, keyed, ID.decisions(found), "terms", [])[1].count() == 0
    with pytest.raises(Exception, match="cannot be normalised"):
        ID.annotation_keys(notes.withColumn("allele", F.struct(F.lit("1").alias("chrom"), F.lit(1).cast("bigint").alias("pos"), F.lit("T").alias("ref"), F.lit("G").alias("alt"))), contigs, "T").collect()


# ---- profiles ------------------------------------------------------------------------------------------------------


def documents_of_a_profile():
    import copy

    from evirank import profile as PR

    anchors = {n: {"type": "identity"} for n in [*PR.DISEASE_INPUTS, *PR.FUNCTIONAL_INPUTS, *PR.EDITING_INPUTS.values(), "alphamissense_score"]}
    part = {"fine_mapping": 0.3, "clinical_evidence": 0.25, "recurrence": 0.2, "rarity": 0.15, "segregation": 0.1}
    modes = {"a": {"weights": {"disease": 0.4, "functional": 0.2, "mechanism": 0.3, "editability": 0.1}, "novelty_alpha": 0.1, "composition": {"x": 0.5, "y": 0.5}}, "b": {"inherits": "a", "novelty_alpha": 0.0}, "c": {"inherits": "b"}}
    scoring = {"version": 1, "ranking_modes": modes, "components": {"disease": part, "functional": {}, "editability": dict.fromkeys(PR.EDITING_INPUTS, 0.2)}, "validation": {"forbid_fields_in_scoring": ["agent_confidence"]}}
    return copy.deepcopy((scoring, {"version": 1, "anchors": anchors}, {"version": 1, "branches": {"missense": {"alphamissense_score": 1.0}}}, {"version": 1, "gating": {"unknown": {"default": 1.0}}}))


def test_profiles_are_checked_as_a_whole(spark, tmp_path):
    from evirank import profile as PR

    made = PR.Profile.read(*documents_of_a_profile())
    assert made.modes["c"]["alpha"] == 0.0 and made.modes["c"]["weights"] == made.modes["a"]["weights"] and made.modes["b"]["composition"] is None

    def broken(change, said):
        docs = documents_of_a_profile()
        change(*docs)
        with pytest.raises(PR.ProfileError, match=said):
            PR.Profile.read(*docs)

    broken(lambda s, a, b, g: a["anchors"].pop("gwas_pip") and a["anchors"].pop("indel_length"), "without an anchor: gwas_pip, indel_length|without an anchor: indel_length, gwas_pip")
    broken(lambda s, a, b, g: b["branches"].update(ptv={"alphamissense_score": 0.9}), "branch ptv sum")
    broken(lambda s, a, b, g: s["ranking_modes"]["a"].update(inherits="c"), "circle")
    broken(lambda s, a, b, g: s["ranking_modes"]["b"].update(inherits="z"), "unknown z")
    broken(lambda s, a, b, g: s["ranking_modes"]["a"]["weights"].update(disease=0.5), "sum to 1.1")
    broken(lambda s, a, b, g: s["components"]["functional"].update(aggregation="sum"), "by max")
    for wrong in ({"type": "piecewise", "breakpoints": [2, 1], "values": [0, 1]}, {"type": "piecewise", "breakpoints": [1], "values": [0, 1]}, {"type": "categorical"}, {"type": "identity", "lo": 1, "hi": 1}, {"type": "rank"}, {"type": "identity", "min": 0}, {"type": "categorical", "map": {"x": 2}}):
        broken(lambda s, a, b, g, w=wrong: a["anchors"].update(gwas_pip=w), "anchor gwas_pip")
    args = (F.lit("missense"), F.lit("unknown"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("boolean"))
    for inputs in ({"agent_confidence": F.lit(1)}, {"nonsense": F.lit(1)}):
        with pytest.raises(PR.ProfileError, match="no inputs"):
            made.scored(spark.range(1), "a", inputs, *args)
    row = made.scored(spark.range(1), "a", {"alphamissense_score": F.lit(0.9)}, *args).first()
    assert (row["mechanism"], row["gate_key"], row["composite"], row["disease"]) == (0.9, "default", pytest.approx(0.9), None)
    with pytest.raises(Exception, match="no branch for class ptv"):
        made.scored(spark.range(1), "a", {}, F.lit("ptv"), *args[1:]).collect()


def test_anchors(spark):
    import math

    from evirank.profile import Anchor

    xs = [-30.0, 0.0, 1e-7, 1e-5, 3e-4, 0.05, 0.4, 1.0, 2.0, 7.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    log = Anchor.read("af", {"type": "piecewise", "breakpoints": [1e-6, 1e-4, 1e-1], "values": [0.0, 0.3, 0.9], "log_scale": True, "invert": True})
    clamp = Anchor.read("c", {"type": "linear_clamp", "lo": -1, "hi": 3})

    def plain(x):
        bps, vals = [1e-6, 1e-4, 1e-1], [0.0, 0.3, 0.9]
        if x <= bps[0] or x >= bps[-1]:
            return 1 - (vals[0] if x <= bps[0] else vals[-1])
        i = max(k for k in range(2) if bps[k] <= x)
        share = (math.log10(x) - math.log10(bps[i])) / (math.log10(bps[i + 1]) - math.log10(bps[i]))
        return 1 - (vals[i] + share * (vals[i + 1] - vals[i]))

    for r in df.select("x", log.of(F.col("x")).alias("log"), clamp.of(F.col("x")).alias("clamp")).collect():
        if r["x"] is None:
            assert r["log"] is None and r["clamp"] is None
        else:
            assert r["log"] == pytest.approx(plain(r["x"])) and r["clamp"] == pytest.approx(min(1, max(0, (r["x"] + 1) / 4)))
    stars = Anchor.read("s", {"type": "categorical", "map": {"4": 1.0, "likely_pathogenic": 0.8}, "unmapped": 0.1})
    flag = Anchor.read("f", {"type": "boolean", "map": {True: 1.0, False: 0.2}})
    row = df.limit(1).select(stars.of(F.lit(4.0)).alias("a"), stars.of(F.lit(" Likely Pathogenic")).alias("b"), stars.of(F.lit("?")).alias("c"), flag.of(F.lit(False)).alias("d")).first()
    assert tuple(row) == (1.0, 0.8, 0.1, 0.2)
    with pytest.raises(Exception, match="unknown category"):
        df.select(flag.of(F.lit("maybe"))).collect()


# ---- specs, notations, replies and scope ---------------------------------------------------------------------------


def test_specs_are_typed():
    from evirank import specs as SP

    said = {"gene": "G1", "disease": {"input": "d"}, "routes": {"clinvar": True}, "mechanism_rule": {"clingen_hi_scores_for_lof": [3], "burden_max_p": "2.5e-6"}, "case_cohorts": {"s": {"disease_relationship": "exact"}}, "literature": {"screening": {"batch_size": 40}}}
    made = SP.read_spec(SP.Request, said)
    assert (made.flank, made.mechanism_rule.burden_max_p, made.literature.screening.batch_size, made.literature.screening.audit_seed, made.literature.deep_read.max_units_per_paper) == (2000, 2.5e-6, 40, 42, 15)
    wrong = [
        ({"gen": 1}, "unknown in the spec: gen"), ({"gene": 5}, "gene must be str"), ({"flank": True}, "flank must be int"), ({"flank": -1}, "negative"), ({"routes": {}}, "route"), ({"scope": {"allowed_consequences": ["a", 2]}}, r"allowed_consequences\[1\]"),
        ({"disease": {}}, "missing in disease: input"), ({"case_cohorts": {"s": {"disease_relationship": "alike"}}}, "unknown: alike"), ({"literature": {"screening": {"audit_fraction": 2}}}, "audit_fraction"), ({"mechanism_rule": {"burden_max_p": "x"}}, "must be a number"),
    ]
    for change, message in wrong:
        with pytest.raises(SP.SpecError, match=message):
            SP.read_spec(SP.Request, {**said, **change})
    sets = {"u": {"role": "primary", "readout": "r", "abnormal_max": -2, "normal_min": -1.5}, "v": {"role": "secondary", "readout": "q"}}
    assert SP.read_spec(SP.Evaluation, {"run": "x", "score_sets": sets}).score_sets["u"].abnormal_max == -2.0
    for change in ({"u": {**sets["u"], "role": "secondary"}}, {"v": {**sets["v"], "role": "primary"}}, {"u": {**sets["u"], "abnormal_max": 0}}, {"v": {**sets["v"], "normal_min": 0}}):
        with pytest.raises(SP.SpecError):
            SP.read_spec(SP.Evaluation, {"run": "x", "score_sets": {**sets, **change}})


def test_notations_with_their_transcripts(spark):
    from evirank.functions import text as TX

    cases = {
        "NM_014712.2 :c.3930_3940del CCCTGCGCCAG": [("c.3930_3940delCCCTGCGCCAG", "NM_014712.2")],
        "c.1067C &gt; T/p.Ser356Phe": [("c.1067C>T", None)],
        "NM_1:c.5A&#x3e;G; SETD1A: p.(Arg12&#42;); c.4582&#8211;2delAG/+": [("c.5A>G", "NM_1"), ("c.4582-2_4582-1delAG", None)],
        "SETD1A:p.(Arg12Ter).": [("p.Arg12Ter", None)],
        "p.Arg9 ∗/wt": [("p.Arg9*", None)],
        "c.7G&amp;gt;A": [("c.7G&gt", None)],
        "&#55296; &#99999999; nothing here": [],
        "": [],
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i int, t string")
    got = {r["t"]: r["f"] for r in df.select("t", TX.cleaned_notations(F.col("t")).alias("f")).collect()}
    assert {k: [tuple(x) for x in got[k]] for k in cases} == cases and got[None] is None


def test_population_replies(spark):
    import json

    from evirank.sources import records as RE

    call = lambda ac, an, *filters: {"ac": ac, "an": an, "filters": list(filters)}
    gene = {"gene_id": "ENSG1", "variants": [{"variant_id": "a", "pos": 5, "exome": call(1, 100), "genome": call(3, 100)}, {"variant_id": "b", "pos": 6, "exome": call(1, 100, "AC0"), "genome": call(2, 50)}, {"variant_id": "c", "pos": 7, "exome": call(1, 100, "AC0"), "genome": None}, {"variant_id": "d", "pos": 8, "genome": call(0, 0)}]}
    read = lambda body: {r["variant_id"]: (r["frequency"], r["reason"]) for r in RE.population_variants(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()}
    assert read({"data": {"gene": gene}}) == {"a": (0.02, None), "b": (0.04, None), "c": (None, "no_passing_call"), "d": (None, "no_passing_call")}
    for wrong in ({"errors": [{"message": "Gene not found"}], "data": {"gene": None}}, {"data": {"gene": None}}):
        with pytest.raises(Exception, match="invalid reply"):
            read(wrong)


def test_links_out_of_scope_are_judged_by_scope_alone(spark):
    from evirank.operators import evidence as EV

    links = spark.createDataFrame([("a", "v1", [], "mechanically_valid"), ("b", "v1", ["claim_scope"], "rejected"), ("c", "v2", ["claim_scope", "identity_decision"], "rejected"), ("d", "v3", [], "mechanically_valid"), ("e", None, [], "mechanically_valid")], "link_id string, variant_id string, reasons array<string>, host_state string")
    gone = spark.createDataFrame([("v1",), ("v1",), (None,)], "variant_id string")
    out = {r["link_id"]: (r["checks"], r["reasons"], r["host_state"]) for r in EV.scoped_checks(links, gone).collect()}
    assert out["a"] == out["b"] == ({"scope": "fail"}, [EV.OUT_OF_SCOPE], "rejected")
    assert out["c"] == ({"claim_scope": "fail", "identity_decision": "fail"}, ["claim_scope", "identity_decision"], "rejected")
    assert out["d"] == out["e"] == ({"mechanical": "pass"}, [], "mechanically_valid") and len(out) == 5
