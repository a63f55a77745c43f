"""Readers, parsers, bundles and the stream on files made here."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank import bundle
from evirank.policy import default_policy
from evirank.sources import archive, records, tables
from evirank.streaming import decisions



def test_mentions_tsv(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("## note\nmention_id\tchrom\tpos\troles\tsource_refs\n m1\t1\t12\tnegative_control, comparison\ta;b\nm2\t\t\t\t\n")
    rows = tables.mentions_tsv(spark, str(tmp_path / "v.tsv"), "manual").orderBy("ordinal").collect()
    assert [(r["mention_id"], r["pos"], r["roles"], r["source_refs"], r["route"]) for r in rows] == [("m1", 12, ["negative_control", "comparison"], ["a", "b"], "manual"), ("m2", None, [], [], "manual")]


def test_strict_jsonl(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b struct<c: string>")
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n{"a": 2}\n')
    assert tables.strict_jsonl(spark, str(tmp_path / "x.jsonl"), schema).count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1, "b": {"c": "x", "d": 1}}\n')
    with pytest.raises(Exception, match="unknown field"):
        tables.strict_jsonl(spark, str(tmp_path / "y.jsonl"), schema).collect()


def test_fasta_and_snapshots(spark, tmp_path):
    data = b">1 first\nacg\nTT\n>2\nGG\n"
    (tmp_path / "r.fa").write_bytes(data)
    good = {"sha256": hashlib.sha256(data).hexdigest(), "contigs": {"1": "NC_1", "2": {"accession": "NC_2", "start": 1001}}}
    got = {r["chrom"]: (r["accession"], r["offset"], r["sequence"]) for r in tables.fasta(spark, str(tmp_path / "r.fa"), good).collect()}
    assert got == {"1": ("NC_1", 1, "ACGTT"), "2": ("NC_2", 1001, "GG")}
    for bad, why in (({**good, "sha256": "0"}, "checksum"), ({**good, "contigs": {"3": "NC_3"}}, "absent")):
        with pytest.raises(Exception, match=why):
            tables.fasta(spark, str(tmp_path / "r.fa"), bad).collect()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("body")
    index = spark.createDataFrame([("a.txt", "snap", hashlib.sha256(b"body").hexdigest())], "file string, snapshot_id string, digest string")
    assert tables.snapshots(spark, str(tmp_path / "s"), index).first()["text"] == "body"
    (tmp_path / "s" / "a.txt").write_text("edited")
    with pytest.raises(Exception, match="altered"):
        tables.snapshots(spark, str(tmp_path / "s"), index).collect()


def test_archive_units(spark):
    sheet = b'<worksheet xmlns="x"><sheetData><row r="2"><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>'
    book, doc, out = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>c.76A&gt;T</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", "<d><p><t>Hello</t></p><p/></d>")
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("a.xlsx", book.getvalue()), ("b.docx", doc.getvalue()), ("c.csv", "x,y\n1,2\n"), ("d.xlsx", b"broken"), ("e.bin", b"?")):
            z.writestr(name, data)
    df = spark.createDataFrame([("z", out.getvalue()), ("bad", b"no archive")], "id string, content binary")
    rows = {(r["id"], r["file"], r["where"]): (r["text"], r["error"]) for r in archive.archive_units(df, "id", "content").collect()}
    assert rows["z", "a.xlsx", "sheet=sheet1;row=2"][0] == "c.76A>T | 7" and rows["z", "b.docx", "block=1"][0] == "Hello" and rows["z", "c.csv", "row=2"][0] == "1 | 2"
    assert rows["z", "d.xlsx", ""][1] and rows["bad", "", ""][1] and len(rows) == 6


def test_records(spark):
    df = spark.createDataFrame([("NC_1:10:AT:", "G"), ("NC_1:10:A:C", "G")], "s string, base string")
    assert [(r["pos"], r["ref"], r["alt"]) for r in records.spdi_to_vcf(df, "s", "base").collect()] == [(10, "GAT", "G"), (11, "A", "C")]
    calls = spark.createDataFrame([((2, 10, []), (1, 10, ["AC0"])), ((2, 10, ["x"]), None)], "e struct<ac: bigint, an: bigint, filters: array<string>>, g struct<ac: bigint, an: bigint, filters: array<string>>")
    assert [r[0] for r in calls.select(records.joint_frequency(F.col("e"), F.col("g"))).collect()] == [0.2, None]
    effect = "e struct<consequence_terms: array<string>, lof_info: string, alphamissense: double, DS_AG: double, DS_AL: double, DS_DG: double, DS_DL: double>"
    rows = [((["missense_variant"], None, 0.7, 0.1, 0.2, 0.3, 0.0),), ((["stop_gained"], "PERCENTILE:1,50_BP_RULE:PASS", None, 0.1, None, 0.3, 0.0),)]
    a, b = records.annotation(spark.createDataFrame(rows, effect), "e", F.lit("s")).collect()
    assert (a["nmd"]["status"], a["splice_delta"]["value"], a["alphamissense"]["value"]) == ("not_applicable", 0.3, 0.7)
    assert (b["nmd"]["value"], b["splice_delta"]["status"], b["alphamissense"]["status"]) == ("triggers", "not_available", "not_applicable")
    m = spark.createDataFrame([("3", None, None), ("0", "0.01", "2"), ("0", "n/a", "2")], "h string, p string, o string")
    assert [r["mechanism"] for r in records.mechanism_rule(m, "h", "p", "o").collect()] == ["loss_of_function", "loss_of_function", "unknown"]
    s = spark.createDataFrame([(["a"],), (["a", "b"],), ([],), (None,)], "s array<string>")
    assert [r["status"] for r in records.recoder_status(s, "s").collect()] == ["unique", "ambiguous", "unmapped", "unsupported"]


def inputs(spark):
    return {
        "variants": spark.createDataFrame([("v1", "a", [], "1", 5, "A", "C"), ("v2", "b", [], "2", 5, "A", "C")], "variant_id string, label string, roles array<string>, chrom string, pos bigint, ref string, alt string"),
        "annotations": spark.createDataFrame([("v1", ["missense_variant"], None, True, {"alphamissense": ("value_present", 0.5)}), ("v2", ["missense_variant"], None, True, {})], "variant_id string, terms array<string>, nmd string, in_functional_domain boolean, predictions map<string, struct<status: string, value: double>>"),
        "evidence": spark.createDataFrame([("v1", "l1", "exact_genomic", "association", None, None, 2, True, "exact")], "variant_id string, link_id string, identity_match string, kind string, perturbation_type string, outcome_type string, cases bigint, controls_known boolean, disease_relationship string"),
    }


def test_bundle_replays_and_refuses_changes(spark, tmp_path):
    policy = default_policy()
    bundle.freeze(inputs(spark), "loss_of_function", policy, str(tmp_path / "b"))
    first = bundle.derive(spark, str(tmp_path / "b"), policy, str(tmp_path / "d1"))
    assert first["status"] == "complete" and bundle.replay(spark, str(tmp_path / "b"), policy, str(tmp_path / "d1"), str(tmp_path / "d2"))
    for name in ("features.jsonl", "ranked_variants.csv", "report.md"):
        assert (tmp_path / "d1" / name).read_bytes() == (tmp_path / "d2" / name).read_bytes()
    assert json.loads((tmp_path / "d1" / "features.jsonl").read_text().splitlines()[0])["variant_id"] == "v1"
    with (tmp_path / "b" / "evidence.jsonl").open("a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="altered"):
        bundle.derive(spark, str(tmp_path / "b"), policy, str(tmp_path / "d3"))


def test_stream_of_decisions(spark, tmp_path):
    schema = "link_id string, claim_revision int, sequence bigint, reviewer_type string, human_review string, effective_state string"
    source = tmp_path / "in"
    for i, (state, who) in enumerate([("accepted_auto", "model"), ("rejected", "human")]):
        spark.createDataFrame([("l", 1, i, who, "unreviewed", state)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        decisions.maintain(stream, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "cp"), ["link_id", "claim_revision"]).awaitTermination()
        now = decisions.current(spark.read.parquet(str(tmp_path / "state")), ["link_id", "claim_revision"]).first()
        assert now["state"] == state


def test_saved_replies(spark, tmp_path):
    from evirank.sources import replies

    key = replies.request_key("s", "1", {"q": "x"})
    assert key == replies.request_key("s", "1", {"q": "x"}) != replies.request_key("s", "2", {"q": "x"})
    (tmp_path / "a.jsonl").write_text(json.dumps({"request_key": key, "retrieved_at": "2024-01-01T00:00:00Z", "body": {"n": 1}}) + "\n" + json.dumps({"request_key": "b", "status": 500, "retrieved_at": "2024-01-02T00:00:00Z", "body": ""}) + "\n")
    spark.dataSource.register(replies.SavedReplies)
    saved = spark.read.format("saved_replies").option("paths", str(tmp_path / "a.jsonl")).load()
    asked = spark.createDataFrame([(key,), ("b",)], "request_key string")
    for ttl, hits in ((float("inf"), 1), (5.0, 0), (None, 0)):
        hit, miss = replies.lookup(asked, saved, F.lit("2024-02-01T00:00:00Z").cast("timestamp"), ttl)
        assert (hit.count(), miss.count()) == (hits, 2 - hits)
    assert [replies.wait_seconds(n) for n in (0, 3, 9)] == [1.0, 8.0, 30.0] and replies.wait_seconds(0, "7") == 7.0
    budget = replies.Budget(2, 100)
    assert [budget.reserve() for _ in range(3)] == [True, True, False]
    lines = spark.createDataFrame([("{'a': 1, 'b': ['x']}",), ("oops(",)], "value string")
    assert [tuple(r) for r in replies.python_literals(lines, "value", "a int, b array<string>").collect()] == [(1, ["x"]), (None, None)]
