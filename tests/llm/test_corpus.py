"""Corpus operators against plain versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evirank.llm import bpe, common, jaccard, media, nearest, packing, pages, pii, quality, substrings, toxicity
from evirank.llm.common import components, ship

from . import brute

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "A b", "é" * 300, "<|endoftext|> x<|endoftext|>", "x\x1cy \x85z", "tab\there\n\n  and  more ", "中文 🎉 ½ Ⅷ '", "İ. ǅ Σς", "w" * 5000, "k@ex.org +1 (017) 555-7713"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(25)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts = [*ODD, *base, *base[:5], *(f"{rng.choice(base)[:200]} {shared} {rng.choice(words)}" for _ in range(12))]
    for b in base[:6]:
        w = b.split()
        for k in rng.sample(range(len(w)), 2):
            w[k] = rng.choice(words)
        texts.append(" ".join(w))
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, node string, raw string, n bigint").repartition(3)


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_toxicity(spark):
    ship(spark)
    rng = random.Random(2)
    calm = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(calm) for _ in range(30)] + (["vilebad", "muslim"] if bad else [rng.choice(["muslim", "table"])])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    y = spark.createDataFrame([*labels, (900, 1, None)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    assert len(out) == 402 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i]["predicted"] == t for i, _, t in labels]) > 0.98 and out[900]["score"] == out[901]["score"]
    assert {r["score"] for r in toxicity.classify(d, y.limit(0)).collect()} == {0.5}
    bags = [toxicity.words_in(t) for _, t in rows]
    plain, fair = (toxicity.fit(bags, [t for _, _, t in labels], cf_weight=w) for w in (0.0, 1.0))
    texts = ["a muslim teacher sat at a table", "the muslim choir sang"]
    assert toxicity.counterfactual_gap(fair, texts) <= toxicity.counterfactual_gap(plain, texts) + 1e-9
    assert fair.score("a muslim teacher sat") < 0.5 < fair.score("w1 w2 vilebad w3")


def test_quality(spark):
    ship(spark)
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["tree", "House,", "river", "of", "the", "Walks."]) for _ in range(rng.randint(5, 80)))
    junk = lambda: " | ".join(rng.choice(["BUY!!", "X$$$", "nav"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, junk() if i % 5 == 0 else good()) for i in range(600)]
    d = spark.createDataFrame([*rows, (900, None)], "doc_id bigint, text string")
    y = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(d, y).collect()}
    assert len(out) == 601 and np.mean([out[i]["predicted"] == int(i % 5 != 0) for i, _ in rows]) > 0.97
    kept = {r["doc_id"] for r in quality.accepted(d.withColumn("__x", F.lit(1)), y).collect()}
    assert kept == {i for i, r in out.items() if r["score"] >= 0.7}
    assert {r["score"] for r in quality.classify(d, y.limit(0)).collect()} == {0.5}
    prior = quality.class_prior(np.random.default_rng(1).normal(2, 1, 4000), np.concatenate([np.random.default_rng(2).normal(2, 1, 3200), np.random.default_rng(3).normal(-4, 1, 800)]))
    assert 0.76 < prior < 0.86


def test_quality_statistics_cover_all_rows(spark, monkeypatch):
    """Beyond the rows that the network begins with, prior, scales and risk still see every row."""
    ship(spark)
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["tree", "House,", "river", "of", "the", "Walks."]) for _ in range(rng.randint(5, 80)))
    junk = lambda: " | ".join(rng.choice(["BUY!!", "X$$$", "nav"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(1200)] + [(5, "repeated row"), (5, "repeated row"), (None, "no id"), (7000, None), (7001, ""), (7002, "long " * 50_000)]
    d = spark.createDataFrame([(i, t, 0.1, [1.0]) for i, t in rows], "doc_id bigint, text string, score double, x array<double>").repartition(5)
    y = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 1200, 2)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "START", 150)
    measures = quality.measured(d)
    plain = np.array([quality.Shapes().measure(t or "") for _, t in rows])
    network, prior = quality.train(d, y, common.crc_of_id() % 4 == 2, measures)
    assert np.allclose(network.mean, plain.mean(0)) and np.allclose(network.scale, plain.std(0), atol=1e-5) and 0.6 < prior < 0.9
    half = measures.withColumn("half", F.lit(0))
    assert np.allclose(quality._summed(half, lambda x, h: x.sum(0)), plain.sum(0))
    out = quality.classify(d, y).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 1200]) > 0.95
    assert len({r["score"] for r in out if r["doc_id"] in (7000, 7001)}) == 1 and quality.classify(d.limit(0), y).count() == 0


@pytest.mark.parametrize("n", [4001, 6000, 7999, 8000, 30001])
def test_quality_reads_every_character(n):
    text = "".join("aB"[i % 2] for i in range(n))  # a stride of two would see one case only
    assert quality.Shapes().measure(text)[-1] == (n // 2) / n
    assert quality.Shapes().measure("a" * (n - 1) + "B")[-1] == 1 / n


def test_bpe_equals_the_library(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    out = {r["doc_id"]: r for r in bpe.digests(frame(spark, docs), BYTE).collect()}
    for i, text, *_ in docs:
        e = lib.encode(text or "", add_special_tokens=False)
        said = ",".join(map(str, e.ids))
        assert (out[i]["n_tokens"], out[i]["ids_sha256"]) == (len(e.ids), hashlib.sha256(said.encode()).hexdigest())
        assert out[i]["decoded_sha256"] == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    rng = random.Random(1)
    r, parts = bpe.Ranks(BYTE), ["a", "th", "é", "  ", " ", "\n", "\t", "'s", "12", "½", "中", "🎉", "<|endoftext|>", "!!", "x" * 70, "　", "\x1c"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert r.encode_batch(cases) == [",".join(map(str, e.ids)) for e in lib.encode_batch(cases, add_special_tokens=False)]
    ids = bpe.encode_column(frame(spark, docs), BYTE)
    back = {x["id"]: x["text"] for x in bpe.decode_column(ids, BYTE).collect()}
    assert back == {i: t or "" for i, t, *_ in docs}
    assert bpe.digests(frame(spark, docs).limit(0), BYTE).count() == 0


@pytest.mark.parametrize("equal", [False, True])
def test_nearest(spark, equal):
    ship(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    if equal:
        x[::3] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0, None] + [0.0] * 10), (1080, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash"))
    got = {}
    for r in nearest.search(df, k=5, sample=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 700, 20))
    full, hits = x.astype(float), []
    for q, found in got.items():
        score = (full * full[q]).sum(axis=1)
        others = np.array([i for i in range(700) if i != q])
        want = others[np.lexsort((others, -score[others]))[:5]]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(s - score[v]) < 1e-12 for v, s in found.values())
        listed = [found[k] for k in sorted(found)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0]))
        hits.append(len(set(want) & {v for v, _ in found.values()}) / 5)
    assert np.mean(hits) >= 0.9
    assert nearest.search(df.limit(0)).count() == 0
    assert nearest.search(df.where("vec_id < 3"), k=5, every=2).count() == 4


def test_nearest_meets_blocks_of_leaves(spark, monkeypatch):
    """A query meets each block and slice once, whatever the leaves it visits there, and blocks and slices change no result."""
    ship(spark)
    x = np.random.default_rng(5).normal(size=(700, 12))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    made, plain, results = [], nearest.top, []
    monkeypatch.setattr(nearest, "top", lambda found, k: made.append(found) or plain(found, k))
    for per in (4_000, 20):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", per)
        results.append(sorted(tuple(r) for r in nearest.search(df, k=5, sample=300).collect()))
        if per == 4_000:
            assert made[-1].count() <= 35 * 5
    assert results[0] == results[1] and len(results[0]) == 35 * 5


def test_media(spark, docs):
    out = {r["doc_id"]: r for r in media.digests(frame(spark, docs)).collect()}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and payload and out[i]["n_bytes"] == len(raw)
        assert out[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and out[i]["tail_crc32"] == zlib.crc32(payload[-64:])
        whole = media.mux(payload)
        assert (out[i]["media_bytes"], out[i]["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
    assert out[0]["feature"] == out[1]["feature"]
    made = media.mux_column(frame(spark, docs), "doc_id", "text")
    rows = {r["id"]: r for r in media.probe_column(made, "id", "media").collect()}
    assert rows[11]["codec"] == "raw " and rows[11]["samples"] == 5056 and [(k["bytes"], k["offset"] - rows[11]["keyframes"][0]["offset"]) for k in rows[11]["keyframes"]] == [(1, 0), (1, 4096)] and rows[11]["seconds"] == 5056 / 8000
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"\0\0\0\x09moov")), (3, bytearray(media.mux(bytes(64))[:-10]))], "id bigint, media binary")
    assert all(r["error"] and r["codec"] is None for r in media.probe_column(bad, "id", "media").collect())
    assert media.digests(frame(spark, docs).limit(0)).count() == 0


def test_media_of_other_writers():
    """Two tracks, chunks of several samples, 64-bit places, key samples inside chunks, and fragments."""
    u, box, full = (lambda *v: b"".join(x.to_bytes(4, "big") for x in v)), media.box, media.full

    def track(number, codec, sizes, per_chunk, places, keys, wide):
        stsz = u(0, len(sizes), *sizes)
        table = full(b"co64", u(len(places)), *(x.to_bytes(8, "big") for x in places)) if wide else full(b"stco", u(len(places), *places))
        stbl = [full(b"stsd", u(1), box(codec, bytes(8))), full(b"stts", u(1, len(sizes), 10)), full(b"stsc", u(1, 1, per_chunk, 1) if sizes else u(0)), full(b"stsz", stsz), table]
        if keys is not None:
            stbl.append(full(b"stss", u(len(keys), *keys)))
        mdia = box(b"mdia", full(b"mdhd", u(0, 0, 1000, 10 * len(sizes), 0)), box(b"minf", box(b"stbl", *stbl)))
        return box(b"trak", full(b"tkhd", u(0, 0, number, 0, 0)), mdia)

    a, b, c = [5, 6, 7, 8], [3, 3], [4, 9, 2]
    body = bytes(range(200))

    def build(at, frag_at):
        moov = box(b"moov", track(1, b"avc1", a, 2, [at, at + 30], [1, 4], True), track(2, b"mp4a", b, 2, [at + 60], None, False), track(3, b"hvc1", [], 0, [], None, False), box(b"mvex", full(b"trex", u(3, 1, 20, 0, 0x10000))))
        trun = full(b"trun", u(len(c)), (frag_at).to_bytes(4, "big", signed=True), u(0), u(*c), flags=0x205)
        return moov, box(b"moof", full(b"mfhd", u(1)), box(b"traf", full(b"tfhd", u(3)), trun))

    moov, moof = build(0, 0)
    start = len(moov) + len(moof) + 8
    moov, moof = build(start, len(moof) + 8 + 80)
    data = moov + moof + box(b"mdat", body)
    one, two, three = media.probe_all(data)
    assert (one["codec"], one["keys"], one["duration"]) == ("avc1", [(start, 5), (start + 37, 8)], 40) and media.stored(data, one) == body[:11] + body[30:45]
    assert two["keys"] == [(start + 60, 3), (start + 63, 3)] and two["samples"] == 2
    assert (three["codec"], three["samples"], three["keys"], three["duration"]) == ("hvc1", 3, [(start + 80, 4)], 60) and media.stored(data, three) == body[80:95]
    assert media.probe(data)["codec"] == "avc1"


def test_pii_base_spans(spark, docs):
    rng = random.Random(3)
    parts = ["a", "b.", "@", "x@y.z", ".", "1", "23", "255.", "256", "10.0.0.1", "4111 1111 1111 1111", " ", "-", "+1", "(", "é", "🎉", "\n", "+49 30 123456", "5500-0000-0000-0004", "%", "com", "00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [t for _, t, *_ in docs] + ["1 " * 3000 + "a@b.co"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    for r in pii.digests(df).collect():
        want = brute.base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in want.split(",")) for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.digests(df.limit(0)).count() == 0


def test_pii_terms_that_disclose(spark):
    ship(spark)
    rng = random.Random(6)
    common = ["about", "house", "river", "green", "walks"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(20))) for i in range(200)]
    rows += [(300 + i, f"{rng.choice(common)} {rng.choice(common)} {i} kingpin wrote from boss@corp.com about {rng.choice(common)}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit(1))
    out = {r["doc_id"]: r["spans"] for r in pii.digests(df).collect()}
    text = dict(rows)
    for i in range(300, 306):
        found = {text[i][int(a) : int(b)] for _, a, b in (s.split(":") for s in out[i].split(","))}
        assert "boss@corp.com" in found and "kingpin" in found and not found & set(common)
    assert not any(out[i] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("kingpin" not in clean[i] and "corp.com" not in clean[i] and "[EMAIL]" in clean[i] for i in range(300, 306)) and clean[0] == text[0]


def test_pii_rare_entities_and_copies(spark):
    """A text alone proves nothing, nor do its copies; other texts do."""
    ship(spark)
    common = ["about", "house", "river", "green", "walks"]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(common) for _ in range(20))) for i in range(200)]
    rows += [(300 + i, "green bystander a@solo.org house") for i in range(50)]  # one text, whatever its copies
    rows += [(400 + i, f"{i} godfather b@many.org river") for i in range(8)] + [(500 + i, "walks godfather house") for i in range(300)]  # 300 copies of one text
    rows += [(900 + i, f"{i} passer c@few.org river") for i in range(3)] + [(950 + i, f"{i} often d@other.org") for i in range(9)] + [(980 + i, f"often {i} walks") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[300] == "green bystander [EMAIL] house" and clean[900] == "0 passer [EMAIL] river" and clean[950] == "0 often [EMAIL]"
    assert all(clean[400 + i] == f"{i} [TERM] [EMAIL] river" for i in range(8)) and clean[0] == rows[0][1] and clean[500] == "walks godfather house"


def test_pii_terms_anywhere_in_a_text(spark):
    ship(spark)
    common = ["about", "house", "river", "green", "walks"]
    rng = random.Random(9)
    far = " ".join(rng.choice(common) for _ in range(60))  # over 100 characters to both sides
    rows = [(i, " ".join(rng.choice(common) for _ in range(20 + i % 7))) for i in range(400)]
    rows += [(500 + i, f"İİ Kingpin {i} {far} boss@corp.com {far} kingpin") for i in range(40)]
    rows += [(600, "walks kingpin house"), (601, None), (602, "river kingpins")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("kingpin" not in clean[500 + i].lower() and far in clean[500 + i] for i in range(40))
    assert clean[600] == "walks  house" and clean[601] is None and clean[602] == "river kingpins" and clean[0] == rows[0][1]


def test_pii_of_a_long_list(spark):
    """Every address of a list stands in one text; only their domain can be told by words, and only from other texts."""
    ship(spark)
    rows = [(0, " ".join(f"member{i} m{i}@club.org" for i in range(2000)))] + [(1 + i, f"treasurer {i} t{i}@club.org and river{i}") for i in range(9)] + [(50 + i, f"river{i} house and about") for i in range(9)]
    out = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0].count("email:") == 2000 and "term:" not in out[0] and all(out[1 + i].startswith("term:0:9,") and out[1 + i].count(":") == 4 for i in range(9)) and not out[50]


def test_redaction_of_spans_inside_spans(spark):
    ship(spark)
    address = "-".join(f"10.0.0.{i}" for i in range(12)) + "@host.com"
    rows = [(1, f"mail {address} now"), (2, f"{address} {address}"), (3, f"+1 (017) 555-7713, 4111 1111 1111 1111; {address}"), (None, f"mail {address} now"), (4, None), (5, "no values here"), (5, "")]
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], "doc_id bigint, text string, spans string, text_key string")
    out = pii.sanitised(df).collect()
    assert all(r.asDict().keys() == {"doc_id", "text", "spans", "text_key"} for r in out) and len(out) == len(rows)
    hidden = [r["text"] for r in out if r["doc_id"] in (None, 1, 2, 3)]
    assert len(hidden) == 4 and not any(x in t for t in hidden for x in ("10.0", "host", "4111", "555")) and all("[EMAIL]" in t for t in hidden)
    assert sorted(str(r["text"]) for r in out if r["doc_id"] in (4, 5)) == ["", "None", "no values here"]


def test_pii_terms_on_the_tables(spark):
    """Terms take little of the texts that hold values, base spans stay, and terms planted in them are found."""
    ship(spark)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plant = F.concat(F.lit("Zorblax "), F.col("text"), F.lit(" wrote zorblax@zorbcorp.example, "), F.col("doc_id").cast("string"))
    rows = documents.withColumn("text", F.when(F.col("doc_id") % 100 == 7, plant).otherwise(F.col("text")))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    out = pii.digests(rows).collect()
    taken = total = 0
    for r in out:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = ",".join(":".join(s) for s in spans if s[0] in pii.KINDS)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
        if base:
            taken += sum(int(e) - int(a) for k, a, e in spans if k not in pii.KINDS)
            total += len(texts[r["doc_id"]])
        if r["doc_id"] % 100 == 7:
            assert ["term", "0", "7"] in spans
    assert len(out) == len(texts) and total and taken < 0.05 * total


def test_pages(spark):
    ship(spark)
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body class="has-sidebar"><header>Site name</header><nav><ul><li>Home</li></ul></nav><div id="cookie-notice"><p>We use cookies, accept them all please, and accept again.</p></div>'
        "<article><h1>A &amp; B</h1><p>First   paragraph<br>goes&nbsp;on &#8211; long enough to be seen as the text of a page, no doubt.<p>Short.</p><div class=ad>Buy</div><form>Name <input></form><p>Last one, it is a little longer.</p></article>"
        '<section class="comments"><p>Nice post, I liked it very much, thanks for writing it up for all of us.</p></section><aside>More to read</aside><footer>&copy; 2024</footer></body>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just text"), (5, "u", "<p class='" * 3000), (6, "u", "<div><p>Plain page whose text is long enough to surge above the limit.</p><p>Tail.</p></div>"), (7, "u", "<script>" * 50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in pages.extract_pages(df).collect()}
    assert out[1]["text"] == "A & B\nFirst paragraph goes on – long enough to be seen as the text of a page, no doubt.\nShort.\nLast one, it is a little longer."
    assert [out[i]["text"] for i in (2, 3, 4, 7)] == ["", "", "just text", ""] and out[6]["text"].endswith("\nTail.")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values()) and pages.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "extra",
    [
        "<aside><article><p>Teaser of another page.</p></article></aside>", "<div class=comments><article><p>Nice one, I liked it.</p></article></div>", "<!-- <main> -->", '<script>"<article>"</script>',
        "<article class=comment><p>Nice one, I liked it very much, and I read it more than once, which is rare for me to do with any page.</p></article>",
    ],
)
def test_pages_with_marks_that_are_not_the_article(extra):
    page = "<body><div>" + "".join(f"<p>Paragraph {i} of the article stands in a plain division and is long enough.</p>" for i in range(5)) + f"</div>{extra}</body>"
    assert pages.extract(page) == "\n".join(f"Paragraph {i} of the article stands in a plain division and is long enough." for i in range(5))


def test_pages_keep_sections_of_the_article():
    page = '<body><nav><a>x</a></nav><article><h1>T</h1><p class="search-method">How we searched.</p><div id="related-work"><p>What others did.</p></div><div class="ad-box">Buy</div><div class="cookie-notice">Eat</div><p>End.</p></article></body>'
    assert pages.extract(page) == "T\nHow we searched.\nWhat others did.\nEnd."


def hub(rng):
    """A text, many copies that each link to it but hardly to one another, and texts that share a passage only."""
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    out = [base]
    for _ in range(40):
        x = list(base)
        for k in rng.sample(range(150), rng.randint(1, 7)):
            x[k] = rng.choice(words)
        out.append(x)
    passage = [rng.choice(words) for _ in range(40)]
    out += [[rng.choice(words) for _ in range(rng.randint(5, 60))] + passage for _ in range(30)]
    out += [[rng.choice(words[:4]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "SHARE", 2)
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 24)
        monkeypatch.setattr(common, "HOT", 3)
    texts = [t for _, t, *_ in docs] + hub(random.Random(8))
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame(spark, [*rows, rows[20]])).collect()}
    assert got == brute.shingle_components([(i, t) for i, t, *_ in rows])


def test_jaccard_ids_that_are_null_or_repeat(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a, "x", None, 1), (5, a + " more", "x", None, 1), (5, b, "x", None, 1), (7, b.upper(), "x", None, 1), (None, None, "x", None, 1)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 36, 5), (5, 37, 5), (5, 36, 5), (7, 36, 5), (None, 0, None)], key=str)


def test_jaccard_levels_of_all_tasks(spark, docs):
    """The sketch is that of all texts, in however many tasks and pieces it was counted."""
    texts = [t for _, t, *_ in docs] + hub(random.Random(8))
    frames = spark.createDataFrame([(t,) for t in texts], "text string").repartition(jaccard.SLICES + 5)
    cells = 2 * jaccard.PIECE_CELLS
    total = np.zeros(cells, np.int64)
    for t in texts:
        np.add.at(total, (jaccard.all_shingles((t or "").encode()) & np.uint64(cells - 1)).astype(np.int64), 1)
    limit = total.mean() + 8 * np.sqrt(total.mean() + 1) + 24
    got = np.frombuffer(zlib.decompress(jaccard.levels_of(frames, cells=cells)), np.uint8)
    assert np.array_equal(got, np.where(total > limit, 1 + np.floor(np.log2(np.maximum(total / limit, 1))), 0)) and got.any()
    assert not np.frombuffer(zlib.decompress(jaccard.levels_of(frames.limit(0), cells=cells)), np.uint8).any()


def brute_pairs(bucket, node, n, at, component, points):
    out = set()
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            if bucket[i] == bucket[j] and component[i] != component[j] and 1 + min(n[i] - at[i] - 1, n[j] - at[j] - 1) >= jaccard.needed(n[i], n[j]):
                if np.minimum(points[i], points[j]).sum() >= jaccard.needed(n[i], n[j]) and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]):
                    out.add((min(node[i], node[j]), max(node[i], node[j])))
    return out


def test_jaccard_trees(spark, docs):
    assert jaccard.link_components(frame(spark, docs).limit(0)).count() == 0
    assert np.array_equal(jaccard.word_hashes(b"One two"), jaccard.word_hashes(b" oNE\x0btwo ")) and len(set(jaccard.word_hashes("é e ee eé".encode()).tolist())) == 4
    rng = np.random.default_rng(2)
    base = rng.integers(0, 400, (12, jaccard.TREE_WIDTH)) * (rng.random((12, jaccard.TREE_WIDTH)) < 0.3)
    points = np.maximum(0, base[rng.integers(0, 12, 600)] + rng.integers(-9, 9, (600, jaccard.TREE_WIDTH))) + rng.integers(0, 3, (600, jaccard.TREE_WIDTH))
    n, bucket, node = points.sum(axis=1), rng.integers(0, 5, 600), np.arange(600)
    order = np.lexsort((node, n, bucket))
    points, n, bucket, node = points[order], n[order], bucket[order], node[order]
    at, component = rng.integers(0, 30, 600), rng.integers(0, 200, 600)
    cells = [p.astype(np.uint8 if p.max() < 256 else "<u4").tobytes() for p in points]
    rows = {"bucket": bucket, "node": node, "n": n, "at": at, "component": component, "m": np.full(600, 120), "own": node % 2, "cross": np.zeros(600, bool)}
    stats: dict = {}
    got = {tuple(x) for x in jaccard.tree_pairs(rows, cells, False, stats=stats).tolist()}
    assert got == brute_pairs(bucket, node, n, at, component, points) and len(got) > 100 and stats["levels"] == 3
    cross = {tuple(x) for x in jaccard.tree_pairs(rows | {"cross": np.ones(600, bool)}, cells, False).tolist()}
    assert cross == {p for p in got if (p[0] - p[1]) % 2}
    some = {tuple(x) for x in jaccard.tree_pairs(rows | {"m": np.full(600, 1000)}, cells, True).tolist()}
    assert some < got
    others = {tuple(x) for x in jaccard.tree_pairs(rows | {"m": np.full(600, 1000)}, cells, False, rest=True).tolist()}
    assert others == got - some  # what a share leaves out is what the last pass tries
    h = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert np.frombuffer(jaccard.cells_of(h), np.uint8).sum() == 500 and jaccard.matrix_of([jaccard.cells_of(h)]).sum() == 500


def test_jaccard_shares_part_all_pairs():
    """The first share, the larger one of large buckets and the rest are disjoint and together all pairs."""
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(300)]
    rows = {"bucket": np.zeros(300, np.int64), "node": np.arange(300), "n": np.full(300, 40), "at": np.zeros(300, np.int64), "component": np.arange(300), "m": np.full(300, 300), "own": np.zeros(300, np.int64), "cross": np.zeros(300, bool)}
    cells, wider = [jaccard.cells_of(h) for h in sets], jaccard.WIDER
    pairs = lambda **k: {tuple(x) for x in jaccard.tree_pairs(rows, cells, percent=10, **k).tolist()}
    every, first, second, last = pairs(share=False), pairs(share=True), pairs(share=True, wider=wider), pairs(share=False, rest=True, wider=wider)
    assert first | second | last == every and len(first) + len(second) + len(last) == len(every)
    assert 2 * len(first) < len(second) < len(last)
    rows["m"] = np.full(300, 2 * wider)  # too small a bucket for a larger share
    assert not pairs(share=True, wider=wider) and pairs(share=False, rest=True, wider=wider) == every - pairs(share=True)


def test_jaccard_trees_are_entered_on_the_tables(spark, monkeypatch):
    """All candidates but the stars come out of trees, and on the tables some of these have inner boxes."""
    seen = []
    plain = jaccard.tree_candidates
    monkeypatch.setattr(jaccard, "tree_candidates", lambda sized, *a: seen.append((sized.agg(F.max("m")).first()[0] or 0, sized.count())) or plain(sized, *a))
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    jaccard.link_components(documents).count()
    print(seen)
    assert len(seen) == 3 and seen[0][1] > 0 and max(m for m, _ in seen) > jaccard.FANOUT


def test_substrings(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    monkeypatch.setattr(common, "HOT", 10)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdé ") for _ in range(260))
    extra = [f"{''.join(rng.choice('xyz') for _ in range(rng.randint(0, 90)))}{passage[rng.randint(0, 30) :]}{rng.random()}" for _ in range(12)] + ["ab" * 300, "x" * 199, "x" * 200, "x" * 201, "ü" * 150]
    extra += [f"{'q' * rng.randint(0, 120)}{passage[20:]}{passage[: rng.randint(0, 200)]}" for _ in range(6)]
    rows = [(i, t, "x", None, 1) for i, t in enumerate([t for _, t, *_ in docs] + extra)]
    df = frame(spark, rows)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.digests(df).collect())
    want = sorted(brute.repeats([(i, t) for i, t, *_ in rows]))
    assert got == want and sum(w[2] for w in want) > 1000
    clean = substrings.deduplicated(df).collect()
    left = {r["doc_id"]: len((r["text"] or "").encode()) for r in clean}
    assert len(clean) == len(rows) and all(n - gone - 6 <= left[i] <= n - gone for i, n, gone, *_ in want)
    assert substrings.digests(df.limit(0)).count() == 0


def test_substrings_of_an_anchor_with_many_contexts(spark, monkeypatch):
    """Cells are split until contexts fit, and blocks of what cannot be split are paired."""
    monkeypatch.setattr(substrings, "BLOCK_CONTEXTS", 4)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common_part, long_part = word(34), word(66)
    texts = [word(40) + common_part + word(40) for _ in range(8)] + [word(rng.randint(0, 30)) + long_part + word(rng.randint(0, 30)) for _ in range(7)] + [word(20) + common_part + long_part for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.digests(df, length=40, k=8).collect())
    assert got == sorted(brute.repeats(list(enumerate(texts)), 40)) and sum(r[2] for r in got) > 400


def test_substrings_give_one_run_a_context(spark, monkeypatch):
    """Contexts that share strings with several others still give one row each, and those of a large group meet no other ones."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = word(60)
    texts = [word(20) + passage[: (cut := rng.randint(10, 50))] + word(1) + passage[cut + 1 :] + word(20) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(brute.repeats(list(enumerate(texts)), 40))
    made, plain = [], substrings._indexed
    monkeypatch.setattr(substrings, "_indexed", lambda c, *a: made.append((c.count(), found := plain(c, *a))) or found)
    for most in (10_000, 4):
        monkeypatch.setattr(substrings, "BLOCK_CONTEXTS", most)
        made.clear()
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.digests(df, length=40, k=8).collect())
        assert got == want and sum(r[2] for r in got) > 1000
        n, found = made[0]
        assert 0 < found.count() == found.select("anchor", "context").distinct().count() <= n


def test_substrings_ids_that_are_null_or_repeat(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, c = word(500), word(700), word(300)
    rows = [(1, a), (2, word(50) + a[100:400] + word(50)), (1, b), (None, c), (None, c), (3, None), (3, ""), (4, word(250)), (5, "short"), (5, "short")]
    df = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id bigint, text string, runs string, text_key int")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.digests(df).collect()), key=str)
    assert got == sorted(brute.repeats(rows), key=str) and sum(r[2] for r in got) == 300 + 300 + 600
    clean = substrings.deduplicated(df).collect()
    assert all(r.asDict().keys() == {"doc_id", "text", "runs", "text_key"} for r in clean)
    assert sorted(r["text"] for r in clean if r["doc_id"] == 1) == sorted([a[:100] + a[400:], b])


def test_run_length_index():
    """Runs and samples alone give the statistics, and copies with few changes need few runs."""
    rng = random.Random(1)
    base = [rng.randrange(256) for _ in range(368)]
    rows = np.array([base] * 500, np.uint16)
    for i in range(500):
        rows[i, rng.randrange(368)] = rng.randrange(256)
    index = substrings.RunLengthIndex(rows, np.zeros(500, int))
    assert index.runs < rows.size / 100 and "rows" not in vars(index)
    mark = index.stream(200)
    for i in rng.sample(range(500), 20):
        for column in rng.sample(range(169), 20):
            assert mark[i, column] == ((rows[:, column : column + 200] == rows[i, column : column + 200]).all(axis=1).sum() > 1)


def test_packing(spark, docs):
    lib = Tokenizer.from_file(WORD)
    rows = [*docs, (500, "word! " * 9000, "x", None, 1), docs[20]]
    out = packing.pack_documents(frame(spark, rows), WORD, per_part=20).collect()
    want = []
    for i, text, *_ in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins = brute.by_sequence(out)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    bound = packing.lower_bound(np.array([w[3] for w in want]))
    assert bound <= len(bins) <= bound + 1
    assert packing.pack_documents(frame(spark, docs).limit(0), WORD).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.sort(rng.integers(1, 30, rng.integers(1, 40)))[::-1]
        bins_, offsets, fill = packing.best_fit(lengths, 30)
        assert fill.max() <= 30 and fill.sum() == lengths.sum() and packing.lower_bound(lengths, 30) <= len(fill) and offsets.min() == 0


def test_packing_of_the_pipeline_gives_its_memory_back(spark, monkeypatch):
    import corpus_pipeline

    df, seen = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *rest: seen.append(f) or plain(self, f, *rest))
    assert corpus_pipeline.packed(spark, df, "").count() == 1
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": [" ".join(f"w{k}q{i}" for i in range(15_000)) for k in range(8)]})
    before = held()
    assert sum(out.num_rows for out in seen[0](iter([batch]))) > 8
    assert held() - before < 30_000  # kB; the tokenizer and its words take more


def test_one_of_each_group(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (3, a + " more"), (3, b), (9, b), (9, b), (None, " ".join(f"c{i}" for i in range(9))), (4, None), (4, ""), (5, "x y"), (5, "x y")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, text_key string, stays_id int")
    out = corpus_pipeline.one_of_each_group(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([rows[1], rows[2], rows[5], (4, None), (4, ""), (5, "x y")], key=str)


def test_registered_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert json.dumps(entry.oracle_sql())
