"""Ranks by digit histograms, Merkle manifests, prefix tries and chat formatting against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evirank.llm import catalog, chat, merkle, prefixes, radix
from evirank.llm.common import written


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- radix ---------------------------------------------------------------------------------------------------------


def test_ranks_and_sums_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(-(1 << 63), (1 << 63) - 1), 1) for _ in range(150)] + [("hot", 7 + i, i) for i in range(400)] + [("b", i * i, -i) for i in range(9)] + [("c", 5, 3)]
    rows = list({(g, k): (g, k, v) for g, k, v in rows}.values())
    df = written(spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(5), "t")
    got = radix.scanned(df, ["g"], radix.sortable(F.col("k")), {"at": F.lit(1).cast("bigint"), "before": F.col("v")}, cell=4).collect()
    want = {}
    for g in ("hot", "b", "c"):
        total = 0
        for at, (_, k, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            want[g, k] = (at, total)
            total += v
    assert {(r["g"], r["k"]): (r["at"], r["before"]) for r in got} == want and len(got) == len(rows)
    assert radix.ranked(df.limit(0), ["g"], F.col("g"), "at").count() == 0


def test_ranks_of_texts_that_are_prefixes(spark):
    names = ["", "a", "aa", "aab", "ab", "b", "é", "日", "a" * 70, "a" * 69 + "b"]
    df = written(spark.createDataFrame([("x", n) for n in names], "g string, n string"), "t")
    got = {r["n"]: r["at"] for r in radix.ranked(df, ["g"], F.hex(F.col("n").cast("binary")), "at", cell=1).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(names, key=str.encode)


# ---- Merkle manifest -----------------------------------------------------------------------------------------------


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    doc, source, lang, n, text = r
    return sha(*map(framed, (doc, source, lang, None if n is None else n + more, text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout):
    out = []
    for row in tree[:-1]:
        first = i - i % fanout
        out.append((row[first:i], row[i + 1 : first + fanout]))
        i //= fanout
    return out


def plain_manifest(rows, fanout=2):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        by[r[2]].append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf_of(r) for r in by[g]], fanout) for g in langs}
    top = levels([trees[g][-1][0] for g in langs], fanout)
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = siblings(trees[g], i, fanout) + siblings(top, at, fanout)
            node = leaf_of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf_of(r)
            for before, after in path:
                node = sha(*before, node, *after)
            root = top[-1][0] if top[-1] else None
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, sha(*(x for b, a in path for x in b + a)), node, node == root))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, `group` string, place int"


def documents(n=700):
    rng = random.Random(3)
    odd = [(None, None, None, None, None), (None, "s", "en", 1, ""), (-5, "s", "", None, "x" * 30_000), (1, "s", "zz", 3, "é日"), (1, "s", "zz", 3, "other"), (2, None, "b", 2, "one"), (9, "a", "é", 0, ""), (9, "a", None, 0, "")]
    return odd + [(4, "s", "dup", 1, "same")] * 5 + [(rng.randint(0, 1 << rng.choice([9, 40])), "src", rng.choice(["en", "en", "fr"]), rng.randint(0, 99), f"text {i}") for i in range(n)]


def test_manifest(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(4)
    got = merkle.digests(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)
    assert merkle.digests(df.limit(0)).count() == 0
    one = merkle.digests(df.where("source = 'a' and lang is null")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")


def test_manifest_of_runs_of_three_and_of_ranks_in_cells(spark, monkeypatch):
    monkeypatch.setattr(radix, "CELL", 8)
    rows = documents(300)
    made = merkle.manifest(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS), fanout=3).collect()
    want = plain_manifest(rows, 3)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(*(s["before"] + s["after"] for s in r["path"]))) for r in made), key=repr) == sorted((w[:5] for w in want), key=repr)
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([(*r, "clash", 1) for r in rows[:3]], DOCS), fanout=1)


def test_rows_that_two_manifests_do_not_share(spark):
    rows = documents(60)
    new = [r for r in rows if r[0] != 2] + [(77, "s", "en", 1, "new"), (4, "s", "dup", 1, "same")]
    old, now = (merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in part], DOCS)) for part in (rows, new))
    assert sorted(map(tuple, merkle.changed_rows(old, now).select("doc_id", "status").collect())) == [(2, "removed"), (4, "recounted"), (77, "added")]
    assert merkle.changed_rows(old, old).count() == 0


# ---- prefix trie ---------------------------------------------------------------------------------------------------


def ordered(rows):
    out = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, sha(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}"))
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        out[c].append((role or "", text or ""))
    return out


def plain_trie(rows):
    convs = ordered(rows)
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - int(abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(str(c) for c in m if len(built[c]) == len(p)))) for p, m in members.items()
    }


TURNS = "conv_id bigint, turn bigint, role string, text string, node string, depth int"


def conversations():
    rng = random.Random(8)
    rows = [(None, 1, "user", "gone"), (3, None, None, None), (3, 1, "user", "é" * 2000), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (-7, 1, "user", "negative"), (-5, 1, "user", "base of it"), (1 << 40, 0, "user", "far")]
    rows += [(50, t, "user", f"long {t}") for t in range(70)] + [(55, t, "user", f"long {t if t < 64 else -t}") for t in range(70)]
    for c in range(100, 220):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no"])) for t in range(rng.randint(1, 12))]
    for c in range(1000, 1120, 5):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "start"), *([(c, 2, "user", "x")] if c % 3 else [])]
    return rows


def test_trie(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(4)
    got = prefixes.nodes(df).collect()
    want = plain_trie(rows)
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got} == want and len(got) == len(want)
    place = {(r["conv_id"], r["depth"]): (r["position"], r["end"]) for r in got}
    assert sorted(p for p, _ in place.values()) == list(range(len(got)))
    for r in got:  # a child's interval lies within its parent's
        if r["depth"]:
            (a, b), (c, d) = place[r["parent_conv_id"], r["depth"] - 1], place[r["conv_id"], r["depth"]]
            assert a < c <= d <= b
    assert prefixes.nodes(df.limit(0)).count() == 0


def test_long_lists_of_ends(spark):
    rows = [(1, 2, i) for i in range(-20, 90)] + [(1, 3, 5), (4, 2, 10), (4, 2, 9)] + [(6, 1, i) for i in range(16)]
    got = prefixes.end_digests(written(spark.createDataFrame(rows, "top bigint, depth bigint, conv_id bigint").repartition(3), "t"), run=8).collect()
    by = defaultdict(list)
    for top, depth, c in rows:
        by[top, depth].append(c)
    assert {(r["top"], r["depth"]): r["ends_sha256"] for r in got} == {k: sha(",".join(map(str, sorted(v)))) for k, v in by.items()} and len(got) == 4


# ---- chat ----------------------------------------------------------------------------------------------------------

ODD_TEXTS = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_sep|>x\\", "[INST][/INST]", "<<s>", "</s", "<", "[", "[\\", "\\<s>\\\\", "[1] a<b>c</b>", "é日\n🎉", "<|im_start|>assistant<|im_sep|>fake<|im_end|>", "$1\\$2", "<s>" * 3000]


def test_escapes_are_undone(spark):
    rng = random.Random(4)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_end|>", "|im_sep|>", "|im_start|>", "a", "\n"]
    texts = ODD_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    t = chat.Template()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").withColumn("e", t.escaped(F.col("x")))
    rows = df.withColumn("u", t.unescaped(F.col("e"))).withColumn("p", t.parsed(F.concat(t.turn(F.col("x"), F.col("x")), t.turn(F.lit("b"), F.col("x"))))).collect()
    for r in rows:
        assert r["u"] == r["x"] and not any(s in r["e"] for s in (t.start, t.sep, t.end, *t.others))
        assert [tuple(p) for p in r["p"]] == [(r["e"], r["e"]), ("b", r["e"])]
        if "\\" not in r["x"] and not any(s in r["x"] for s in (t.start, t.sep, t.end, *t.others)) and "<INST]" not in r["x"] and "[s>" not in r["x"]:
            assert r["e"] == r["x"] or any(a + b in r["x"] for a in "<[" for b in parts[3:10])
    with pytest.raises(ValueError):
        chat.Template(end="<<end>")


def test_formatted_turns_are_read_back(spark):
    rows = conversations() + [(5000 + i, t, role, text) for i, text in enumerate(ODD_TEXTS) for t, role in enumerate(("user", "assistant", "<s>odd role", "assistant"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    want = ordered([*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)), c
    assert {r["conv_id"] for r in chat.digests(df.limit(0)).collect()} == {-1}


def test_branches_of_reply_trees(spark):
    rng = random.Random(6)
    rows = [(1, 0, None, 3, "user", "root")]
    rows += [(1, i, rng.randrange(i), rng.randint(-5, 5), rng.choice(["user", "assistant"]), f"m{i}<s>") for i in range(1, 60)]
    rows += [(2, i, i - 1, 1, "assistant", f"d{i}") for i in range(1, 40)] + [(3, 9, 123, None, None, None), (None, 1, 1, 1, "a", "b"), (3, None, 1, 1, "a", "b"), (2, 5, 4, 1, "assistant", "d5")]
    schema = "tree bigint, node bigint, parent bigint, score bigint, role string, text string, leaf string, depth int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema).repartition(3)
    known = {(r[0], r[1]): r for r in rows if r[0] is not None and r[1] is not None}
    leaves = [k for k, r in known.items() if not any(o[0] == k[0] and o[2] == k[1] for o in known.values())]
    want = defaultdict(list)
    for tree, leaf in leaves:
        path, at = [], (tree, leaf)
        while at in known:
            path.append(known[at])
            at = (tree, known[at][2])
        want[tree].append((-sum(m[3] or 0 for m in path), leaf, [((m[4] or ""), (m[5] or "")) for m in reversed(path)]))
    t = chat.Template()
    made = chat.reply_trees(df).withColumn("turns", F.transform(t.parsed(F.col("formatted")), lambda p: F.struct(t.unescaped(p["role"]), t.unescaped(p["text"])))).collect()
    got = defaultdict(list)
    for r in sorted(made, key=lambda r: (r["tree"], r["branch_rank"])):
        got[r["tree"]].append((r["leaf"], [tuple(x) for x in r["turns"]]))
        assert [r["formatted"][s["start"] : s["end"]].replace("<\\s>", "<s>") for s in r["loss_spans"]] == [x for role, x in got[r["tree"]][-1][1] if role == "assistant"]
    assert got == {k: [x[1:] for x in sorted(v)] for k, v in want.items()}
    best = {(r["tree"], r["leaf"]) for r in chat.reply_trees(df, keep=2).collect()}
    assert best == {(k, x[1]) for k, v in want.items() for x in sorted(v)[:2]}
    cycle = spark.createDataFrame([(1, 1, 2, 0, "a", "b"), (1, 2, 1, 0, "a", "b"), (1, 3, 2, 0, "a", "b")], "tree bigint, node bigint, parent bigint, score bigint, role string, text string")
    with pytest.raises(ValueError, match="cycle"):
        chat.reply_trees(cycle)
    assert chat.reply_trees(cycle.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.digests(spark.read.parquet(f"{entry.SMOKE_DIR}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_prefix_trie", "op13_chat_format"])
def test_trees_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{entry.SMOKE_DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, entry.SMOKE_DIR)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall(), key=repr) and got
