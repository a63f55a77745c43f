"""Prefix trie of conversations by preorder intervals: what a cache of shared beginnings would save.

A beginning of d turns is named by 128 bits of sums of hashes of (place, turn) over its turns, so that names come from prefix sums (radix) and no
conversation need be gathered. Of each node's children the one with most members is heavy, ties going to the smallest member; all others are light, and at most
log2(members) light ones lie above any node. A node's key is the depth where each light one leaves its parent's chain with its smallest member, and then
the node's own depth: bytewise this is a preorder in which a node stands before its light children and these before the heavy one. Nodes are ranked by the key,
and a chain's last node is the end of the subtree of every node on that chain. With prefix sums of childless nodes and of saved tokens in that order,
leaves and savings of a subtree are differences between its end and its start.

Defined results: null roles and texts are empty; a null turn comes first, equal turns are ordered by a hash of role and text; rows without a
conv_id take no part; the remainder of a negative conv_id has its sign; turnless conversations are members of the root; an empty table gives no rows;
extra columns take no part, whatever their names. Two beginnings of equal names would be taken for one, which 128 bits make improbable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import joined, ship, written
from evirank.llm.radix import ranked, scanned, sortable
from evirank.llm.turns import placed, said

#: Ids of one node that are joined to one string at most; strings of a node with more ids are hashed in order.
RUN = 4096


def _named(depth: Column, one: Column, two: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth.cast("bigint"), one.cast("decimal(38,0)"), two.cast("decimal(38,0)")) for seed in (3, 4)]


def spliced(conversations: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation begins as the first of its family does: (conv_id, depth, t1, t2, n_bytes) of rebuilt turns and (conv_id, length).

    Of h = crc32(conv_id) % heads turns in front, those that the conversation conv_id - conv_id % family has take the place of its own.
    """
    turn = F.concat(F.octet_length(said("role")).cast("string"), F.lit(":"), said("role"), said("text"))
    turns = written(placed(conversations, {"t1": F.xxhash64(F.lit(1), turn), "t2": F.xxhash64(F.lit(2), turn), "n_bytes": F.octet_length(said("text")).cast("bigint")}), "turns-placed")
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    first = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = written(convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "spliced")
    begun = convs.where("taken > 0").select("base", "conv_id", "taken").join(turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base"), "base").where("pos <= taken")
    kept = joined(turns, convs.where("own > h").select("conv_id", "own", "h", "taken"), ["conv_id"], "own").where("pos > h")
    columns = ["conv_id", "t1", "t2", "n_bytes"]
    rows = begun.select(*columns, F.col("pos").alias("depth")).unionByName(kept.select(*columns, (F.col("pos") - F.col("h") + F.col("taken")).alias("depth")))
    return written(rows, "spliced-turns"), convs.select("conv_id", "length")


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_bytes, position, end, n_leaves, saved_tokens), and for each conversation's turns
    (conv_id, depth, top) the smallest member of the node reached. turns and convs are tables in storage, depths dense from 1."""
    spark = turns.sparkSession
    added = {f"s{i}": F.xxhash64(F.lit(i), "depth", "t1", "t2").cast("decimal(20,0)") for i in (1, 2)}
    sums = scanned(turns, ["conv_id"], sortable(F.col("depth")), added)
    k = _named(F.col("depth"), *(F.col(n) + c for n, c in added.items()))
    p = _named(F.col("depth") - 1, F.col("s1"), F.col("s2"))
    rows = written(sums.select("conv_id", "depth", "n_bytes", k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2")), "beginnings")
    nodes = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    zero = F.lit(0)
    none = F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.cast("bigint").alias("depth"), *(c.alias(n) for c, n in zip(_named(zero, zero, zero), ("k1", "k2"), strict=True)), "conv_id", "n_convs", zero.cast("bigint").alias("n_bytes"), none.alias("p1"), none.alias("p2"))
    nodes = written(nodes.select(F.col("depth").cast("bigint").alias("depth"), "k1", "k2", "conv_id", "n_convs", "n_bytes", "p1", "p2").unionByName(root), "nodes")
    first = nodes.where("depth = 0").select("conv_id").first()

    best = F.max_by(F.struct("k1", "k2"), F.struct("n_convs", F.bitwise_not("conv_id")))
    children = written(nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), best.alias("heavy")), "children")
    counted = nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), ["k1", "k2"], "left")
    heavy = children.select("heavy.k1", "heavy.k2", F.lit(True).alias("heavy"))
    nodes = counted.join(heavy, ["k1", "k2"], "left").withColumn("light", F.col("heavy").isNull() & (F.col("depth") > 0)).drop("heavy", "p1", "p2").fillna(0, ["n_children"])
    nodes = written(nodes, "counted")

    reached = joined(rows.select("conv_id", "depth", "k1", "k2"), nodes.where("depth > 0").select("k1", "k2", F.col("conv_id").alias("top"), "light", "n_convs"), ["k1", "k2"], "n_convs")
    reached = written(reached.select("conv_id", "depth", "top", "light"), "reached")
    lights = reached.where("light").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "top"))).alias("lights"))  # at most log2 of the members of the root
    own = written(nodes.groupBy("conv_id").agg(F.count("*").alias("n_own")).join(lights, "conv_id", "left"), "lights")
    deep = lambda c: F.lpad(F.hex(c.cast("bigint")), 10, "0")
    left = F.transform(F.filter(F.coalesce("lights", F.array().cast("array<struct<depth:bigint,top:bigint>>")), lambda e: e["depth"] <= F.col("depth")), lambda e: F.concat(deep(e["depth"] - 1), F.lit("1"), sortable(e["top"])))
    keyed = joined(nodes, own, ["conv_id"], "n_own").withColumn("chain", F.array_join(left, ""))
    parents = reached.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent_conv_id"))
    keyed = keyed.join(parents, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, first[0] if first else None).otherwise(F.col("parent_conv_id")).cast("bigint"))
    keyed = written(keyed.select(F.lit(0).alias("all"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_bytes", "chain"), "keyed")

    leaf, saved = (F.col("n_children") == 0).cast("bigint"), ((F.col("n_convs") - 1) * F.col("n_bytes")).cast("decimal(38,0)")
    order = scanned(keyed, ["all"], F.concat("chain", deep(F.col("depth")), F.lit("0")), {"position": F.lit(1).cast("bigint"), "leaves_before": leaf, "saved_before": saved})
    order = written(order, "preorder")
    ends = order.groupBy("chain").agg(F.max("position").alias("end"), F.max(F.col("leaves_before") + leaf).alias("leaves_to"), F.max(F.col("saved_before") + saved).alias("saved_to"), F.count("*").alias("n_chain"))
    out = joined(order, written(ends, "ends"), ["chain"], "n_chain")
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_bytes", "position", "end", (F.col("leaves_to") - F.col("leaves_before")).alias("n_leaves"), (F.col("saved_to") - F.col("saved_before")).cast("bigint").alias("saved_tokens"))
    return out, reached.select("conv_id", "depth", "top")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of strings that come in order, one node after the other; only the state of one digest is held."""
    at, state = None, None
    said = lambda: pa.RecordBatch.from_pydict({"top": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for top, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("top", "depth", "ids")), strict=True):
            if at != (top, depth):
                if at is not None:
                    yield said()
                at, state = (top, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if at is not None:
        yield said()


def end_digests(ends: DataFrame, run: int = RUN) -> DataFrame:
    """(top, depth, ends_sha256) of (top, depth, conv_id), a table in storage: SHA-256 of the ascending ids joined by commas."""
    ship(ends.sparkSession)
    runs = ranked(ends, ["top", "depth"], sortable(F.col("conv_id")), "at").withColumn("run", F.floor(F.col("at") / run).cast("bigint"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = written(runs.groupBy("top", "depth", "run").agg(ids.alias("ids")), "end-runs")
    several = runs.where("run = 1").select("top", "depth")
    alone = runs.join(several, ["top", "depth"], "left_anti").select("top", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    if not several.head(1):
        return alone
    long = runs.join(several, ["top", "depth"], "left_semi").repartition("top", "depth").sortWithinPartitions("top", "depth", "run")
    return alone.unionByName(long.select("top", "depth", "ids").mapInArrow(_streamed, "top bigint, depth bigint, ends_sha256 string"))


def nodes(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, with its interval in preorder."""
    turns, convs = spliced(conversations)
    made, reached = trie(turns, convs)
    made = written(made, "trie-nodes")
    root = made.where("depth = 0").select(F.col("conv_id").alias("root")).first()
    last = convs.join(reached.withColumnRenamed("depth", "length"), ["conv_id", "length"], "left").select(F.coalesce("top", F.lit(root[0] if root else 0)).alias("top"), F.col("length").cast("bigint").alias("depth"), "conv_id")
    found = end_digests(written(last, "conversation-ends")).withColumnRenamed("top", "conv_id")
    return made.join(found, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("n_bytes")
