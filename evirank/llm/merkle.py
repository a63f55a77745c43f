"""Merkle manifest of a dataset: one tree for each group of rows and one over the groups, with a proof for every row.

Places within a group are exact ranks from hierarchical histograms of the digits of doc_id (radix), so nothing is sorted as a whole. The
digits of a rank in the base of the fanout are the path of a leaf in the trie: nodes that share a rank without its last digits, their longest prefix, are
reduced to their parent. Several digits are dropped at a time, so that each round is one grouped shuffle of at most fanout ** digits nodes a group, and the
number of rounds grows with the logarithm of the rows. Siblings travel down again by the same prefixes, one row for each subtree.

Defined results: nulls are written as `-`, so they differ from empty texts; rows without an id come first in their group and are not tampered with in the query; rows
with equal ids are ordered by their leaf, and equal rows are leaves of their own in any order; rows without a group form one that comes first; an empty table
gives no rows; extra columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import fresh, written
from evirank.llm.radix import ranked, sortable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that one grouped row reduces at most.
SPAN = 256


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes in front, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*(framed(c) for c in fields.values()))


def _levels(hashes: Column, steps: Column, fanout: int, most: int) -> Column:
    """[the nodes, their parents, ...] up to `steps` levels above."""
    def above(low: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.size(low) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(low, i * fanout + 1, fanout), "").cast("binary"), 256))

    turns = F.slice(F.array(*map(F.lit, range(most))), F.lit(1), steps)
    return F.aggregate(turns, F.array(hashes), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _path(levels: Column, place: Column, steps: Column, fanout: int, most: int) -> Column:
    """What stands before and after the node at `place` in its run, and after its ancestors in theirs, upwards."""
    def siblings(k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fanout)), k)).cast("int")
        row, first = F.element_at(levels, k + 1), at - at % fanout
        return F.struct(F.array_join(F.slice(row, first + 1, at - first), "").alias("before"), F.array_join(F.slice(row, at + 2, first + fanout - 1 - at), "").alias("after"))

    return F.transform(F.slice(F.array(*map(F.lit, range(most))), F.lit(1), steps), siblings)


class Trie:
    """A tree over rows (group, place, hash, ...), reduced from the leaves to one node for each group."""

    def __init__(self, rows: DataFrame, group: str, place: str, node: str, carried: list[str], fanout: int):
        if fanout < 2:
            raise ValueError("a run needs at least two nodes")
        self.fanout, self.most = fanout, 1
        while fanout ** (self.most + 1) <= SPAN:
            self.most += 1
        self.span, self.rounds = fanout**self.most, []
        below = rows.select(F.col(group).alias("group"), F.col(place).alias("place"), F.col(node).alias("node"), F.struct(*carried or [F.lit(None).alias("nothing")]).alias("row"))
        while True:
            prefix = F.floor(F.col("place") / self.span).cast("bigint")
            runs = below.groupBy("group", prefix.alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("place", "node", "row"))).alias("nodes"))
            heights = [F.when(F.size("nodes") <= fanout**k, k) for k in range(self.most)]  # a group's only run ends at its root, all others are full height
            steps = F.when(F.col("prefix") > 0, self.most).otherwise(F.coalesce(*heights, F.lit(self.most)))
            levels = _levels(F.transform("nodes", lambda x: x["node"]), F.col("steps"), fanout, self.most)
            runs = written(runs.withColumn("steps", steps).withColumn("levels", levels), "merkle-runs")
            self.rounds.append(runs)
            if not (runs.agg(F.max("prefix")).first()[0] or 0):
                break
            top = F.element_at(F.element_at("levels", -1), 1)
            below = runs.select("group", F.col("prefix").alias("place"), top.alias("node"), F.struct(F.lit(None).alias("nothing")).alias("row"))

    def roots(self) -> DataFrame:
        """(group, root)"""
        return self.rounds[-1].select("group", F.element_at(F.element_at("levels", -1), 1).alias("root"))

    def paths(self, above: DataFrame, more: list[str]) -> DataFrame:
        """The carried columns of every leaf with its `path`; above has (group, path, ...) of the roots, whose columns `more` every leaf gets too."""
        steps = F.col("steps")
        for k, runs in enumerate(reversed(self.rounds)):
            on = ["group"] if k == 0 else ["group", "prefix"]
            met = runs.join(above, on)
            own = lambda x: _path(F.col("levels"), (x["place"] - F.col("prefix") * self.span).cast("int"), steps, self.fanout, self.most)
            each = F.transform("nodes", lambda x: F.struct(x["place"].alias("prefix"), x["node"].alias("leaf"), x["row"].alias("row"), F.concat(own(x), F.col("path")).alias("path")))
            above = met.select("group", *more, F.inline(each))
            if k < len(self.rounds) - 1:
                above = above.drop("leaf", "row")
        return above.select("group", "row.*", "leaf", "path", *more)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def proof(path: Column) -> Column:
    """One digest of all siblings, upwards."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2, carried: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: order, leaf, subroot, root and path, an array of (before, after) siblings upwards; carried columns are added."""
    carried = carried or {}
    key, uid = fresh(rows, "group"), F.monotonically_increasing_id()
    named = F.coalesce(F.concat(F.lit("1"), F.hex(F.col(group).cast("string").cast("binary"))), F.lit("0"))
    items = rows.select(named.alias(key), F.col(order).cast("bigint").alias("__order"), leaf({f: F.col(f) for f in fields}).alias("__leaf"), *(c.alias(f"__c_{n}") for n, c in carried.items()), uid.alias("__uid"))
    items = written(items.withColumnRenamed(key, "__group"), "merkle-leaves")
    ascending = F.concat(F.coalesce(F.concat(F.lit("1"), sortable(F.col("__order"))), F.lit("0")), F.lit(":"), F.col("__leaf"), F.lit(":"), sortable(F.col("__uid")))
    placed = ranked(items, ["__group"], ascending, "__place")
    trie = Trie(placed, "__group", "__place", "__leaf", ["__order", *(f"__c_{n}" for n in carried)], fanout)
    subroots = written(trie.roots().select(F.lit("*").alias("all"), F.col("group").alias("name"), F.col("root").alias("subroot")), "merkle-subroots")
    top = Trie(ranked(subroots, ["all"], F.col("name"), "place"), "all", "place", "subroot", ["name"], fanout)
    ends = top.roots().select("group", "root", F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    over = top.paths(ends, ["root"]).select(F.col("name").alias("group"), F.col("leaf").alias("subroot"), "root", "path")
    out = trie.paths(over, ["subroot", "root"])
    return out.select(F.col("__order").alias(order), "leaf", "subroot", "root", "path", *(F.col(f"__c_{n}").alias(n) for n in carried))


def digests(documents: DataFrame) -> DataFrame:
    """The manifest of documents, with the roots that tampered rows lead to."""
    changed = F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")), F.lit(7)) == 0
    fields = {f: F.col(f) for f in FIELDS}
    tampered = F.when(changed, leaf(fields | {"n_chars": F.try_add(F.col("n_chars").cast("bigint"), F.lit(1).cast("bigint"))}))
    made = manifest(documents, carried={"tampered": tampered})
    made = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def changed_rows(old: DataFrame, new: DataFrame, order: str = "doc_id") -> DataFrame:
    """(order, subroot changed, status) of rows that two manifests do not share; groups with equal subroots are left out before rows are compared."""
    same = old.select("subroot").distinct().join(new.select("subroot").distinct(), "subroot")
    left, right = (m.join(same, "subroot", "left_anti").groupBy(F.col(order), "leaf").agg(F.count("*").alias(n)) for m, n in ((old, "was"), (new, "now")))
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{order}").eqNullSafe(F.col(f"r.{order}")) & (F.col("l.leaf") == F.col("r.leaf")), "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("recounted")
    return both.where("was is null or now is null or was <> now").select(F.coalesce(f"l.{order}", f"r.{order}").alias(order), F.coalesce("l.leaf", "r.leaf").alias("leaf"), status.alias("status"))
