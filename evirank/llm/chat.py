"""Chat formatting of reply trees, with DataFrame functions only.

Messages point at the message they answer. Self-joins double the distance that each message looks up (1, 2, 4, ... ancestors) and add up, on the way,
its depth, its score and the characters of what stands before it; the same joins list the messages of every root-to-leaf path, so the number of rounds is the
logarithm of the deepest path. Branches are ranked by the sum of their scores with exact ranks from digit histograms, and the chosen paths are formatted
as one conversation each, with the spans of assistant texts as loss mask.

The template writes a turn as START role SEP text END. A control string within a role or a text gets a backslash behind its first character, and one that
already has backslashes there gets one more, so escaping is undone exactly and no control string is left in a text; other text stays as it is. Control
strings have `<` or `[` at their beginning only, so none arises where pieces meet.

Defined results: null roles and texts are empty; a message whose parent is null or absent is a root; a message repeated by tree and id stays once (the greatest
by parent, score, role and text); rows without a tree or an id take no part; a cycle of replies is an error; an empty table gives no rows; extra columns take no
part, whatever their names. One path is one value, so it must fit in 2 GB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import joined, written
from evirank.llm.radix import ranked, sortable
from evirank.llm.turns import placed, said


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    trained: str = "assistant"

    def __post_init__(self):
        for s in (self.start, self.sep, self.end, *self.others):
            if len(s) < 3 or s[0] not in "<[" or re.search(r"[<\[\\]", s[1:]):
                raise ValueError(f"a control string begins with < or [, and has neither of these nor a backslash behind: {s}")

    def _rest(self) -> str:
        return "|".join(re.escape(s[1:]) for s in sorted({self.start, self.sep, self.end, *self.others}, key=len, reverse=True))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._rest()})", r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._rest()})", "$1$2$3")

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.start), self.escaped(role), F.lit(self.sep), self.escaped(text), F.lit(self.end))

    def lead(self, role: Column) -> Column:
        """Characters of a turn before its text."""
        return F.length(self.escaped(role)) + len(self.start) + len(self.sep)

    def parsed(self, formatted: Column) -> Column:
        """[(role, text)] of a formatted conversation, both still escaped."""
        pieces = F.split(formatted, re.escape(self.end))
        body = lambda p: F.split(F.substr(p, F.lit(len(self.start) + 1)), re.escape(self.sep), 2)
        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(F.get(body(p), F.lit(0)).alias("role"), F.get(body(p), F.lit(1)).alias("text")))


def once(messages: DataFrame) -> DataFrame:
    """messages (tree, node, parent, score, role, text) with one row for each tree and node, and none without one."""
    known = messages.where("tree is not null and node is not null")
    best = F.max(F.struct("parent", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"), said("role").alias("role"), said("text").alias("text")))
    return known.groupBy("tree", "node").agg(best.alias("best")).select("tree", "node", "best.*")


def _looked_up(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right, which has one row for each key, where a key may hold very many rows of left."""
    counts = left.groupBy(*on).agg(F.count("*").alias("n_met"))
    return joined(left, written(right.join(counts, on), "met"), on, "n_met").drop("n_met")


def rooted_paths(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, depth, before, total) of all messages, and (tree, leaf, node) of all root-to-leaf paths.

    messages is (tree, node, parent, chars, score), a table in storage with distinct (tree, node); before is the characters of all ancestors, total the sum of
    the scores from the root to the message. A round joins each message with the one it points at, which is twice as far up each time.
    """
    on = ["tree", "node"]
    linked = messages.join(messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there")), ["tree", "parent"], "left")
    up = linked.select(*on, F.when(F.col("there"), F.col("parent")).alias("at"), F.lit(1).cast("bigint").alias("steps"), F.col("chars").alias("upto"), F.col("score").alias("total"), "chars")
    up = written(up, "replies")
    answered = up.where("at is not null").select("tree", F.col("at").alias("node")).distinct()
    pairs = up.join(answered, on, "left_anti").select("tree", F.col("node").alias("leaf"), "node")
    settled, rounds, reach, most = [], [], 1, messages.count()
    while True:
        settled.append(up.where("at is null"))
        open_ = up.where("at is not null")
        if not open_.head(1):
            break
        if reach > most:
            raise ValueError("replies form a cycle")
        rounds.append(open_.select(*on, "at"))
        target = settled[0].unionByName(open_) if len(settled) == 1 else written(_all(settled).unionByName(open_), "targets")
        target = target.select("tree", F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more_steps"), F.col("upto").alias("more_upto"), F.col("total").alias("more_total"))
        met = _looked_up(open_, target, ["tree", "at"])
        up = written(met.select(*on, F.col("next").alias("at"), (F.col("steps") + F.col("more_steps")).alias("steps"), (F.col("upto") + F.col("more_upto")).alias("upto"), (F.col("total") + F.col("more_total")).alias("total"), "chars"), "replies")
        reach *= 2
    pairs = written(pairs, "paths")
    for nearer in rounds:
        higher = _looked_up(pairs, nearer, on).select("tree", "leaf", F.col("at").alias("node"))
        pairs = written(pairs.unionByName(higher), "paths")
    nodes = _all(settled).select(*on, (F.col("steps") - 1).alias("depth"), (F.col("upto") - F.col("chars")).alias("before"), "total")
    return written(nodes, "rooted"), pairs


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conversations_of(texts: DataFrame, links: DataFrame, template: Template = Template(), keep: int | None = None) -> DataFrame:
    """One row for each chosen root-to-leaf path: tree, leaf, branch_rank from 1, n_messages, formatted and loss_spans.

    texts (tree, node, role, text) and links (tree, node, parent, score) are tables in storage with distinct (tree, node). Branches of a tree are ranked by the sum of
    their scores, highest first, ties by the smaller leaf; `keep` of each tree are chosen, all if it is None. loss_spans holds (turn, start, end) of each
    text of the trained role in code points of formatted.
    """
    sized = texts.select("tree", "node", F.length(template.turn(said("role"), said("text"))).cast("bigint").alias("chars"))
    messages = written(links.select("tree", "node", "parent", "score").join(sized, ["tree", "node"]), "messages")
    nodes, pairs = rooted_paths(messages)
    ends = written(pairs.where("leaf = node").select("tree", "node").join(nodes, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "total", (F.col("depth") + 1).alias("n_messages")), "branches")
    branches = ranked(ends, ["tree"], F.concat(sortable(F.bitwise_not("total")), sortable(F.col("leaf"))), "place").withColumn("branch_rank", F.col("place") + 1).drop("place", "total")
    if keep is not None:
        branches = written(branches.where(F.col("branch_rank") <= keep), "branches")
        pairs = joined(pairs, branches.select("tree", "leaf", "n_messages"), ["tree", "leaf"], "n_messages").drop("n_messages")
    role, text = said("role"), said("text")
    turns = texts.join(nodes.select("tree", "node", "depth", "before"), ["tree", "node"]).select("tree", "node", "depth", "before", template.turn(role, text).alias("piece"), template.lead(role).alias("lead"), (role == template.trained).alias("trained"))
    each = pairs.join(turns, ["tree", "node"])  # a message of many paths is a skewed key here, which adaptive execution splits
    made = each.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "before", "piece", "lead", "trained"))).alias("turns"))
    span = lambda t: F.struct(t["depth"].alias("turn"), (t["before"] + t["lead"]).alias("start"), (t["before"] + F.length(t["piece"]) - len(template.end)).alias("end"))
    made = made.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["trained"]), span).alias("loss_spans"))
    return made.join(branches, ["tree", "leaf"])


def reply_trees(messages: DataFrame, template: Template = Template(), keep: int | None = None) -> DataFrame:
    """conversations_of for any table (tree, node, parent, score, role, text) with BIGINT ids and scores, repeated rows and nulls included."""
    held = written(once(messages), "messages-once")
    return conversations_of(held.select("tree", "node", "role", "text"), held.select("tree", "node", "parent", "score"), template, keep)


def of_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conversations_of for rows (conv_id, turn, role, text): each turn answers the one before it, and each scores one."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.monotonically_increasing_id().alias("node"))
    rows = written(rows, "chat-texts")
    order = written(placed(rows, {"node": F.col("node")}), "chat-turns")
    before = order.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("node").alias("parent"))
    links = order.join(before, ["conv_id", "pos"], "left").select(F.col("conv_id").alias("tree"), "node", "parent", F.lit(1).cast("bigint").alias("score"))
    return conversations_of(rows.select(F.col("conv_id").alias("tree"), "node", "role", "text"), written(links, "chat-links"), template)


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read back from the formatted conversations, and from that of conversation -1, whose texts hold control strings."""
    spark = conversations.sparkSession
    control = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
    made = of_turns(rows, template).withColumn("parsed", template.parsed(F.col("formatted")))
    whole = F.transform("parsed", lambda t: F.concat(template.unescaped(t["role"]), F.lit("\n"), template.unescaped(t["text"]), F.lit("\n")))
    masked = lambda s: F.when(F.length(F.get("parsed", s["turn"].cast("int"))["text"]) == s["end"] - s["start"], template.unescaped(F.get("parsed", s["turn"].cast("int"))["text"]))
    loss = F.transform("loss_spans", masked)
    return made.select(
        F.col("tree").alias("conv_id"), F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(F.array_join(whole, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join(loss, "")).cast("bigint").alias("loss_chars"), F.sha2(F.array_join(loss, "").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "branch_rank",
    )
