"""Exact n-gram Jaccard components by count-vector R-trees.

A text's set is its distinct word shingles as 64-bit hashes; equal sets are one node, named by a hash of the set. Shingles are grouped
by their leading hash bits, and a node's point is the number of its shingles in each group (2 to 4 a group on average).
The overlap of two sets is at most the sum of the coordinate minima of their points, and of a point and the upper corner of a box.

The index is spread over the cluster by prefix keys: with any one order of all shingles, two sets that link share a shingle
among the first n - ceil(t n) + 1 of each. The order puts shingles that are frequent in the corpus last, the more frequent the later, as a
sketch of all counts tells; it decides cost, never results. Rows of a key are a bucket. First every member of a bucket is tried against two of its
members (the least node and the one with most shared keys), which settles most groups of copies, and all pairs of least members. Each bucket whose other
members still span several components is a count-vector R-tree of these, loaded by size band; a tree is joined with itself from the root down, and a pair of boxes is left out
when sizes or summed coordinate minima rule out a link, or when all its members are in one component. Leaves are swept pair by pair. Every pair
across components that the bounds leave is verified. Buckets of more than SHARE rows first give a share of their pairs, which joins most of their
components, large ones then a larger share, and last all others across components; no pair is tried twice in a bucket, and pairs within a component are never emitted. Buckets over BLOCK_ROWS are trees of blocks and of pairs of blocks.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than the shingle width are
one shingle; repeated rows and equal texts share a component; ids may be null or repeat with other texts; an empty table gives no rows; extra
columns are dropped. The job fails if components do not settle in 60 rounds (see common.components).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import SMALL_IDS, components, distinct_texts, extended, few, giving_back, joined, key_of, repeated_texts, written

WIDTH, PERCENT, BLOCK_ROWS, FANOUT, SHARE, WIDER, TREE_WIDTH = 5, 75, 2_000, 8, 4, 32, 64
PIECE_CELLS, SLICES = 1 << 14, 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_STEP, _PIECE = 0xD1342543DE82EF95, 1 << 22
_UPPER = np.arange(256)
_UPPER[65:91] += 32  # A-Z count as a-z
_IS_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32)).astype(np.int8)
_SPACE_RUN = re.compile(rb"[\x09-\x0d\x20]")


class _Powers:
    """Powers of the step and of its inverse, as far as some text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])[_UPPER]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a running sum of its bytes' values times powers, cut at white space."""
    parts, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            cut = _SPACE_RUN.search(raw, end)
            end = cut.start() if cut else len(raw)
        b = np.frombuffer(raw, np.uint8)[at:end]
        at = end
        edge = np.flatnonzero(np.diff(_IS_SPACE[b], prepend=1, append=1))
        first, last = edge[0::2], edge[1::2]
        _POWERS.grow(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUES[b] * _POWERS.up[: len(b)], out=total[1:])
        parts.append((total[last] - total[first]) * _POWERS.down[first] + (last - first).astype(np.uint64))
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def all_shingles(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of all word n-grams, in the order of the text."""
    if not raw:
        return np.empty(0, np.uint64)
    h = word_hashes(raw)
    n = len(h)
    if not n:
        return h
    take = min(n, width)
    out = h[: n - take + 1] * _ODD[0]
    for i in range(1, take):
        out += h[i : n - take + 1 + i] * (_ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD))))
    return _mix(out + np.uint64(take))


def shingles(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of UTF-8 text; A-Z count as a-z and ASCII white space parts words."""
    h = all_shingles(raw, width)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def named(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set; the first is its node."""
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)


def needed(a, b, percent: int = PERCENT):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def point(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall into each group; there are two to four shingles a group on average, and eight groups at least."""
    k = max(3, math.ceil(math.log2(max(len(hashes), 1) / 4)))
    return np.bincount((hashes >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype("<u2")


def folded(p: np.ndarray, width: int) -> np.ndarray:
    """The point over fewer groups; groups are leading bits, so neighbours are added."""
    return p.reshape(width, -1).sum(axis=1, dtype=np.uint32)


def may_overlap(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the summed coordinate minima of two points reach the overlap their sets need."""
    width = min(len(p), len(q))
    return int(np.minimum(folded(p, width), folded(q, width)).sum()) >= needed(int(p.sum(dtype=np.int64)), int(q.sum(dtype=np.int64)), percent)


class CountForest:
    """Count-vector R-trees of many buckets, bulk-loaded by set size.

    Rows are sorted by (bucket, n). Level 0 holds rows; a box of the level above covers up to FANOUT neighbours of one bucket and
    keeps the greatest count of each group, the sizes it spans and the components it spans. Each bucket ends in one root.
    """

    def __init__(self, bucket: np.ndarray, n: np.ndarray, component: np.ndarray, points: np.ndarray, fanout: int = FANOUT):
        self.levels = [(bucket, points, n, n, component, component)]
        self.begins: list[np.ndarray] = []  # of each level above 0: where each box's members begin, and the end of the last
        while len(self.levels[-1][0]):
            bucket, upper, low, high, least, most = self.levels[-1]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            if len(first) == len(bucket) and self.begins:
                break
            place = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            begin = np.flatnonzero(place % fanout == 0)
            self.begins.append(np.append(begin, len(bucket)))
            self.levels.append((bucket[begin], np.maximum.reduceat(upper, begin, axis=0), np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)))

    def _left(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether members of boxes a and b, a before b, may link across components."""
        _, upper, low, high, least, most = self.levels[level]
        ok = (100 * high[a] >= percent * low[b]) & ((least[a] != least[b]) | (most[a] != most[b]) | (least[a] != most[a]))
        need = needed(np.maximum(low[a], -(-percent * low[b] // 100)), low[b], percent)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            ok[part] = np.minimum(upper[a[part]], upper[b[part]]).sum(axis=1, dtype=np.int64) >= need[part]
        return ok

    def pairs(self, percent: int = PERCENT, chunk: int = 10_000):
        """Arrays (a, b) of row places, a before b, of pairs that the bounds leave."""
        if not self.begins:
            return
        top = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.begins), top[k : k + chunk], top[k : k + chunk]) for k in range(0, len(top), chunk)]
        while todo:
            level, a, b = todo.pop()
            if not level:
                yield a, b
                continue
            begin = self.begins[level - 1]
            na, nb = begin[a + 1] - begin[a], begin[b + 1] - begin[b]
            owner = np.repeat(np.arange(len(a)), na * nb)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = begin[a][owner] + step // nb[owner], begin[b][owner] + step % nb[owner]
            keep = (x < y) if level == 1 else (x <= y)
            x, y = x[keep], y[keep]
            keep = self._left(level - 1, x, y, percent)
            x, y = x[keep], y[keep]
            if level == 1:
                if len(x):
                    todo.append((0, x, y))
            else:
                todo += [(level - 1, x[k : k + chunk], y[k : k + chunk]) for k in range(0, len(x), chunk)]


def _may_link(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair whose first common key stands at these places of the order can still reach the overlap it needs."""
    return 1 + np.minimum(n[a] - at[a] - 1, n[b] - at[b] - 1) >= needed(n[a], n[b], percent)


def matrix_of(cells: list[bytes]) -> np.ndarray:
    """Points of TREE_WIDTH groups as rows; one byte a group, or four where a count is over 255."""
    out = np.empty((len(cells), TREE_WIDTH), np.uint32)
    for wide in (False, True):
        own = np.array([i for i, c in enumerate(cells) if (len(c) > TREE_WIDTH) == wide], np.int64)
        if len(own):
            out[own] = np.frombuffer(b"".join([cells[i] for i in own]), "<u4" if wide else np.uint8).reshape(-1, TREE_WIDTH)
    return out


def cells_of(hashes: np.ndarray) -> bytes:
    count = np.bincount((hashes >> np.uint64(64 - TREE_WIDTH.bit_length() + 1)).astype(np.int64), minlength=TREE_WIDTH)
    return count.astype(np.uint8 if count.max(initial=0) < 256 else "<u4").tobytes()


def tree_pairs(rows: dict[str, np.ndarray], cells: list[bytes], share: bool, percent: int = PERCENT, stats: dict | None = None, rest: bool = False, each: int = SHARE, wider: int | None = None) -> np.ndarray:
    """Pairs (least node first) across components that the trees of many buckets leave; rows are sorted by (bucket, n, node).

    rows: bucket, node, n, at, component, m (the bucket's size) and own and cross, which say that only pairs across sides count. share: of a
    bucket of more than `each` members only some pairs, by a hash of both, about `each` for each two members. rest: the pairs that share leaves out. wider: of what is
    left then, only the pairs of a larger share of large buckets (if share), or all but these (if rest).
    """
    node, n, at, component, m, own, cross = (rows[c] for c in ("node", "n", "at", "component", "m", "own", "cross"))
    forest = CountForest(rows["bucket"], n, component, matrix_of(cells))
    found: list[np.ndarray] = []
    for a, b in forest.pairs(percent):
        ok = (component[a] != component[b]) & (node[a] != node[b]) & (~cross[a] | (own[a] != own[b])) & _may_link(n, at, a, b, percent)
        if share or rest:
            x, y = (f(node[a], node[b]).view(np.uint64) for f in (np.minimum, np.maximum))
            name = _mix(x ^ _mix(y))
            hit = lambda e: name % np.maximum(1, -(-m[a] // e)).astype(np.uint64) == 0  # noqa: E731, B023
            if wider is None:
                ok &= hit(each) == share
            else:
                ok &= ~hit(each) & ((hit(wider) & (m[a] > 2 * wider)) == share)
        x, y = node[a[ok]], node[b[ok]]
        if len(x):
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
    if stats is not None:
        stats |= {"levels": len(forest.begins), "boxes": sum(len(x[0]) for x in forest.levels[1:])}
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def levels_of(texts: DataFrame, text_col: str = "text", cells: int = 1 << 18, width: int = WIDTH) -> bytes:
    """Compressed bytes, one for each cell of a hash sketch of all shingle counts: 0 where the count does not stand far above the mean, else
    one and the whole binary logarithm of how many times over it does.

    Each counting task gives its sketch in pieces of at most PIECE_CELLS cells; there are about two such tasks a core, whatever the
    corpus. Pieces are added up in two rounds, first in SLICES slices of the tasks, so that no group holds those of all tasks.
    """
    step = min(cells, PIECE_CELLS)

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            held, n = [], 0
            for raw in [*batch.column(0).to_pylist(), None]:
                if raw:
                    held.append((all_shingles(raw, width) & np.uint64(cells - 1)).astype(np.int64))
                    n += len(held[-1])
                if held and (n > cells or raw is None):
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
        own = TaskContext.get().partitionId() % SLICES
        for i in range(cells // step):
            piece = total[i * step : (i + 1) * step]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own], pa.int32()), pa.array([piece.astype("<i8").tobytes()], pa.binary())], ["part", "slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for piece in rows["counts"]:
            total += np.frombuffer(piece, "<i8")
        return rows.head(1).assign(counts=[total.tobytes()])

    kinds = "part int, slice int, counts binary"
    dealt = texts.select(F.col(text_col).cast("binary").alias("raw")).coalesce(max(256, 2 * texts.sparkSession.sparkContext.defaultParallelism))
    parts = dealt.mapInArrow(giving_back(count), kinds).groupBy("part", "slice").applyInPandas(add, kinds).groupBy("part").applyInPandas(add, kinds).collect()
    total = np.zeros(cells, np.int64)  # cells numbers, whatever the corpus
    for r in parts:
        total[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], "<i8")
    limit = total.mean() + 8 * math.sqrt(total.mean() + 1) + 24
    return zlib.compress(np.where(total > limit, 1 + np.floor(np.log2(np.maximum(total / limit, 1))), 0).astype(np.uint8).tobytes())


def prefix_keys(h: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """A set's prefix in the order of all shingles, by level and then by hash, and how many of its shingles are of level 0."""
    own = levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)]
    most = prefix_length(len(h), percent)
    rare = int((own == 0).sum())
    return (h if rare == len(h) else h[np.argsort(own, kind="stable")])[:most], min(rare, most)


_NODES = "text_key bigint, copies bigint, n_shingles bigint, node bigint, check bigint, point binary, cells binary, rare int, keys array<bigint>"


def nodes(texts: DataFrame, levels: bytes, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(text_key, copies, n_shingles, node, check, ...): the set's two hashes, its points and its prefix keys; node is null for empty sets."""

    def run(batches):
        own = np.frombuffer(zlib.decompress(levels), np.uint8)
        for batch in batches:
            columns = [[] for _ in range(7)]
            for raw in batch.column(1).to_pylist():
                h = shingles(raw, width)
                values = (0, *[None] * 6)
                if len(h):
                    keys, rare = prefix_keys(h, own, percent)
                    values = (len(h), *named(h), point(h).tobytes(), cells_of(h), rare, _signed(keys))
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in _NODES.split(", ")])

    return texts.select("text_key", F.col("text").cast("binary").alias("raw"), "copies").mapInArrow(giving_back(run), _NODES)


_SETS = "node bigint, hashes binary"


def node_sets(documents: DataFrame, repeated: DataFrame, of_node: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """The sets of some nodes, worked out again from the text that stands for each; copies of other texts are not touched while the keys are few."""

    def run(batches):
        for batch in batches:
            own, sets = [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingles(raw, width)
                if len(h) and named(h)[0] == node:  # else another text of the same 64-bit name
                    own.append(node), sets.append(h.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    chosen = written(of_node.select("node", "text_key").join(wanted.distinct(), "node"), "jaccard-chosen")
    texts = documents.select(F.col(text_col).alias("text"))
    if chosen.count() <= SMALL_IDS:
        near = texts.withColumn("text_key", key_of(F.col("text"))).join(F.broadcast(chosen.select("text_key")), "text_key", "left_semi")
        texts = distinct_texts(near.select("text"), repeated).join(F.broadcast(chosen), "text_key")
    else:
        texts = distinct_texts(texts, repeated).join(chosen, "text_key")
    return texts.select("node", F.col("text").cast("binary").alias("raw")).mapInArrow(giving_back(run), _SETS)


def _two_sided(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    a = values.select(F.col("node").alias("a"), F.col(column).alias("x_a"))
    b = values.select(F.col("node").alias("b"), F.col(column).alias("x_b"))
    return pairs.join(a, "a").join(b, "b")


def _checked(pairs: DataFrame, dtype: str, linked) -> DataFrame:
    """The pairs (a, b) for whose two arrays (x_a, x_b) linked holds."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kept = np.array([linked(*(np.frombuffer(batch.column(c)[i].as_buffer(), dtype) for c in (2, 3))) for i in range(len(a))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    return pairs.select("a", "b", "x_a", "x_b").mapInArrow(giving_back(run), "a bigint, b bigint")


def bounded(pairs: DataFrame, of_node: DataFrame, percent: int) -> DataFrame:
    """Pairs that the summed coordinate minima of their whole points leave."""
    return _checked(_two_sided(pairs, of_node, "point"), "<u2", lambda p, q: may_overlap(p, q, percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that link: 100 * overlap >= percent * union."""
    return _checked(_two_sided(pairs, sets, "hashes"), "<u8", lambda p, q: overlap(p, q) >= needed(len(p), len(q), percent))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that span several components, with their component and the size m of their bucket."""
    n, at = _unpacked("size_at")
    own = rows.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    own = written(own.select("key", "node", n.alias("n"), at.alias("at"), F.coalesce("component", "node").alias("component")), "jaccard-own")
    open_keys = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m")
    return joined(own, written(open_keys, "jaccard-open"), ["key"], "m")


def tree_candidates(sized: DataFrame, of_node: DataFrame, share: bool, percent: int, wider: int | None = None) -> DataFrame:
    """Pairs across components that the trees of the open buckets (key, node, n, at, component, m) leave, each pair once: a share of those of
    each bucket, or all that are not of that share, which only buckets of more than SHARE members have. wider: of buckets of more than twice as many members
    a larger share of what the first share left out, or all that are in neither."""
    each = SHARE
    if not share or wider:
        sized = sized.where(F.col("m") > (2 * wider if share else each))

    def search(frames):
        held: list[pd.DataFrame] = []
        size = 0

        def flush(whole: pd.DataFrame) -> pd.DataFrame:
            whole = whole.drop_duplicates(["key", "i", "j", "node"], ignore_index=True)
            rows = {c: whole[c].to_numpy() for c in ("node", "n", "at", "component", "m", "own")}
            rows["bucket"] = whole.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
            rows["cross"] = (whole["i"] != whole["j"]).to_numpy()
            return pd.DataFrame(tree_pairs(rows, whole["cells"].tolist(), share, percent, rest=not share, each=each, wider=wider), columns=["a", "b"], dtype="int64")

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= 100_000:
                whole = pd.concat(held, ignore_index=True)
                last = whole.iloc[-1]
                rest = ((whole["key"] == last["key"]) & (whole["i"] == last["i"]) & (whole["j"] == last["j"])).to_numpy()  # may go on in the next frame
                if not rest.all():
                    yield flush(whole[~rest])
                    whole = whole[rest]
                held, size = [whole], len(whole)
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "at", "component", "m").join(of_node.select("node", "cells"), "node")
    parts = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")
    return bounded(parts.mapInPandas(giving_back(search), "a bigint, b bigint").distinct(), of_node, percent)


def bucket_rows(of_node: DataFrame) -> DataFrame:
    """(key, node, size_at): rows of keys that several nodes share; the set's size and the key's place are packed into one number. Frequent keys are taken as shared, so that their rows never gather to be counted."""
    named = ["key", "node", "size_at"]
    size = F.col("n_shingles") * F.lit(1 << 31)
    rare = of_node.select("node", size.alias("size"), F.posexplode(F.slice("keys", F.lit(1), F.col("rare"))).alias("at", "key")).select("key", "node", (F.col("size") + F.col("at")).alias("size_at"))
    often = of_node.where(F.size("keys") > F.col("rare")).select("node", (size + F.col("rare")).alias("size"), F.posexplode(F.slice("keys", F.col("rare") + 1, F.size("keys") - F.col("rare"))).alias("at", "key")).select("key", "node", (F.col("size") + F.col("at")).alias("size_at"))
    dealt = rare.repartition("key")  # one exchange serves both the counts and the join
    # all columns are used here too, else the exchange would be planned twice
    shared = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("size_at").alias("top")).where("lo < hi and top >= 0").select("key")
    rows = dealt.join(shared.hint("shuffle_hash"), "key").select(*named).unionAll(often.select(*named))
    return rows.select("key", "node", "size_at")


def _unpacked(size_at: str) -> tuple[Column, Column]:
    """(n, at) of a packed column."""
    return F.shiftright(size_at, 31), F.col(size_at).bitwiseAND(F.lit((1 << 31) - 1))


def picked(members: DataFrame, order: Column, label: str) -> DataFrame:
    """(key, m, p, p_size_at) in storage: the first member p of each bucket of m > 1 rows."""
    # primitive buffers, so that counts and picks are combined by hash before the shuffle
    first = members.groupBy("key").agg(F.count("*").alias("m"), F.min_by("node", order).alias("p"), F.min_by("size_at", order).alias("p_size_at"))
    return written(first.where("m > 1"), label)


def without_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows but for the least member of each bucket. A pair that links stands at its first common key; if one of it is least there, the star
    step has tried it, so only the other members' pairs are left, and buckets of two have none."""
    return joined(rows, least.where("m > 2").select("key", "m", "p"), ["key"], "m").where("node <> p").select("key", "node", "size_at")


def star_pairs(rows: DataFrame, least: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member of a bucket with its least member, and in an eighth of the buckets with the member of most shared keys."""

    def against(members: DataFrame, first: DataFrame) -> DataFrame:
        return joined(members.select("key", "node", "size_at"), first, ["key"], "m").where("node <> p").select("node", "size_at", "p", "p_size_at")

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(8)) == 0)
    some = some.join(some.groupBy("node").agg(F.count("*").alias("w")), "node")
    most = picked(some, -F.col("w") * F.lit(1 << 32) - F.col("node").bitwiseAND(F.lit((1 << 32) - 1)), "jaccard-most")
    near = against(rows, least).unionAll(against(some, most))
    (n, at), (p_n, p_at) = _unpacked("size_at"), _unpacked("p_size_at")
    near = near.select("node", "p", n.alias("n"), at.alias("at"), p_n.alias("p_n"), p_at.alias("p_at"))
    need = F.expr(f"({percent} * (n + p_n) + {99 + percent}) div {100 + percent}")  # rounded up in whole numbers
    near = near.where((1 + F.least(F.col("n") - F.col("at") - 1, F.col("p_n") - F.col("p_at") - 1) >= need) & (F.col("n") * 100 >= F.col("p_n") * percent) & (F.col("p_n") * 100 >= F.col("n") * percent))
    return near.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def link_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component) of each row of documents; component names a class of linked sets and is null for empty sets."""
    cells = 1 << min(24, max(16, math.ceil(math.log2(max(documents.count(), 2)))))
    repeated = repeated_texts(documents, text_col)
    texts = distinct_texts(documents, repeated, text_col)
    table = written(nodes(texts, levels_of(documents, text_col, cells, width), width, percent), "jaccard-nodes")  # copies may count, since levels decide cost only
    # one text stands for each set; the list of the others is sent around only while it is short
    known = table.where("node is not null")
    others = known.groupBy("node").agg(F.count("*").alias("n"), F.min("text_key").alias("least")).where("n > 1")
    others = written(known.select("node", "text_key").join(others, "node").where("text_key <> least").select("text_key"), "jaccard-others")
    of_node = known.join(few(others), "text_key", "left_anti")
    rows = written(bucket_rows(of_node), "jaccard-rows")

    def linked(candidates: DataFrame) -> DataFrame | None:
        candidates = written(candidates, "jaccard-candidates")
        return None if candidates.isEmpty() else written(verified(candidates, node_sets(documents, repeated, of_node, ends(candidates), text_col, width), percent), "jaccard-links")

    least = picked(rows, F.col("node"), "jaccard-least")
    links = linked(bounded(star_pairs(rows, least, percent), of_node, percent))
    labels = written(components(links), "jaccard-labels") if links is not None else rows.sparkSession.createDataFrame([], "id bigint, component bigint")
    rows = written(without_least(rows, least), "jaccard-left")
    eighth = F.pmod(F.xxhash64("key"), F.lit(8)) == 0
    # a share of the pairs of an eighth of the buckets, of the others, a larger share of the large buckets, then all other pairs
    steps = [(rows.where(eighth), True, None), (rows.where(~eighth), True, None), (rows, False, WIDER)]
    if (least.agg(F.max("m")).first()[0] or 0) > 2 * WIDER:
        steps.insert(2, (rows, True, WIDER))
    for some, share, wider in steps:
        links = linked(tree_candidates(open_rows(some, labels), of_node, share, percent, wider))
        if links is not None and not links.isEmpty():
            labels = written(extended(labels, links), "jaccard-labels")

    found = table.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").select("text_key", "copies", "n_shingles", F.coalesce("component", "node").alias("component"))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    return joined(rows, written(found, "jaccard-found"), ["text_key"], "copies").select("doc_id", "text_key", "n_shingles", "component")


def link_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of documents."""
    table = written(link_table(documents, id_col, text_col, width, percent), "jaccard-table")
    inside = table.where("component is not null")
    least = written(inside.groupBy("component").agg(F.count("*").alias("n"), F.min("doc_id").alias("component_id")), "jaccard-least")
    alone = table.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined(inside, least, ["component"], "n").select("doc_id", "n_shingles", "component_id").unionAll(alone)
