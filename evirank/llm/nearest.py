"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted to a bounded sample (SAMPLE rows, by a hash of the id); every row is then dealt to a leaf. Vectors get one more
coordinate that makes all lengths equal, so that the largest inner product is the least distance. A query walks the tree best bin first: a
priority queue holds the open nodes by distance to their centres. How many leaves it visits is calibrated: for CALIBRATE
queries the exact neighbours among all rows are found by a scan in blocks, and visits widen until the leaves visited hold TARGET of them.

Rows are laid out leaf after leaf and cut into blocks of about BLOCK_ROWS, so that many equal vectors never meet in one task; queries are dealt to slices of
about as many. A block and a slice meet in one task, which gets a query once with its leaves there and returns the best k of all of them, and a query's best are
merged. Scores are double precision sums over the original vectors in a fixed order, so equal vectors have equal scores.

Defined results: vectors that are null, empty, zero, of another than the most usual length, or that hold null or non-finite components take no part; ties go to the smaller
id; a repeated id is one candidate for each of its rows but never its own neighbour; with fewer than k candidates all are returned; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evirank.llm.common import written

SAMPLE, BRANCH, LEAF_SAMPLE, ROUNDS, CALIBRATE, TARGET, BLOCK_ROWS = 20_000, 8, 32, 8, 100, 0.94, 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row; far points first, then Lloyd's rounds; empty centres are dropped."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(x)))]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and near.max() > 0:
        picked.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    centres = x[picked]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        used, own = np.unique(own, return_inverse=True)
        new = np.stack([x[own == i].mean(0) for i in range(len(used))])
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres, ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Tree:
    """Nodes in arrays: a node's children and their centres; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_SAMPLE):
        self.dim = sample.shape[1]
        self.reach = float(np.sqrt((sample**2).sum(1).max()))
        x = self.lifted(sample)
        self.children: list[list[int]] = []  # of inner nodes: node number, or -1 - leaf
        self.centres: list[np.ndarray] = []
        self.leaves = 0
        self.root = self._grow(x, branch, leaf_rows)
        self.weights = [(c[:, : self.dim], (c**2).sum(1)) for c in self.centres]

    def _grow(self, x: np.ndarray, branch: int, leaf_rows: int) -> int:
        if len(x) > leaf_rows:
            centres, own = kmeans(x, branch, seed=len(self.children))
            if len(centres) > 1 and np.bincount(own).max() < len(x):
                at = len(self.children)
                self.children.append([])
                self.centres.append(centres)
                self.children[at] = [self._grow(x[own == i], branch, leaf_rows) if (own == i).any() else self._leaf() for i in range(len(centres))]
                return at
        return self._leaf()

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate, so that all lengths equal the sample's greatest."""
        return np.hstack([x, np.sqrt(np.maximum(0, self.reach**2 - (x**2).sum(1)))[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node."""
        y, leaf = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            c = self.centres[node]
            own = ((c**2).sum(1) - 2 * y[rows] @ c.T).argmin(1)
            todo += [(child, rows[own == i]) for i, child in enumerate(self.children[node]) if (own == i).any()]
        return leaf

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves, best bin first."""
        heap, out = [(0.0, self.root)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-1 - node)
                continue
            centres, square = self.weights[node]
            for d, child in zip((square - 2 * centres @ q).tolist(), self.children[node], strict=True):
                heapq.heappush(heap, (d, child))
        return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v")).where(F.col(id_col).isNotNull() & v.isNotNull() & fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def best(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, rough: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and exact scores of the rows (among them, those marked); rough scores only leave out what cannot be among them."""
    may = np.flatnonzero(ids != own) if among is None else np.flatnonzero(among & (ids != own))
    if len(may) > k:
        r = rough[may]
        low = np.partition(r, len(r) - k)[len(r) - k]
        may = may[r >= low - 1e-9 * (1 + abs(low))]
    score = (x[may] * q).sum(axis=1)
    order = np.lexsort((ids[may], -score))[:k]
    return ids[may][order], score[order]


def exact(indexed: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): exact neighbours of a bounded list of queries among all rows, scanned in blocks."""
    q_ids, q = [i for i, _ in queries], np.stack([v for _, v in queries])

    def scan(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _arrow_matrix(batch.column(2))
            rough, leaf_of = q @ x.T, dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            rows = [(i, v, s) for n, i in enumerate(q_ids) for v, s in zip(*(a.tolist() for a in best(ids, x, i, q[n], rough[n], k)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([leaf_of[r[1]] for r in rows], pa.int64())], ["query_id", "vec_id", "score", "leaf"])

    return top(indexed.select("vec_id", "leaf", "v").mapInArrow(scan, "query_id bigint, vec_id bigint, score double, leaf bigint"), k)


def top(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, sample: int = SAMPLE, calibrate: int = CALIBRATE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query, the rows whose id is divisible by `every`, among all other rows."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    chosen = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample).select("v").toArrow()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not chosen.num_rows:
        return empty
    tree = Tree(_arrow_matrix(chosen["v"].combine_chunks()))

    def deal(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.assign(_arrow_matrix(batch.column(1)))), batch.column(1)], ["vec_id", "leaf", "v"])

    indexed = written(rows.select("vec_id", "v").mapInArrow(deal, "vec_id bigint, leaf bigint, v array<double>"), "nearest-index")
    asked = indexed.where(F.col("vec_id") % every == 0)
    trial = asked.orderBy(F.xxhash64(F.lit(2), "vec_id"), "vec_id").limit(calibrate).select("vec_id", "v").collect()
    if not trial:
        return empty
    trial = [(r["vec_id"], np.array(r["v"], float)) for r in trial]
    truth: dict[int, list[int]] = {}
    for r in exact(indexed, trial, k).select("query_id", "leaf").collect():  # at most calibrate * k rows
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    place = [{leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for _, v in trial]
    needed = np.sort([place[n][leaf] + 1 for n, (i, _) in enumerate(trial) for leaf in truth.get(i, [])])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else tree.leaves

    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row for each leaf, at most SAMPLE
        sizes[r["leaf"]] = r["count"]
    at, per = np.cumsum(sizes) - sizes, BLOCK_ROWS
    queries = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))  # of rows that share an id the least vector asks
    slices = max(1, -(-queries.count() // per))
    layout = spark.createDataFrame(list(zip(range(tree.leaves), at.tolist(), sizes.tolist(), strict=True)), "leaf bigint, at bigint, n bigint").where("n > 0")
    block = F.expr(f"(at + pmod(xxhash64(vec_id), n)) div {per}")
    dealt = indexed.join(F.broadcast(layout), "leaf").select("leaf", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "vec_id", "v")

    def walk(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, q_of, blocks, leaves = [], _arrow_matrix(batch.column(1)), [], []
            for i, q in enumerate(q_of):
                own = np.array(tree.visit(q, visits), np.int64)
                own = own[sizes[own] > 0]
                first = at[own] // per
                several = (at[own] + sizes[own] - 1) // per - first + 1
                place = np.repeat(first, several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                order = np.argsort(place, kind="stable")
                own, place = np.repeat(own, several)[order], place[order]
                cuts = np.flatnonzero(np.diff(place)) + 1
                begin = np.concatenate([[0], cuts]) if len(place) else cuts
                blocks.append(place[begin]), leaves.extend(np.split(own.astype(np.int32), cuts) if len(place) else []), rows.append(np.full(len(begin), i))
            n = np.concatenate(rows)
            ends = np.cumsum([0, *map(len, leaves)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *leaves])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(n)), pa.array(np.concatenate(blocks)), batch.column(1).take(pa.array(n)), lists], ["query_id", "block", "q", "leaves"])

    visited = queries.mapInArrow(walk, "query_id bigint, block bigint, q array<double>, leaves array<int>").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(left) and len(right):
            ids, x, q, asking = left["vec_id"].to_numpy(), _matrix(left["v"]), _matrix(right["q"]), right["query_id"].to_numpy()
            here, leaf = np.unique(left["leaf"].to_numpy(), return_inverse=True)
            for n, leaves in enumerate(right["leaves"]):
                if n % 256 == 0:
                    rough = q[n : n + 256] @ x.T
                among = np.isin(here, leaves)[leaf]
                found, score = best(ids, x, int(asking[n]), q[n], rough[n % 256], k, among)
                for column, v in zip(out, (np.full(len(found), asking[n]), found, score), strict=True):
                    column.append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    pairs = dealt.groupBy("block", "slice").cogroup(visited.groupBy("block", "slice"))
    return top(pairs.applyInPandas(match, "query_id bigint, vec_id bigint, score double"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
