"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of high quality that are not held out; all documents are the unlabelled web text, and no
negative label is read. A text becomes about twenty shape measures, which are written once for all rows; means and scales are those of all rows. Two first
networks, each fitted to one half, tell positives from unlabelled rows; the class prior is the least ratio of the unlabelled to the positive tail above a threshold, counted over
all rows of the other half. A last network then minimises the non-negative unbiased risk: prior * positive loss plus max(0, unlabelled negative loss - prior * positive
negative loss). It is begun on START rows, by a hash of the id, and then descends the risk of all unlabelled rows for ROUNDS rounds, each one pass over the measures whose
gradients are summed by Spark. Labelled positives are at most MAX_POSITIVE, by a hash of the id.

Defined results: null text counts as empty, and empty texts are scored like any other; equal texts get equal scores; without
positives every score is 0.5; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import crc_of_id, giving_back, written
from evirank.llm.toxicity import sample_labelled

MAX_POSITIVE, START, ROUNDS, HIDDEN, STEPS, REMEMBER = 6_000, 12_000, 8, 12, 600, 100_000
#: Weight decay of the last network: with less, a prior that is a little too high costs much accuracy on small tables.
DECAY = 5e-3
KINDS = "lcudnmshopx"
_TAIL = re.compile(r"[.,;:!?)\]\"'»”]$")


def kind_of(piece: str) -> str:
    """One letter for the shape of a space-delimited piece."""
    core = _TAIL.sub("", piece, count=1)
    if not core:
        return "p"  # a lone mark
    if len(core) > 30:
        return "x"
    if core.isalpha():
        if core.islower():
            return "s" if len(core) <= 3 else "l"
        if core.isupper() and len(core) > 1:
            return "u"
        return "c" if core[1:].islower() or len(core) == 1 else "m"
    if core.isdigit():
        return "d"
    if core.isalnum():
        return "n"
    if not any(map(str.isalnum, core)):
        return "o"  # symbols only
    return "h"  # letters with other signs inside or after


class Shapes:
    """Measures of a text from the shapes of its pieces and from its lines."""

    width = len(KINDS) + 10

    def __init__(self):
        self.kinds: dict[str, str] = {}

    def measure(self, text: str) -> list[float]:
        pieces = text.split()
        n = len(pieces)
        if len(self.kinds) > REMEMBER:
            self.kinds.clear()
        distinct = set(pieces)
        for p in filterfalse(self.kinds.__contains__, distinct):
            self.kinds[p] = kind_of(p)
        said = "".join(map(self.kinds.__getitem__, pieces))
        lines = [x for x in text.split("\n") if x]
        k = len(lines)
        d = max(1, n)
        stops, commas = text.count(".") + text.count("?") + text.count("!"), text.count(",")
        return [
            *(said.count(c) / d for c in KINDS), math.log1p(len(text)), math.log1p(n), len(text) / d, len(distinct) / d, math.log1p(k), (k - len(set(lines))) / max(1, k),
            len(max(lines, key=len)) / max(1, len(text)) if lines else 0.0, stops / d, commas / d, sum(map(str.isupper, text)) / max(1, len(text)),
        ]


@dataclass
class Network:
    """One hidden layer over standardised measures."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    shapes: Shapes = field(default_factory=Shapes)

    def __getstate__(self):
        return self.__dict__ | {"shapes": Shapes()}

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.probabilities(np.array([self.shapes.measure(t) for t in texts]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def minimise(xp: np.ndarray, xu: np.ndarray, prior: float | None, hidden: int = HIDDEN, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4, norm: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
    """Adam on the non-negative risk with this prior; without one, on plain positive-against-unlabelled logistic loss. norm: means and scales of the measures."""
    both = np.concatenate([xp, xu])
    mean, scale = norm or (both.mean(0), both.std(0) + 1e-6)
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (xp, xu))
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        hp, hu = np.tanh(zp @ p[0] + p[1]), np.tanh(zu @ p[0] + p[1])
        gp, gu = hp @ p[2] + p[3], hu @ p[2] + p[3]
        sp, su = sigmoid(gp), sigmoid(gu)
        if prior is None:
            dp, du = (sp - 1) / len(gp) / 2, su / len(gu) / 2
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp, du = (prior * (sp - 1) - prior * sp) / len(gp), su / len(gu)
            else:  # the unbiased risk went below zero: step back along it
                dp, du = prior * sp / len(gp), -su / len(gu)
        grads = [np.zeros_like(x) for x in p]
        for z, h, d in ((zp, hp, dp), (zu, hu, du)):
            back = d[:, None] * p[2] * (1 - h * h)
            for g, add in zip(grads, (z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])), strict=True):
                g += add
        for i in range(4):
            grads[i] += decay * p[i]
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def thresholds(positive: np.ndarray, least_tail: float = 0.5) -> np.ndarray:
    """Scores above which tails are compared: only tails with at least least_tail of the positives, so that small ones do not pull the least ratio down."""
    return np.unique(np.quantile(positive, np.linspace(0.005, 1 - least_tail, 60)))


def prior_of_tails(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, rows: int) -> float:
    """The share of positives among unlabelled scores, of which above[i] of `rows` reach cuts[i].

    Above any threshold the unlabelled tail is at least the prior times the positive tail, so the least ratio of the tails is an upper bound that
    is met where no negatives are left. One standard error is added to each ratio.
    """
    ratios = []
    for c, n in zip(cuts, above, strict=True):
        p, u = float((positive >= c).mean()), n / max(1, rows)
        if p and u:
            error = math.sqrt((1 - u) / (u * rows) + (1 - p) / (p * len(positive)))
            ratios.append(u / p * (1 + error))
    return float(min(max(min(ratios, default=0.5), 0.02), 0.98))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least_tail: float = 0.5) -> float:
    """prior_of_tails of scores that are all at hand."""
    cuts = thresholds(positive, least_tail)
    return prior_of_tails(positive, cuts, np.array([(unlabelled >= c).sum() for c in cuts]), len(unlabelled))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, Shapes.width)


def measured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, x): the measures of every row, in storage."""

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            x = pa.array([shapes.measure(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    return written(documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), "id bigint, x array<double>"), "quality-measures")


def _summed(rows: DataFrame, of) -> np.ndarray:
    """The sum over all rows of the vector that `of` makes of a matrix of measures and the rows' halves; partial sums are added up by Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = of(_rows(batch), batch.column("half").to_numpy())
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    parts = rows.select("x", "half").mapInArrow(giving_back(run), "v array<double>").select(F.posexplode("v").alias("at", "v"))
    return np.array([r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()])  # a few hundred numbers


def descended(network: Network, rows: DataFrame, n: int, xp: np.ndarray, prior: float, rounds: int = ROUNDS, rate: float = 0.05, decay: float = DECAY) -> Network:
    """The network after steps down the risk of all unlabelled rows, by the rule of `minimise`: where the unbiased risk is below zero a step goes back along it."""
    zp = np.clip((xp - network.mean) / network.scale, -8, 8)
    shape = network.w1.shape

    def unpacked(v: np.ndarray) -> tuple:
        k = shape[0] * shape[1]
        return v[:k].reshape(shape), v[k : k + shape[1]], v[k + shape[1] : k + 2 * shape[1]], v[-1]

    def parts(v: np.ndarray, z: np.ndarray, loss, slope) -> tuple[float, np.ndarray]:
        """Summed loss of the logits and its gradient."""
        w1, b1, w2, b2 = unpacked(v)
        h = np.tanh(z @ w1 + b1)
        g = h @ w2 + b2
        d = slope(g)
        back = d[:, None] * w2 * (1 - h * h)
        return float(loss(g).sum()), np.concatenate([(z.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]])

    as_negative, as_positive = (lambda g: np.logaddexp(0, g), sigmoid), (lambda g: np.logaddexp(0, -g), lambda g: sigmoid(g) - 1)
    mean, scale = network.mean, network.scale

    at = np.concatenate([network.w1.ravel(), network.b1, network.w2, [network.b2]])
    for _ in range(rounds):
        def of(x, _, now=at):
            loss, grad = parts(now, np.clip((x - mean) / scale, -8, 8), *as_negative)
            return np.concatenate([[loss], grad])

        u = _summed(rows, of) / n
        (_, own), (other, other_grad) = parts(at, zp, *as_positive), parts(at, zp, *as_negative)
        rest = u[1:] - prior * other_grad / len(zp)
        grad = prior * own / len(zp) + rest if u[0] >= prior * other / len(zp) else -rest
        at = at - rate * (grad + decay * at)
    w1, b1, w2, b2 = unpacked(at)
    return Network(mean, scale, w1, b1, w2, float(b2))


def train(documents: DataFrame, labels: DataFrame, held_out, rows: DataFrame) -> tuple[Network | None, float]:
    """rows: the measures of all documents."""
    chosen, _ = sample_labelled(documents, labels, "quality", ~held_out, {1: MAX_POSITIVE})

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shapes.measure(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "x"])

    positives = chosen.select(F.col("id").cast("bigint"), "text").mapInArrow(giving_back(run), "id bigint, x array<double>").toArrow().sort_by([("id", "ascending")])
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(2)).cast("int"))
    stats = rows.agg(F.count("*"), *(f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(Shapes.width))).first()
    n = stats[0]
    xp = np.array(positives["x"].to_pylist(), float).reshape(-1, Shapes.width)
    if not n or not len(xp):
        return None, 0.5
    norm = np.array(stats[1 : Shapes.width + 1], float), np.array(stats[Shapes.width + 1 :], float) + 1e-6
    start = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id", "x").limit(START).toArrow()
    xu, half = np.array(start["x"].to_pylist(), float).reshape(-1, Shapes.width), start["half"].to_numpy()
    prior = 0.5
    if len(xp) > 1 and 0 < half.sum() < len(half):
        first = [minimise(xp[k::2], xu[half == k], None, hidden=6, steps=STEPS // 4, decay=1e-3, norm=norm) for k in (0, 1)]
        scores = [first[k].logits(xp[1 - k :: 2]) for k in (0, 1)]
        cuts = [thresholds(s) for s in scores]

        def tails(x, half_of):
            out = []
            for k in (0, 1):
                g = np.sort(first[k].logits(x[half_of == 1 - k]))
                out += [[len(g)], len(g) - np.searchsorted(g, cuts[k], "left")]
            return np.concatenate(out).astype(float)

        counts = _summed(rows, tails)
        ends = [1 + len(cuts[0]), 2 + len(cuts[0]) + len(cuts[1])]
        prior = float(np.mean([prior_of_tails(scores[k], cuts[k], counts[ends[k] - len(cuts[k]) : ends[k]], int(counts[ends[k] - len(cuts[k]) - 1])) for k in (0, 1)]))
    return descended(minimise(xp, xu, prior, decay=DECAY, norm=norm), rows, n, xp, prior), prior


def classify(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    held_out = crc_of_id() % 4 == 2
    rows = measured(documents)
    network, _ = train(documents, labels, held_out, rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(batch.num_rows, 0.5) if network is None else network.probabilities(_rows(batch)))], ["doc_id", "score"])

    score = rows.mapInArrow(run, "doc_id bigint, score double")
    return score.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of documents that score at least `least`, with all their columns."""
    network, _ = train(documents, labels, crc_of_id() % 4 == 2, measured(documents, text_col))
    if network is None:
        return documents.where(F.lit(least <= 0.5))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(network.scores([x or "" for x in text.to_pylist()]), pa.float64())

    return documents.where(score(F.col(text_col)) >= least)
