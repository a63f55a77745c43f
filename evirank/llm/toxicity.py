"""Toxicity by a counterfactually regularised linear classifier over the presence of words and of their beginnings.

The fit takes a bounded sample of labelled rows (MAX_POSITIVE and MAX_NEGATIVE, by a hash of the id), never held-out ones. Its features are the
MAX_WORDS words and beginnings that part the classes of the sample best, out of those in at least MIN_POSITIVE_TEXTS of its positive texts; words that only
calm texts hold speak through the intercept.
Each sampled text that names identity terms is swapped: every such term becomes the next of its group. The loss is the
logistic loss, plus CF_WEIGHT times the squared change of the score under the swap, plus an L1 penalty; it is minimised by
accelerated proximal gradient steps. So a term that merely names a group cannot move a score by itself, whatever it
co-occurred with. Only kept words carry weight, so a score is one pass over a text.

Defined results: null and empty texts get the intercept's score; equal texts get equal scores; labels whose toxic is null
are not used; without labels of both kinds every score is the share of positives (0.5 if there are no labels); extra columns
are dropped.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import crc_of_id

MAX_POSITIVE, MAX_NEGATIVE, MAX_WORDS, MIN_POSITIVE_TEXTS = 2_000, 4_000, 6_000, 4
L1, CF_WEIGHT, STEPS, REMEMBER = 3e-4, 1.0, 250, 100_000
BEGINNINGS = (3, 4, 5, 6)
#: Groups of terms that may be exchanged for one another in a neutral sentence. A parameter of the fit.
IDENTITY_GROUPS = (
    ("he", "she", "they"), ("him", "her", "them"), ("man", "woman", "person"), ("men", "women", "people"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("deaf", "blind", "disabled", "healthy"), ("old", "young"), ("immigrant", "refugee", "citizen"),
    ("mann", "frau", "person"), ("männer", "frauen", "leute"), ("christ", "muslimin", "jude", "hinduist", "buddhist"), ("schwarze", "weiße", "asiaten", "araber"), ("schwule", "lesben", "heterosexuelle"), ("einwanderer", "flüchtling", "bürger"),
    ("homme", "femme", "personne"), ("hommes", "femmes", "gens"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("noirs", "blancs", "asiatiques", "arabes"), ("gays", "lesbiennes", "hétérosexuels"), ("immigré", "réfugié", "citoyen"),
    ("hombre", "mujer", "persona"), ("hombres", "mujeres", "gente"), ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"), ("negros", "blancos", "asiáticos", "árabes"), ("homosexuales", "lesbianas", "heterosexuales"), ("inmigrante", "refugiado", "ciudadano"),
)
_WORD = re.compile(r"[^\W_]+")


def swaps(groups=IDENTITY_GROUPS) -> dict[str, str]:
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def words_in(text: str) -> set[str]:
    return {w for piece in set(text.split()) for w in _WORD.findall(piece.lower())}


def features_of(word: str) -> list[str]:
    """The word, and its beginnings, which inflected forms share."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    remembered: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "intercept": self.intercept, "remembered": {}}

    def logit(self, text: str) -> float:
        """Intercept plus the weights of the distinct known words."""
        pieces = set(text.split())
        if len(self.remembered) > REMEMBER:
            self.remembered.clear()
        for p in filterfalse(self.remembered.__contains__, pieces):
            self.remembered[p] = tuple(f for w in _WORD.findall(p.lower()) for f in features_of(w) if f in self.weights)
        found = set(map(self.remembered.__getitem__, pieces))
        return self.intercept + math.fsum(sorted(self.weights[w] for w in {w for ws in found for w in ws}))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(text)))))


class Rows:
    """Sparse rows of (columns, values) for matrix products by bincount."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c, _ in rows])
        self.col = np.concatenate([c for c, _ in rows]) if rows else np.empty(0, np.int32)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.empty(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def curvature(rows: Rows, balance: np.ndarray, cf: Rows, cf_weight: float, rounds: int = 20) -> float:
    """An upper estimate of the loss's greatest curvature, by power iteration over weights and intercept."""
    v, b, size = np.full(rows.width, 1.0), 1.0, 1.0
    for _ in range(rounds):
        scale = math.sqrt(float(v @ v) + b * b)
        v, b = v / scale, b / scale
        out = balance * (rows.dot(v) + b) / 4
        v, b = rows.back(out) + (2 * cf_weight / cf.n * cf.back(cf.dot(v)) if cf.n else 0.0), float(out.sum())
        size = math.sqrt(float(v @ v) + b * b)
    return 1.2 * size + 1e-12


def fit(texts: list[set[str]], labels: list[int], share: float | None = None, groups=IDENTITY_GROUPS, cf_weight: float = CF_WEIGHT, l1: float = L1, steps: int = STEPS) -> Model:
    """Fit on word sets. share: the share of positives, which is the score where there is nothing to learn from.

    The intercept is set so that 0.5 is the cut with the best F1 on the sample.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = share if share is not None else (float(y.mean()) if len(y) else 0.5)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, math.log(share / (1 - share)))
    swap = swaps(groups)
    seen: Counter[str] = Counter()
    for words, t in zip(texts, labels, strict=True):
        if t:
            seen.update({f for w in words for f in features_of(w)})
    seen = {f: n for f, n in seen.items() if n >= MIN_POSITIVE_TEXTS}
    calm: Counter[str] = Counter()
    for words, t in zip(texts, labels, strict=True):
        if not t:
            calm.update({f for w in words for f in features_of(w) if f in seen})
    many, few = y.sum(), (1 - y).sum()
    apart = {f: (n / many - calm[f] / few) / math.sqrt(n + calm[f]) for f, n in seen.items()}
    kept = sorted(seen, key=lambda f: (-apart[f], f))[:MAX_WORDS]
    index = {f: i for i, f in enumerate(dict.fromkeys([*kept, *(f for term in swap for f in features_of(term))]))}

    def row(plus: set[str], minus: set[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        columns = [sorted(index[f] for f in fs if f in index) for fs in (plus, minus)]
        return np.array(sum(columns, []), np.int32), np.repeat([1.0, -1.0], [len(c) for c in columns])

    made, change = [], []
    for words in texts:
        bag = {f for w in words for f in features_of(w)}
        made.append(row(bag))
        if own := words & swap.keys():
            swapped = {f for w in (words - own) | {swap[w] for w in own} for f in features_of(w)}
            change.append(row(swapped - bag, bag - swapped))
    rows = Rows(made, len(index))
    cf = Rows(change, len(index))
    balance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    step = 1 / curvature(rows, balance, cf, cf_weight)
    w, b = np.zeros(len(index)), 0.0
    wa, ba, t = w, b, 1.0
    for _ in range(steps):
        miss = balance * (1 / (1 + np.exp(-np.clip(rows.dot(wa) + ba, -40, 40))) - y)
        slope = rows.back(miss)
        if cf.n:
            slope += 2 * cf_weight / cf.n * cf.back(cf.dot(wa))
        new = wa - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - l1 * step, 0)
        b2 = ba - step * miss.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if float((wa - new) @ (new - w)) > 0:  # going uphill: begin the momentum anew
            t2 = 1.0
        wa, ba = new + (t - 1) / t2 * (new - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = new, b2, t2
    b -= best_cut(rows.dot(w) + b, y)
    return Model({k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-6}, float(b))


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1 when everything from it on is positive: half way to the next lower value."""
    order = np.argsort(-logits, kind="stable")
    hits, n, v = np.cumsum(y[order]), np.arange(1, len(y) + 1), logits[order]
    ends = np.flatnonzero(np.append(v[:-1] > v[1:], True))
    best = ends[np.argmax(2 * hits[ends] / (n[ends] + y.sum()))]
    return float((v[best] + v[best + 1]) / 2) if best + 1 < len(v) else float(v[best])


def counterfactual_gap(model: Model, texts: list[str], groups=IDENTITY_GROUPS) -> float:
    """Mean absolute change of the score when identity terms are swapped."""
    swap = swaps(groups)
    gaps = [abs(model.score(t) - model.score(_WORD.sub(lambda m: swap.get(m[0].lower(), m[0]), t))) for t in texts]
    return float(np.mean(gaps)) if gaps else 0.0


def sample_labelled(documents: DataFrame, labels: DataFrame, target: str, usable, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, target) of at most most[v] usable rows for each value v, by a hash of the id; and the usable rows by value."""
    own = labels.where(F.col(target).isNotNull() & usable).groupBy(F.col(id_col).alias("id")).agg(F.max(target).alias("target"))
    counts = {int(v): n for v, n in own.groupBy("target").count().collect()}
    parts = [own.where(F.col("target") == v).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(n) for v, n in most.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionAll(p)
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.join(F.broadcast(picked), "id"), counts  # picked has at most sum(most) rows


def train(documents: DataFrame, labels: DataFrame, held_out, **options) -> Model:
    """held_out: a condition over doc_id; rows for which it holds are not learned from."""
    rows, counts = sample_labelled(documents, labels, "toxic", ~held_out, {1: MAX_POSITIVE, 0: MAX_NEGATIVE})

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bags = ["\n".join(sorted(words_in(x or ""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.string()), batch.column(2).cast(pa.int64())], ["id", "bag", "target"])

    got = rows.select(F.col("id").cast("bigint"), "text", F.col("target").cast("bigint")).mapInArrow(run, "id bigint, bag string, target bigint").toArrow().sort_by([("id", "ascending"), ("bag", "ascending")])
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else None
    distinct = {xxhash.xxh3_128_digest(b.as_py()): i for i, b in enumerate(got["bag"])}  # copies of a text count once
    kept = got.take(pa.array(sorted(distinct.values()), pa.int64()))
    texts = [{sys.intern(w) for w in b.as_py().split("\n") if w} for b in kept["bag"]]
    return fit(texts, kept["target"].to_pylist(), share, **options)


_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def scored(documents: DataFrame, score, held_out, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply a picklable scorer (list of texts to list of scores) to each whole text."""

    def run(batches):
        for batch in batches:
            s = np.array(score([x or "" for x in batch.column(2).to_pylist()]), float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32), pa.int32())], [x.split()[0] for x in _SCORED.split(", ")])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, _SCORED)


def classify(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    held_out = crc_of_id() % 5 == 0
    model = train(documents, labels, held_out)
    return scored(documents, lambda texts: [model.score(x) for x in texts], held_out, least)
