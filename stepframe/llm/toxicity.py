"""Toxicity: cumulative-link (proportional-odds) ordinal regression over sparse hashed words and word prefixes.

Grades. Labels tell toxic documents from others. Grade 0 is not toxic; toxic documents are graded 1 to GRADES by how
much toxic wording they hold: the damped count of their features that are far more common in toxic training documents,
cut at the quantiles of the training sample. One weight vector serves all thresholds: P(grade > k) = sigmoid(w.x - t_k),
t_0 < t_1 < ..., so severity is the sum of these chances (the expected grade). A document is toxic when P(grade > 0)
reaches the model's cut, the chance that parts the training sample best with false alarms weighed FALSE_ALARM times.
Near copies of a sampled document (same four smallest feature hashes) count once in learning.

Learning is on a bounded sample of labelled documents, at most `per_class` of each class by hash of the id; scoring
reads whole texts. Defined results: a null or empty text, or any text when there are no labels of both classes, has
severity 0 and is not toxic; equal texts get equal results; of several labels of one document the most toxic counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.arrow_text import chunks
from stepframe.llm.features import word_counts
from stepframe.llm.langid import Ftrl

#: Features are BITS-bit hashes, too many for chance clashes with a marked word to matter; weights are kept sparse.
BITS, GRADES = 40, 3
#: A feature enters the regression if its G statistic (chi-square, 1 degree of freedom) for being more common in toxic
#: documents is above this; among some millions of features, fewer than one passes by chance.
LEAST_G = 28.0
FALSE_ALARM = 5.0


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


@dataclass
class SeverityModel:
    """Sparse weights (sorted feature numbers and their values) and ascending thresholds; no thresholds: nothing learned."""

    features: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def chances(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        if not len(self.thresholds):
            return np.zeros(GRADES)
        pos = np.minimum(np.searchsorted(self.features, at), max(len(self.features) - 1, 0))
        eta = 0.0
        if len(self.features):
            hit = self.features[pos] == at
            eta = float(self.values[pos[hit]] @ (1 + np.log(counts[hit])))
        return sigmoid(eta - self.thresholds)

    def predict(self, texts: list[str | None]) -> list[tuple[float, float, int]]:
        """(severity, chance of being toxic, most likely grade) of each text."""
        out = []
        for at, counts, words in word_counts(texts, BITS):
            if not words:
                out.append((0.0, 0.0, 0))
                continue
            p = self.chances(at, counts)
            each = -np.diff(np.concatenate([[1.0], p, [0.0]]))
            out.append((float(p.sum()), float(p[0]), int(each.argmax())))
        return out


NOTHING = SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def associated(rows: list[tuple[np.ndarray, np.ndarray, int, bool]]) -> np.ndarray:
    """The features that are significantly more common in toxic rows, ascending."""
    sides = []
    for flag in (True, False):
        own = [r[0] for r in rows if r[3] == flag]
        sides.append((np.unique(np.concatenate(own), return_counts=True), len(own)))
    ((feature, a), n1), ((other, b), n0) = sides
    pos = np.minimum(np.searchsorted(other, feature), max(len(other) - 1, 0))
    b = np.where(other[pos] == feature, b[pos], 0) if len(other) else np.zeros(len(feature))
    a, b = a.astype(float), b.astype(float)
    share = (a + b) / (n1 + n0)

    def part(seen, wanted):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(wanted, 1e-9)), 0.0)

    g = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    return feature[(g > LEAST_G) & (a / n1 > 4 * b / n0)]


def grade(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], grades: int = GRADES) -> np.ndarray:
    """Severity grades of (marked features, counts, words, toxic) rows."""
    strength = np.array([float((1 + np.log(c)).sum()) if t else 0.0 for _, c, _, t in rows])
    toxic = np.array([r[3] for r in rows])
    cuts = np.quantile(strength[toxic], np.arange(1, grades) / grades)
    return np.where(toxic, 1 + np.searchsorted(cuts, strength, side="right"), 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], epochs: int = 20, seed: int = 11, grades: int = GRADES) -> SeverityModel:
    flags = [r[3] for r in rows]
    if not any(flags) or all(flags):
        return NOTHING
    features = associated(rows)
    marked = []
    for at, c, w, toxic in rows:
        own, here, there = np.intersect1d(features, at, assume_unique=True, return_indices=True)
        marked.append((here, c[there], w, toxic))
    y = grade(marked, grades)
    share = np.array([(y > k).mean() for k in range(grades)])
    t = -np.log(np.maximum(share, 1e-3) / np.maximum(1 - share, 1e-3))
    t = np.maximum.accumulate(t + np.arange(grades) * 1e-3)
    ftrl = Ftrl(len(features), 1, alpha=1.0, l1=0.02, l2=0.002)
    order = np.random.default_rng(seed)
    data = [(a, 1 + np.log(c)) for a, c, _, _ in marked]
    for epoch in range(epochs):
        for i in order.permutation(len(data)):
            at, x = data[i]
            w = ftrl.weights(at)
            eta = float(x @ w[:, 0])
            above = np.concatenate([[1.0], sigmoid(eta - t), [0.0]])
            k = int(y[i])
            # negative log-likelihood of P(grade > k-1) - P(grade > k)
            slope = above[k] + above[k + 1] - 1
            ftrl.learn(at, w, (slope * x)[:, None])
            p = max(above[k] - above[k + 1], 1e-6)
            rate = 0.2 / (1 + epoch)
            if k > 0:
                t[k - 1] -= rate * min(5.0, above[k] * (1 - above[k]) / p)
            if k < grades:
                t[k] += rate * min(5.0, above[k + 1] * (1 - above[k + 1]) / p)
            t = np.maximum.accumulate(np.maximum(t, t[0] + np.arange(grades) * 0.05))
    w = ftrl.weights()[:, 0]
    at = np.flatnonzero(w)
    model = SeverityModel(features[at], w[at], t)
    chance = np.array([model.chances(r[0], r[1])[0] for r in rows])
    toxic = np.array(flags)
    cuts = np.arange(10, 2, -1) / 20
    model.cut = float(max(cuts, key=lambda c: (chance[toxic] >= c).mean() - FALSE_ALARM * (chance[~toxic] >= c).mean()))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> SeverityModel:
    """Learn from a bounded sample of the labelled documents."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["toxic"].cast("int") > 0).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.withColumn("share", F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return NOTHING
    limit = {flag: int(min(1.0, (per_class + 4 * math.sqrt(per_class)) / count) * (1 << 30)) for flag, count in n.items()}
    sample = known.where(F.col("share") < F.when(F.col("toxic"), limit[True]).otherwise(limit[False]))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = list(word_counts(b.column(3).to_pylist(), BITS))
            lists = [pa.array([g[k].astype(kind).tobytes() for g in got], pa.binary()) for k, kind in ((0, np.int64), (1, np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([g[2] for g in got], pa.int64()), *lists], names=["doc_id", "toxic", "share", "words", "at", "counts"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # the sample has at most about 2 * per_class rows
    rows = own.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "share", "text").mapInArrow(featured, "doc_id long, toxic boolean, share long, words long, at binary, counts binary").collect()
    rows.sort(key=lambda r: (r["share"], r["doc_id"], not r["toxic"], bytes(r["at"])))
    taken, room, seen = [], {True: per_class, False: per_class}, set()
    for r in rows:
        at = np.frombuffer(r["at"], np.int64)
        same = {r["doc_id"], tuple(at[:4])}
        if r["words"] and room[r["toxic"]] and not same & seen:
            seen |= same
            room[r["toxic"]] -= 1
            taken.append((at, np.frombuffer(r["counts"], np.int32).astype(float), r["words"], r["toxic"]))
    return fit(taken)


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, severity, chance, grade, toxic of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as the bounded sample has marked features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = shared.value.predict(b.column(1).to_pylist())
            cols = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[1] >= shared.value.cut for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "severity", "chance", "grade", "toxic"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, chance double, grade long, toxic boolean")


def keep_clean(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            got = shared.value.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([g[1] < shared.value.cut for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
