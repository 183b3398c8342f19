"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Learning. Document frequencies are counted over all training rows (id not held out, language known). The weights are
fitted on a bounded sample of them, at most `per_language` rows of each language and `most_rows` in all, chosen by
hash of the id; the optimiser is follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties. A fifth of
the sample is kept out of the fit and sets the temperature that calibrates the probabilities.

Rejection. A softmax over the learned languages says which of them a text is nearest to, not that it is in any: its
largest value is never below one over their number. So the n-grams of each language's fitted rows are remembered, and
a text is known if enough of its n-grams are among those of its two likeliest languages (two, as texts may mix them).
How many is enough is set for each language from the kept-out rows: up to twice the highest share of unknown n-grams
there passes, and a tenth always, or half of all n-grams where fewer than FEW rows were kept out; a language with fewer than FEW fitted rows
lets any share pass. Short texts get the benefit of BENEFIT known n-grams.

Prediction reads the text only. Defined results: a null text or one without a letter is 'und' with score 0; equal
texts get equal results; ties go to the first language in alphabetical order; without any training row every text is
'und'; languages beyond the `most_languages` most frequent are not learned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.arrow_text import chunks
from stepframe.llm.features import ngram_counts, sparse_batch

BITS = 15
UNKNOWN = "und"
BENEFIT, FEW, MOST_ASKED = 32, 20, 0.9
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


class Ftrl:
    """FTRL-proximal for several outputs over the same sparse input."""

    def __init__(self, size: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((size, outputs)), np.zeros((size, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """weights: those of `at`, as weights(at) gave them."""
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    #: for each language, the n-grams of its fitted rows, and the least share of known n-grams of a text in it
    known: np.ndarray | None = None
    least_known: np.ndarray | None = None

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        norm = math.sqrt(float(x @ x))
        return x / norm if norm else x

    def share(self, at: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> float:
        """The share of n-grams that are known in one of two languages."""
        return (float(counts[self.known[pair][:, at].any(axis=0)].sum()) + BENEFIT) / (float(counts.sum()) + BENEFIT)

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether enough of its n-grams are known in its two likeliest languages."""
        lang, score, known = [], [], []
        for text, (at, counts) in zip(texts, ngram_counts(texts, BITS), strict=True):
            if not self.languages or not text or not LETTER.search(text):
                lang.append(UNKNOWN)
                score.append(0.0)
                known.append(False)
                continue
            p = softmax((self.vector(at, counts) @ self.weights[at] + self.bias) / self.temperature)
            k = int(p.argmax())
            lang.append(self.languages[k])
            score.append(float(p[k]))
            pair = np.argsort(-p, kind="stable")[:2]
            known.append(self.share(at, counts, pair) >= self.least_known[pair].min())
        return lang, score, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def fit(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, seed: int = 7) -> LanguageModel:
    """rows: (n-grams, counts, language number). Sets weights, bias, temperature and what is known."""
    rows = [r for r in rows if len(r[0])]
    data = [(at, model.vector(at, counts), y) for at, counts, y in rows]
    fitted, kept = [r for i, r in enumerate(data) if i % 5], data[::5]
    size = 1 << BITS
    ftrl = Ftrl(size + 1, len(model.languages))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(fitted)):
            at, x, y = fitted[i]
            at, x = np.append(at, size), np.append(x, 0.1)
            w = ftrl.weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            ftrl.learn(at, w, x[:, None] * p)
    w = ftrl.weights()
    model.weights, model.bias = w[:size].astype(np.float32), 0.1 * w[size]
    scores = np.array([x @ model.weights[at] + model.bias for at, x, _ in kept or fitted])
    truth = np.array([y for _, _, y in kept or fitted])

    def loss(log_t: float) -> float:
        p = softmax(scores / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    if len(truth):
        grid = np.linspace(math.log(0.02), math.log(20), 61)
        model.temperature = math.exp(min(grid, key=loss))
    model.known = np.zeros((len(model.languages), size), bool)
    learned = np.zeros(len(model.languages), np.int64)
    for at, _, y in (r for i, r in enumerate(rows) if i % 5):
        model.known[y, at] = True
        learned[y] += 1
    shares: list[list[float]] = [[] for _ in model.languages]
    for (at, counts, y), s in zip(rows[::5], scores, strict=False):
        shares[y].append(model.share(at, counts, np.argsort(-s, kind="stable")[:2]))
    # one kept-out row in 400 may be junk itself
    model.least_known = np.array([min(MOST_ASKED, 1 - 2 * (1 - sorted(s)[len(s) // 400])) if len(s) >= FEW else 0.5 if n >= FEW else 0.0 for s, n in zip(shares, learned, strict=True)])
    return model


def train(docs: DataFrame, per_language: int = 800, most_rows: int = 4000, most_languages: int = 200) -> LanguageModel:
    """Learn from the documents whose id is not held out and whose language is known."""
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counted = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    model = LanguageModel(sorted(r["lang"] for r in counted))
    if not counted:
        return model
    total = sum(r["count"] for r in counted)
    quota = max(1, min(per_language, most_rows // len(counted)))
    # rows under a hash threshold, a little more than the quota of each language; the rest is cut on the driver
    share = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND((1 << 30) - 1)
    chosen = F.lit(False)
    for r in counted:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (share < int(min(1.0, (quota + 4 * math.sqrt(quota) + 10) / r["count"]) * (1 << 30))))
    number = {lang: k for k, lang in enumerate(model.languages)}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            pairs = list(ngram_counts(b.column(2).to_pylist(), BITS))
            yield sparse_batch(["lang", "share"], [b.column(0), b.column(1)], [p[0] for p in pairs], [p[1] for p in pairs])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        for b in chunks(batches, "text"):
            for at, _ in ngram_counts(b.column(0).to_pylist(), BITS):
                df[at] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["gram", "df"])

    df = np.zeros(1 << BITS)
    # at most 2^BITS rows reach the driver
    for r in own.select("text").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r["gram"]] = r["df"]
    model.idf = np.log((1 + total) / (1 + df)) + 1
    rows = own.where(chosen).select("lang", share.alias("share"), "text").mapInArrow(sampled, "lang string, share long, at binary, counts binary").collect()
    rows.sort(key=lambda r: (r["share"], r["lang"], bytes(r["at"]), bytes(r["counts"])))
    taken, room = [], dict.fromkeys(model.languages, quota)
    for r in rows:
        if room[r["lang"]]:
            room[r["lang"]] -= 1
            taken.append((np.frombuffer(r["at"], ">i4").astype(np.int64), np.frombuffer(r["counts"], ">i4").astype(np.float64), number[r["lang"]]))
    return fit(model, taken)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            lang, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.25) -> DataFrame:
    """The rows of docs, all columns, that are in a learned language: enough n-grams are known, and the score is at least
    `least` and clear of chance (one over the number of languages) by a twentieth of what is left to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chance = 1 / max(1, len(model.languages))
    least = max(least, chance + (1 - chance) / 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            judged = shared.value.judge(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and s >= least and k for x, s, k in zip(*judged, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
