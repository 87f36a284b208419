"""Quality score by positive-unlabelled learning (operator 4).

Trusted positives are labelled documents of quality 1 outside the held-out fold; the unlabelled set is a sample of all documents; labels of
quality 0 are never used.  The class prior is estimated from the two score distributions (best-bin estimate: the smallest ratio of
unlabelled to positive mass above a threshold), and a classifier minimises the non-negative unbiased risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``.  Inputs are measures of the text alone, cut into bins at
quantiles of the training sample, so the classifier is additive and each measure may act in any shape.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text, bounded_sample
from forgeclock.shared import materialise

FOLDS = 5
MEASURES = 22


def measures(text: str) -> list[float]:
    """Length, case, symbols, repetition, word and line shape of the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES

    def count(characters: str) -> int:
        return sum(map(text.count, characters))

    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    triples = set(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(counts)
    letters = sum(len(w) * c for w, c in counts.items())
    shares = [c / n for c in counts.values()]
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    title = sum(c for w, c in counts.items() if w[0].isupper() and not w.isupper())
    bare = sum(c for w, c in counts.items() if not w[0].isalnum() and not any(map(str.isalnum, w)))
    closed = sum(c for w, c in counts.items() if w[-1] in ".!?")
    return [
        math.log1p(n),
        letters / n,
        upper / n,
        title / n,
        bare / n,
        closed / n,
        count("#*$%&|<>") / n,
        count("!?") / n,
        count(".,;:") / n,
        count("0123456789") / n,
        distinct / n,
        distinct / math.sqrt(n),
        max(shares),
        -sum(p * math.log(p) for p in shares),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - (len(pairs) + 1) / n,
        1 - (len(triples) + 2) / n if n > 2 else 0.0,
        math.log1p(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(len(w) <= 3 for w in counts) / distinct,
        max(map(len, counts)),
    ]


def text_measures():
    """Column function: text -> its measures."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([measures(t) for t in as_text(texts)], pa.list_(pa.float64()))

    return measure


@dataclass
class Model:
    """Bin borders per measure, one weight per bin, an intercept, and the class prior."""

    borders: list[np.ndarray]
    weights: list[np.ndarray]
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (borders, weights) in enumerate(zip(self.borders, self.weights)):
            total += weights[np.searchsorted(borders, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _one_hot(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    parts = []
    for j, b in enumerate(borders):
        part = np.zeros((len(x), len(b) + 1), np.float32)
        part[np.arange(len(x)), np.searchsorted(b, x[:, j], "right")] = 1
        parts.append(part)
    return np.hstack(parts)


def _descend(positive: np.ndarray, other: np.ndarray, prior: float | None, steps: int, decay: float) -> np.ndarray:
    """Adam on the non-negative risk, or on plain positive-against-unlabelled log loss without a prior.  Last weight: intercept."""
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def mean(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(x.T @ slope.astype(np.float32), slope.sum()) / len(x)

    for step in range(1, steps + 1):
        gp = 1 / (1 + np.exp(-(positive @ w[:-1].astype(np.float32) + w[-1])))
        gu = 1 / (1 + np.exp(-(other @ w[:-1].astype(np.float32) + w[-1])))
        if prior is None:
            grad = mean(positive, gp - 1) + mean(other, gu)
        else:
            rest = -np.log1p(-np.minimum(gu, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(gp, 1 - 1e-7)).mean()
            negative = mean(other, gu) - prior * mean(positive, gp)
            grad = prior * mean(positive, gp - 1) + negative if rest >= 0 else -negative
        grad += decay * w
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def estimate_prior(positive: np.ndarray, other: np.ndarray, least: float = 0.3) -> float:
    """Smallest ratio of unlabelled to positive mass above a threshold that keeps at least ``least`` of the positives.

    Above a good threshold only positives are left, so the ratio is the prior; a standard error is taken off, since too high a prior
    keeps the risk from pushing negatives down, while one slightly low costs little.
    """
    at = np.unique(positive)
    qp = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    qu = 1 - np.searchsorted(np.sort(other), at) / len(other)
    at_least = qp >= least
    qp, qu = qp[at_least], qu[at_least]
    ratio = qu / qp
    error = ratio * np.sqrt((1 - qu) / np.maximum(qu * len(other), 1) + (1 - qp) / np.maximum(qp * len(positive), 1))
    return float(np.clip((ratio - error).min(), 0.01, 0.99))


def fit(positive: np.ndarray, other: np.ndarray, bins: int = 12, steps: int = 800) -> Model:
    """Borders at quantiles of the unlabelled sample; the prior comes from scores of the half that the first fit did not see."""
    if len(positive) < 10 or len(other) < 10:
        return Model([], [], 0.0, 0.5)
    shares = np.arange(1, bins) / bins
    shares = np.concatenate([[0.01, 0.03], shares, [0.97, 0.99]])
    borders = [np.unique(np.quantile(other[:, j], shares)) for j in range(other.shape[1])]
    p, u = _one_hot(positive, borders), _one_hot(other, borders)
    first = _descend(p[::2], u[::2], None, steps // 2, 1e-3)
    prior = estimate_prior(p[1::2] @ first[:-1], u[1::2] @ first[:-1])
    w = _descend(p, u, prior, steps, 1e-4)
    cuts = np.cumsum([len(b) + 1 for b in borders])[:-1]
    return Model(borders, np.split(w[:-1], cuts), float(w[-1]), prior)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Model:
    """Fit on at most about ``most`` trusted positives and ``most`` unlabelled documents, both chosen by a hash of doc_id.

    Ids in the held-out fold and null ids give no labels.  Several labels for one id: the lowest quality counts.
    """
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted = materialise(trusted.where("q = 1").where(~held_out(F.col("doc_id"))).select("doc_id"), "trusted")
    known = materialise(bounded_sample(trusted, "doc_id", most, 11), "positives")  # bounded by ``most``
    of_all = bounded_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", most, 13)
    web = materialise(of_all, "unlabelled")
    chosen = known.withColumn("known", F.lit(1)).unionByName(web.withColumn("known", F.lit(0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "known").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", "known", text_measures()("text").alias("m")).toPandas().sort_values(["known", "doc_id"], kind="stable")
    x = np.array(found["m"].tolist(), np.float64).reshape(-1, MEASURES)
    of = found["known"].to_numpy() == 1
    return fit(x[of], x[~of])


def quality(model: Model):
    """Column function: text -> score in [0, 1]."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([measures(t) for t in as_text(texts)], np.float64).reshape(-1, MEASURES)
        return pa.array(model.score(x))

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(row, held_out, score, predicted): each row as a struct with its score.

    Null and empty texts: all measures are zero, and they are scored like any other.  Without training rows every score is 0.5.  Null
    ids are not held out.  Repeated rows stay.
    """
    rows = docs.select(F.struct("*").alias("row")).withColumn("score", quality(model)(F.col("row.text")))
    fold = F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out")
    return rows.select("row", fold, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
