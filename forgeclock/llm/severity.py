"""Toxicity severity by cumulative-link ordinal regression (operator 7).

Severity grades are ordered: 0 clean, 1 to ``GRADES - 1`` toxic with rising evidence.  The labels only say toxic or not, so
grades of toxic training texts come from how many features that lean to the toxic side they show, cut at its terciles.  One weight vector over
sparse text features is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k).  Features are words and their beginnings
(which survive inflection), hashed; the model keeps those that tell the classes apart in the training sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text, bounded_sample
from forgeclock.shared import discard, materialise

GRADES = 4
BITS = 22
BEGINNINGS = 4, 5
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and its beginnings."""
    parts = {f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)}
    return [xxhash.xxh64_intdigest(p.encode()) >> (64 - BITS) for p in parts]


def text_features():
    """Column function: text -> distinct feature hashes of the whole text."""

    @F.arrow_udf("array<int>")
    def extract(texts: pa.Array) -> pa.Array:
        seen, known = [], {}
        for text in as_text(texts):
            found = set()
            for w in set(WORD.findall(text.lower())):
                if w not in known:
                    known[w] = features(w)
                found.update(known[w])
            if len(known) > 400_000:
                known.clear()
            seen.append(sorted(found))
        return pa.array(seen, pa.list_(pa.int32()))

    return extract


@dataclass
class Model:
    """Weights by feature hash, and rising thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))


def _selected(seen: DataFrame, n1: int, n0: int, most: int) -> list[int]:
    """Features whose document shares differ most between the classes, in standard errors; seen in three texts at least.

    ``n1`` toxic and ``n0`` clean texts.  Features are counted on Spark, so only the chosen ones reach the driver.
    """
    counts = seen.select(F.col("toxic").cast("long").alias("toxic"), F.explode("seen").alias("id")).groupBy("id")
    counts = counts.agg(F.sum("toxic").alias("pos"), F.count("*").alias("many")).where("many >= 3")
    both = (F.col("many") + 1) / F.lit(n1 + n0 + 2)
    apart = F.abs(F.col("pos") / F.lit(n1) - (F.col("many") - F.col("pos")) / F.lit(n0))
    z = apart / F.sqrt(both * (1 - both) * F.lit(1 / n1 + 1 / n0))
    best = counts.select("id", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "id").limit(most)
    return sorted(r["id"] for r in best.collect())


def fit(rows: list[np.ndarray], toxic: np.ndarray, kept: list[int], steps: int = 300) -> Model:
    """Full-batch Adam on the ordinal likelihood; classes weigh alike, so the sample's share of toxic texts doesn't matter.

    ``rows`` are each text's features among the sorted ones in ``kept``.
    """
    if not len(kept):
        return Model({}, np.full(GRADES - 1, 40.0))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(kept, r)] = 1
    lean = x[toxic].mean(axis=0) > x[~toxic].mean(axis=0)
    evidence = x[:, lean].sum(axis=1)
    grade = np.zeros(len(rows), np.int64)
    cuts = np.quantile(evidence[toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade[toxic] = 1 + np.searchsorted(cuts, evidence[toxic])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, cut = np.zeros(len(kept)), np.array([1.0, *[np.log(1.0)] * (GRADES - 2)])  # first threshold, log steps
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    for step in range(1, steps + 1):
        theta = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        s = (x @ w.astype(np.float32)).astype(np.float64)
        upper = 1 / (1 + np.exp(np.clip(s[:, None] - theta, -40, 40)))  # P(grade <= k)
        full = np.column_stack([np.zeros(len(s)), upper, np.ones(len(s))])
        at = np.arange(len(s))
        hi, lo = full[at, grade + 1], full[at, grade]
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob * weight, lo * (1 - lo) / prob * weight
        g_score = d_hi - d_lo  # of the negative log-likelihood
        g_theta = np.array([(d_lo[grade == k + 1]).sum() - (d_hi[grade == k]).sum() for k in range(GRADES - 1)])
        g_w = x.T @ g_score.astype(np.float32) + 1e-6 * w
        g_cut = np.array([g_theta.sum(), *(np.exp(cut[k]) * g_theta[k:].sum() for k in range(1, GRADES - 1))])
        for value, grad, m, v in ((w, g_w, state[0], state[1]), (cut, g_cut, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
    return Model({int(k): float(v) for k, v in zip(kept, w)}, theta)


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, width: int = 150) -> Model:
    """Fit on at most about ``most`` labelled documents of each class, chosen by a hash of doc_id, and ``width`` features.

    Several labels for one id: toxic wins.  Null labels and ids are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialise(known, "known")
    chosen = [bounded_sample(known.where(F.col("toxic") == t), "doc_id", most, 7) for t in (0, 1)]
    sample = materialise(chosen[0].unionByName(chosen[1]), "sample")  # bounded by ``most``
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = rows.select("doc_id", (F.col("toxic") > 0).alias("toxic"), text_features()("text").alias("seen"))
    texts = materialise(texts, "seen")  # an id, a class and all features of each text
    many = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    kept = _selected(texts, many[True], many[False], width) if len(many) == 2 else []
    chosen = F.array(*map(F.lit, kept)).cast("array<int>")
    found = texts.select("doc_id", "toxic", F.array_intersect("seen", chosen).alias("seen")).toPandas()  # ``width`` a text at most
    discard(texts)
    found = found.sort_values("doc_id", kind="stable")
    return fit([np.asarray(r, np.int64) for r in found["seen"]], found["toxic"].to_numpy(bool), kept)


def severity(model: Model):
    """Column function: text -> expected severity, most likely grade, and P(toxic)."""
    weights, thresholds = model.weights, model.thresholds

    @F.arrow_udf("struct<severity: double, grade: int, p_toxic: double>")
    def score(texts: pa.Array) -> pa.Array:
        found, known = [], {}
        for text in as_text(texts):
            seen = set()
            for w in set(WORD.findall(text.lower())):
                if w not in known:
                    known[w] = tuple(f for f in features(w) if f in weights)
                if known[w]:
                    seen.update(known[w])
            if len(known) > 400_000:
                known.clear()
            found.append(sum(weights[f] for f in sorted(seen)))
        above = Model(weights, thresholds).above(np.array(found, np.float64).reshape(-1))
        steps = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
        arrays = [pa.array(above.sum(axis=1)), pa.array(steps.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0])]
        return pa.StructArray.from_arrays(arrays, names=["severity", "grade", "p_toxic"])

    return score


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(row, severity, grade, p_toxic, toxic): each row as a struct with its expected severity; toxic if p_toxic >= threshold.

    Null and empty texts have no features and get the base rate; a model without training rows calls nothing toxic.
    Repeated rows and null ids are scored like any other.
    """
    rows = docs.select(F.struct("*").alias("row")).withColumn("s", severity(model)(F.col("row.text")))
    return rows.select("row", "s.severity", "s.grade", "s.p_toxic", (F.col("s.p_toxic") >= threshold).alias("toxic"))
