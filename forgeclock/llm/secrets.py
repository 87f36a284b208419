"""Secret scan with a random forest that removes false positives (operator 3).

Generators propose long tokens with digits, key formats, and values assigned to names such as ``password``.  A random forest rates
each candidate by its length, character transitions, dictionary coverage, the path or address it is part of, and neighbouring words.  It
is trained on labelled findings of a bounded sample: known key formats and credential assignments are true findings; addresses,
numbers, versions and plain words found by the same generators are false ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text, bounded_sample
from forgeclock.llm.trees import Forest, random_forest
from forgeclock.shared import materialise

#: Public formats of access keys and tokens.
FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"
)
NAMES = "password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth", "credential"
ASSIGNED = re.compile(r"(?i)(?<![^\W_])(" + "|".join(NAMES) + r")\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})")
LONG = re.compile(r"[A-Za-z0-9+/=_\-.]{12,}")
WORD = re.compile(r"[^\W\d_]{3,}")
_SPACE = re.compile(r"\s")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points, in order; a long token inside a key or an assigned value goes, all others stay."""
    strong = {m.span() for m in FORMATS.finditer(text)} | {m.span(2) for m in ASSIGNED.finditer(text)}
    long = {m.span() for m in LONG.finditer(text) if any(map(str.isdigit, m[0]))} - strong
    out: list[tuple[int, int]] = []
    upto = 0
    for a, b in sorted(strong | long, key=lambda s: (s[0], -s[1])):
        if (a, b) in strong or b > upto:
            out.append((a, b))
        if (a, b) in strong:
            upto = max(upto, b)
    return out


def labelled(text: str, a: int, b: int) -> int:
    """1: a true finding, 0: a false one, -1: unknown."""
    s, before = text[a:b], text[max(0, a - 24) : a]
    if FORMATS.search(s):
        return 1
    named = ASSIGNED.search(before + s)
    if named and named.end(2) == len(before + s):
        return int(entropy(s) >= 2.5 and any(map(str.isdigit, s)))
    word = _word_around(text, a, b)
    if "@" in word or "://" in word or re.fullmatch(r"[0-9.\-/:]+", s) or (WORD.fullmatch(s) and s.islower()):
        return 0
    return 0 if re.search(r"\.[a-z]{2,4}$", s) else -1


def _word_around(text: str, a: int, b: int) -> str:
    left, right = text[max(0, a - 80) : a], text[b : b + 80]
    return _SPACE.split(left)[-1] + text[a:b] + _SPACE.split(right)[0]


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def coverage(s: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, longest first from the left."""
    low, at, hit = s.lower(), 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 2, -1):
            if low[at : at + n] in words:
                hit, at = hit + n, at + n
                break
        else:
            at += 1
    return hit / len(low)


def features(text: str, a: int, b: int, words: frozenset[str]) -> list[float]:
    s, word = text[a:b], _word_around(text, a, b)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in s]
    steps = Counter(x + y for x, y in zip(kinds, kinds[1:]))
    count = Counter(kinds)
    near = [w.lower() for w in WORD.findall(text[max(0, a - 40) : a])[-3:]]
    n = len(s)
    return [
        b - a,
        entropy(s),
        coverage(s, words),
        *(count[k] / n for k in "duls"),
        *((steps[x] + steps[x[::-1]]) / n for x in ("dl", "du", "lu", "ds", "ls")),
        float(set(s.lower()) <= set("0123456789abcdef")),
        max((len(r) for r in re.findall(r"[^\W\d_]+", s)), default=0),
        max((len(r) for r in re.findall(r"\d+", s)), default=0),
        word.count("/"),
        word.count("."),
        float("@" in word),
        float("://" in word),
        float(bool(re.search(r"\.[A-Za-z]{1,4}$", s))),
        float(any(w in NAMES for w in near)),
        float(text[max(0, a - 1) : a] in "\"'=:" and a > 0),
        float(text[b : b + 1] in ("\"", "'")),
        sum(w in words for w in near) / 3,
    ]


@dataclass
class Model:
    forest: Forest
    words: frozenset[str]


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many texts of a batch each lower-case word is."""
    for batch in batches:
        seen: Counter[str] = Counter()
        for t in as_text(batch.column(0)):
            seen.update({w.lower() for w in WORD.findall(t) if len(w) <= 12})
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def dictionary(docs: DataFrame, least: int = 3, most: int = 30_000) -> frozenset[str]:
    """Lower-case words found in at least ``least`` of all rows' texts: the most frequent, at most ``most``.

    Words as frequent as each other are all taken or all left.  Only the bounded list and the sizes of its classes reach the driver.
    """
    words = docs.select("text").mapInArrow(_document_words, "word string, n long")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    sizes = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().toLocalIterator()), reverse=True)
    upto = accumulate(many for _, many in sizes)
    floor = min((n for (n, _), total in zip(sizes, upto) if total <= most), default=None)
    if floor is None:
        return frozenset()
    return frozenset(r["word"] for r in counts.where(F.col("n") >= floor).select("word").collect())  # at most ``most``


def train(docs: DataFrame, most: int = 4000) -> Model:
    """Fit on the labelled candidates of at most about ``most`` documents with a digit or an assignment, by a hash of doc_id.

    The dictionary comes from all documents.  Without findings of both kinds the forest has no trees and rates 0.5.
    """
    likely = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(F.col("text").rlike("[0-9]|[=:]"))
    ids = materialise(likely.select("doc_id").distinct(), "likely")
    sample = materialise(bounded_sample(ids, "doc_id", most, 19), "sample")  # bounded by ``most``
    rows = likely.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = materialise(rows, "texts")
    words = dictionary(docs)

    @F.arrow_udf("array<struct<x: array<double>, y: int>>")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_text(texts):
            spans = [(a, b, y) for a, b in candidates(text) if (y := labelled(text, a, b)) >= 0]
            out.append([{"x": features(text, a, b, words), "y": y} for a, b, y in spans])
        return pa.array(out, pa.list_(pa.struct([("x", pa.list_(pa.float64())), ("y", pa.int32())])))

    found = rows.select("doc_id", F.explode(label("text")).alias("r")).select("doc_id", "r.*").toPandas()
    found = found.assign(text=found["x"].map(str)).sort_values(["doc_id", "text"], kind="stable")
    y = found["y"].to_numpy(np.float64)
    if not y.any() or y.all():
        return Model(Forest([], []), words)
    return Model(random_forest(np.array(found["x"].tolist(), np.float64), y), words)


def findings(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, confidence, secret, sha256: a row for each candidate of each row of ``docs``.

    ``secret`` is false for candidates that the forest takes for false positives; the text itself is never returned, only its hash.
    Null and empty texts have no candidates.  Repeated rows repeat their findings; null ids stay.
    """

    @F.arrow_udf("array<struct<start: bigint, end: bigint, confidence: double, value: string>>")
    def scan(texts: pa.Array) -> pa.Array:
        out, x, at = [], [], []
        for i, text in enumerate(as_text(texts)):
            out.append([])
            for a, b in candidates(text):
                x.append(features(text, a, b, model.words))
                at.append((i, a, b, text[a:b]))
        chances = model.forest.predict(np.array(x, np.float64)) if x else []
        for (i, a, b, value), p in zip(at, chances):
            out[i].append({"start": a, "end": b, "confidence": float(p), "value": value})
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64()), ("value", pa.string())])
        return pa.array(out, pa.list_(kind))

    rows = docs.select("doc_id", F.explode(scan("text")).alias("c"))
    return rows.select(
        "doc_id", "c.start", "c.end", "c.confidence", (F.col("c.confidence") >= threshold).alias("secret"),
        F.sha2("c.value", 256).alias("sha256"),
    )
