"""Personal data by candidate gradient boosting (operator 8).

Generators with high recall propose spans, which may overlap: the four base kinds and looser shapes of mail addresses, numbers
with separators, and account codes.  Boosted trees rate each candidate by its format and its surroundings.  They
are trained on what they have to decide, in a bounded sample: spans that the base rules accept are rewritten, each in its own
context, into notations that these rules don't know (:func:`notations`), and a candidate that is such a span is positive.  One that lies apart from all
base spans, or only overlaps a rewritten one, is negative, and so is a number without check digit in the same other notations; what may be personal data in
a notation of its own is left out.  Held-out candidates calibrate the scores, and a threshold on the calibrated
probability selects the spans that are added, also around a base span that is only part of one.  Base spans always stay.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text, bounded_sample
from forgeclock.llm.trees import Boosted, boosting
from forgeclock.shared import materialise

KINDS = "email", "ip", "card", "phone"
#: The base patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Looser generators: each may propose what others propose too.
WIDER = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[\w-]+)+")),
    ("ip", re.compile(r"[0-9]{1,3}(?:(?:[.,]|\[\.\]|\(\.\))[0-9]{1,3}){1,4}")),
    ("card", re.compile(r"[0-9](?:[ .-]{0,2}[0-9]){7,24}")),
    ("phone", re.compile(r"(?:\+|00)?\(?[0-9][0-9() ./-]{5,22}[0-9]")),
    ("account", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}\b")),
)
_SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base rules, in order of start and then of kinds as listed."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=_order)


def _small(part: str) -> bool:
    """A number of at most 255, whatever its length."""
    return len(part.lstrip("0")) <= 3 and int(part) <= 255


def _order(span: Span) -> tuple[int, int, int]:
    names = [*KINDS, "account"]
    return span[0], names.index(span[2]), span[1]


def candidates(text: str) -> list[Span]:
    """Spans of all generators, once each, in order; those of one kind may overlap others."""
    found = set(base_spans(text))
    if "@" in text or "(at)" in text or "[at]" in text:
        found.update((m.start(), m.end(), "email") for m in WIDER[0][1].finditer(text))
    if _DIGIT.search(text):
        for kind, pattern in WIDER[1:]:
            found.update((m.start(), m.end(), kind) for m in pattern.finditer(text))
    return sorted(found, key=_order)


_CONTEXT = {
    "email": ("mail", "contact", "write"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "card": ("card", "visa", "credit", "account", "iban"),
    "net": ("ip", "host", "server", "address"),
    "code": ("version", "license", "token", "password", "key", "id", "v"),
}


def features(text: str, span: Span) -> list[float]:
    """Format of the span, and the characters and words around it."""
    a, b, kind = span
    s = text[a:b]
    digits = _DIGIT.findall(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    before, after = text[max(0, a - 40) : a], text[b : b + 20]
    words = {w.lower() for w in re.findall(r"[^\W\d_]+", before)[-4:]}
    edge_left, edge_right = before[-1:], after[:1]
    return [
        [*KINDS, "account"].index(kind),
        len(s),
        len(digits),
        len(digits) / len(s),
        len(groups),
        max(groups),
        min(groups),
        groups[0],
        float(s.startswith(("+", "00"))),
        s.count("."),
        s.count("-"),
        s.count(" "),
        float("(" in s),
        s.count("@"),
        sum(c.isalpha() for c in s),
        max(int(g) if len(g) < 6 else 999_999 for g in re.findall("[0-9]+", s) or ["0"]),
        float(luhn("".join(digits))) if 12 <= len(digits) <= 19 else -1.0,
        float(bool(edge_left) and edge_left.isalnum()),
        float(bool(edge_right) and edge_right.isalnum()),
        float(edge_left in "\"'=:/"),
        float(edge_right in "\"'=:/"),
        s.count("/"),
        s.count("[") + s.count("(."),
        len(_SPELLED.findall(s)),
        sum(not c.isascii() for c in s),
        *(float(bool(words & set(names))) for names in _CONTEXT.values()),
    ]


@dataclass
class Model:
    trees: Boosted
    threshold: float
    recall: dict[str, float] = field(default_factory=dict)


def _open(text: str, span: Span) -> bool:
    """Other notations that the base rules can't judge: written-out addresses, grouped phone numbers without a plus, account codes."""
    s = text[span[0] : span[1]]
    grouped = 9 <= len(_DIGIT.findall(s)) <= 13 and len(re.findall("[0-9]+", s)) >= 3 and s.count(".") != 3
    return span[2] in ("email", "account") or span[2] == "phone" and grouped


def _apart(c: Span, b: Span) -> bool:
    return c[1] <= b[0] or b[1] <= c[0]


def _wider(c: Span, b: Span) -> bool:
    """``c`` holds all of ``b`` and more."""
    return c[0] <= b[0] and b[1] <= c[1] and c[:2] != b[:2]


#: Letters with an accent that stand for plain ones in names.
_ACCENTS = str.maketrans("aeiou", "äéíöü")
#: Characters on either side of a rewritten span that its candidates and features may look at.
AROUND = 200


def notations(s: str, kind: str) -> list[str]:
    """``s`` of a base kind in notations that the base rules take for something else or for a part only."""
    if kind == "email":
        name, host = s.split("@", 1)
        accented = name[: len(name) // 2] + name[len(name) // 2 :].translate(_ACCENTS) if name.isalpha() else name.translate(_ACCENTS)
        spelled = [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host.replace('.', '[dot]')}"]
        return spelled + [f"{accented}@{host}"] * (accented != name)
    digits = "".join(_DIGIT.findall(s))
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", "(.)")]
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(groups), "  ".join(groups)]
    groups = re.findall("[0-9]+", s)
    groups = groups if len(groups) > 1 else [digits[:2], digits[2:5], digits[5:]]
    return ["00" + " ".join(groups), "/".join((" ".join(groups[:2]), "".join(groups[2:]))).rstrip("/"), s.lstrip("+").replace(digits, " ".join(groups))]


def rewritten(text: str, span: Span, right: bool) -> list[dict]:
    """Candidates about ``span`` in its other notations with their labels: the span itself ``right``, what overlaps it wrong."""
    a, b, kind = span
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    rows = []
    for s in notations(text[a:b], kind):
        new, own = before + s + after, (len(before), len(before) + len(s), kind)
        base = set(base_spans(new))
        if own in base:  # no other notation after all
            continue
        rows += [
            {"x": features(new, c), "y": int(right and c == own), "kind": kind if right and c == own else None}
            for c in candidates(new)
            if not _apart(c, own) and c not in base
        ]
    return rows


_ROWS = pa.list_(pa.struct([("x", pa.list_(pa.float64())), ("y", pa.int32()), ("kind", pa.string())]))


def _labelled():
    """Column function: text -> features and labels of what the model has to decide; base spans themselves and what is open: left out."""

    @F.arrow_udf("array<struct<x: array<double>, y: int, kind: string>>")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_text(texts):
            base = base_spans(text)
            rows = [r for span in base for r in rewritten(text, span, True)]
            for c in candidates(text):
                if any(not _apart(c, b) for b in base):
                    continue
                if not _open(text, c):
                    rows.append({"x": features(text, c), "y": 0, "kind": None})
                digits = _DIGIT.findall(text[c[0] : c[1]])
                if c[2] == "card" and 12 <= len(digits) <= 19 and not luhn("".join(digits)):
                    rows += rewritten(text, c, False)
            out.append(rows)
        return pa.array(out, _ROWS)

    return label


def train(docs: DataFrame, most: int = 8000, precision: float = 0.98) -> Model:
    """Fit on the candidates of at most about ``most`` documents with a digit or an @, chosen by a hash of doc_id.

    The threshold is the lowest calibrated probability above which at least ``precision`` of the held-out candidates are
    positive; without candidates of both kinds nothing is added.  ``recall`` tells which part of the held-out rewritten spans it finds.
    """
    likely = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(F.col("text").rlike("[0-9@]"))
    ids = materialise(likely.select("doc_id").distinct(), "likely")
    sample = materialise(bounded_sample(ids, "doc_id", most, 17), "sample")  # bounded by ``most``
    rows = likely.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", F.explode(_labelled()("text")).alias("r")).select("doc_id", "r.*").toPandas()
    found = found.assign(text=found["x"].map(str)).sort_values(["doc_id", "text"], kind="stable")
    y = found["y"].to_numpy(np.int64)
    if not y.any() or y.all():
        return Model(Boosted([], [], -40.0, (1.0, 0.0)), 2.0)
    x = np.array(found["x"].tolist(), np.float64)
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 0 for d in found["doc_id"]])
    trees = boosting(x, y, held)
    if not held.any():
        return Model(trees, 2.0)
    p, t = trees.predict(x[held]), y[held]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    good = np.nonzero(right >= precision)[0]
    threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0
    kinds = found["kind"].to_numpy()[held]
    recall = {k: float(np.mean(p[kinds == k] >= threshold)) for k in KINDS if (kinds == k).any()}
    return Model(trees, threshold, recall)


_FOUND = pa.struct(
    [(f"n_{k}", pa.int64()) for k in KINDS] + [("base", pa.list_(pa.string())), ("spans", pa.list_(pa.string()))]
)


def spans(model: Model):
    """Column function: text -> counts of base spans, base spans, and all spans as kind:start:end."""

    @F.arrow_udf(
        "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base: array<string>, spans: array<string>>"
    )
    def find(texts: pa.Array) -> pa.Array:
        out, bases, pending, x = [], [], [], []
        for i, text in enumerate(as_text(texts)):
            base = base_spans(text)
            out.append((base, list(base)))
            bases.append(set(base))
            for c in candidates(text):
                if all(_apart(c, b) or _wider(c, b) for b in base):
                    pending.append((i, c))
                    x.append(features(text, c))
        if x:
            chances = model.trees.predict(np.array(x, np.float64))
            for at in np.argsort(-chances, kind="stable"):
                i, c = pending[at]
                if chances[at] >= model.threshold and all(_apart(c, b) or b in bases[i] for b in out[i][1]):
                    out[i][1].append(c)
        show = lambda found: [f"{k}:{a}:{b}" for a, b, k in sorted(found, key=_order)]
        rows = [
            {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS} | {"base": show(base), "spans": show(every)}
            for base, every in out
        ]
        return pa.array(rows, _FOUND)

    return find


def found(docs: DataFrame, model: Model) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base, spans): each row as a struct with its spans in code points.

    Null and empty texts have none.  Added spans don't overlap each other, and base spans only where they hold all of one and more; the
    likelier one wins, on equal chances the earlier.  Repeated rows and null ids are treated like any other.
    """
    rows = docs.select(F.struct("*").alias("row")).withColumn("f", spans(model)(F.col("row.text")))
    return rows.select("row", "f.*")


def redacted(text: str, found: list[str]) -> str:
    """``text`` with each span replaced by its kind in angle brackets."""
    parts = sorted((int(a), int(b), k) for k, a, b in (s.rsplit(":", 2) for s in found))
    out, at = [], 0
    for a, b, kind in parts:
        out += [text[at : max(at, a)], f"<{kind}>" if a >= at else ""]
        at = max(at, b)
    return "".join([*out, text[at:]])
