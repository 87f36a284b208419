"""Benchmark decontamination by template canonicalisation (operator 1).

Words become template tokens: numbers, names (capitalised words) and units turn into typed placeholders, all others are
lower-cased without punctuation at their ends.  Windows of template tokens are hashed on both sides and hash-joined, so a
question whose numbers or names were changed still meets its benchmark item.  Names must be consistent: along one alignment, windows
that contradict what a name mostly stands for don't count.  Windows that are equal word for word always do.  Numbers and units are independent of each other.  Names are told by their capital letter, so windows of lower-cased
words are joined too, and a window met by either counts.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text, key_filter, passes, signed, text_key
from forgeclock.shared import materialise

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Units and number words that become placeholders.
UNITS = frozenset(
    "kg g mg km m cm mm ml l lb oz ft mph kmh miles mile meters metres meter metre liters litres grams pounds dollars cents euros "
    "hours minutes seconds days weeks months years percent degrees".split()
)
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand".split())
_EDGE = re.compile(r"^[^\w$€£+\-]+|[^\w%]+$")
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*%?$")
_MEASURE = re.compile(r"[+\-]?\d[\d.,]*([^\W\d_]+)$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def template(word: str) -> tuple[str, str]:
    """(template token, value): the value is what a placeholder stands for, else empty."""
    core = word if word.isalpha() else _EDGE.sub("", word)
    low = core.lower()
    if low == core and core.isalpha():
        return (NUMBER, low) if low in NUMBER_WORDS else (UNIT, low) if low in UNITS else (low, "")
    if _NUMBER.match(core) or low in NUMBER_WORDS:
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    measure = _MEASURE.match(core)
    if measure and measure[1].lower() in UNITS:
        return f"{NUMBER}{UNIT}", low
    if core[:1].isupper() and (len(core) == 1 or not core.isupper()):
        return NAME, low
    return low or word, ""


def _hash(token: str, open_slot: bool) -> int:
    return xxhash.xxh64_intdigest(token.encode(), int(open_slot))


class _Words(dict):
    """word -> its place in ``columns``: hash of its template token, hash of its literal token, 1 if it is no placeholder."""

    def __init__(self) -> None:
        self.columns = array("Q"), array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        token, value = template(word)
        for column, x in zip(self.columns, (_hash(token, bool(value)), _hash(value or token, False), int(not value))):
            column.append(x)
        self[word] = place = len(self)
        return place

    def table(self, words: list[str]) -> np.ndarray:
        """The three columns for each word of a list."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([np.array(c, np.uint64)[at] for c in self.columns])


#: Words that a worker remembers over its batches, at most.
REMEMBERED = 100_000


@lru_cache(maxsize=1)
def _remembered() -> list[_Words]:
    return [_Words()]


def _known() -> _Words:
    """The worker's words, started anew when they are too many."""
    held = _remembered()
    if len(held[0]) > REMEMBERED:
        held[0] = _Words()
    return held[0]


def window_hashes(table: np.ndarray, ends: np.ndarray, size: int, literal: bool, lexical: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the windows with at least ``lexical`` words that are no placeholder; all literal ones.

    ``table`` has the words of one text after the other; ``ends``: for each word, where its text ends.  No window crosses texts.
    """
    n = table.shape[1] - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token = table[1 if literal else 0]
    out = np.full(n, size * 2 + literal, np.uint64)
    for j in range(size):
        out ^= token[j : j + n]
        out *= _BASE
        out ^= out >> np.uint64(31)
    inside = np.arange(size, n + size) <= ends[:n]
    if not literal:
        kept = np.concatenate([[0], np.cumsum(table[2].astype(np.int64))])
        inside &= kept[size:] - kept[:-size] >= lexical
    at = np.nonzero(inside)[0]
    return out[at], at


def slots(words: list[str], at: int, size: int) -> list[str]:
    """Values of a window's placeholders, each with its place in the window and its type."""
    pairs = enumerate(template(w) for w in words[at : at + size])
    return [f"{i} {token} {value}" for i, (token, value) in pairs if value]


def consistent(windows: list[dict]) -> tuple[list[int], int]:
    """(item windows that count, changed slots) of one alignment, whose ``windows`` have at, own and theirs.

    A name stands for the value it meets in most places, itself on a tie and none on a tie of others; the same holds the other way
    round.  Windows that contradict it go, those without a changed slot stay.
    """
    places = {(w["at"] + int(own.split(" ", 1)[0]), own.split(" ", 1)[1], their.split(" ", 1)[1]) for w in windows for own, their in zip(w["own"], w["theirs"])}
    votes = Counter((own, their) for _, own, their in places if own.startswith(NAME + " "))
    best: tuple[dict, dict] = {}, {}
    for side in (0, 1):
        rank = lambda pair: (votes[pair], pair[0] == pair[1])
        for pair in votes:
            best[side].setdefault(pair[side], []).append(pair)
        for value, pairs in best[side].items():
            top = max(map(rank, pairs))
            best[side][value] = [p for p in pairs if rank(p) == top]
    wrong = {p for p in votes if p[0] != p[1] and not all(best[side][p[side]] == [p] for side in (0, 1))}
    ats, changed = set(), set()
    for w in windows:
        pairs = {(own.split(" ", 1)[1], their.split(" ", 1)[1]) for own, their in zip(w["own"], w["theirs"])}
        if not pairs & wrong:
            ats.add(w["at"])
            changed |= {p for p in pairs if p[0] != p[1]}
    return sorted(ats), len(changed)


def settled():
    """Column function: windows of an alignment -> item windows that count, changed slots."""

    @F.arrow_udf("struct<ats: array<bigint>, changed: bigint>")
    def settle(alignments: pa.Array) -> pa.Array:
        found = [consistent(windows) for windows in alignments.to_pylist()]
        kind = pa.struct([("ats", pa.list_(pa.int64())), ("changed", pa.int64())])
        return pa.array([{"ats": ats, "changed": changed} for ats, changed in found], kind)

    return settle


_WINDOWS = pa.list_(
    pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("slots", pa.list_(pa.string())), ("n", pa.int64())])
)


#: Bytes of text whose windows are made at a time; a longer text is worked on alone.
CHUNK = 1 << 20


def _windows(texts: pa.Array, modes: list[tuple[int, bool]], lexical: int, bits: np.ndarray | None) -> pa.Array:
    """Windows of each text; with ``bits`` those only that may be some item's."""
    out, held, size = [], [], 0
    for text in as_text(texts):
        held.append(text.split())
        size += len(text)
        if size >= CHUNK:
            out += _chunk_windows(held, modes, lexical, bits)
            held, size = [], 0
    return pa.array(out + _chunk_windows(held, modes, lexical, bits), _WINDOWS)


def _chunk_windows(texts: list[list[str]], modes: list[tuple[int, bool]], lexical: int, bits: np.ndarray | None) -> list[list[dict]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    table = _known().table([w for t in texts for w in t])
    ends = np.repeat(starts + sizes, sizes)
    rows: list[list[dict]] = [[] for _ in texts]
    for size, literal in modes:
        hashes, at = window_hashes(table, ends, size, literal, lexical)
        if bits is None:
            totals = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(texts))
        else:
            hit = passes(bits, hashes)
            hashes, at, totals = hashes[hit], at[hit], None
        which = np.searchsorted(starts, at, "right") - 1  # of texts that begin at one place, the last one has words
        for k, h, p in zip(which.tolist(), signed(hashes).tolist(), (at - starts[which]).tolist()):
            own = [] if literal else slots(texts[k], p, size)
            rows[k].append({"h": h, "pos": p, "slots": own, "n": None if totals is None else int(totals[k])})
    return rows


def item_windows(size: int, lexical: int):
    """Column function: item text -> its windows.

    An item shorter than a window is one window; one without enough words that are no placeholder is matched word by word.
    All others have each window a second time as lower-cased words, which copies in other letter case still have.
    """

    @F.arrow_udf("array<struct<h: bigint, pos: bigint, slots: array<string>, n: bigint>>")
    def windows(texts: pa.Array) -> pa.Array:
        rows = []
        for text in as_text(texts):
            many = min(size, len(text.split()))
            found = _windows(pa.array([text]), [(many, False)] if many else [], min(lexical, many), None)
            if many:
                plain = _windows(pa.array([text]), [(many, True)], 0, None)
                typed = {w["pos"]: w["n"] for w in found[0].as_py()}
                same = [w | {"n": typed[w["pos"]]} for w in plain[0].as_py() if w["pos"] in typed]
                found = pa.array([found[0].as_py() + same], _WINDOWS) if typed else plain
            rows.append(found)
        return pa.concat_arrays(rows) if rows else pa.array([], _WINDOWS)

    return windows


def _modes(benchmark: DataFrame, size: int, lexical: int) -> list[tuple[int, bool]]:
    """Window lengths and kinds that the items need: at most two for each length up to ``size``, literal ones always."""

    @F.arrow_udf("int")
    def mode(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_text(texts):
            parts = text.split()
            many = min(size, len(parts))
            ends = np.full(len(parts), len(parts))
            typed = many and len(window_hashes(_known().table(parts), ends, many, False, min(lexical, many))[0])
            out.append(2 * many + (0 if typed else 1))
        return pa.array(out, pa.int32())

    found = benchmark.select(mode("text").alias("mode")).distinct().collect()
    needed = {(r["mode"] // 2, bool(r["mode"] % 2)) for r in found if r["mode"] >= 2}
    return sorted(needed | {(many, True) for many, _ in needed})


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, lexical: int = 4, coverage: float = 0.5
) -> DataFrame:
    """(doc_id, th, item_id, matched, n_windows, coverage, changed_slots): documents that hold a benchmark item.

    An item is held if the consistent windows of all alignments cover at least ``coverage`` of its windows; ``changed_slots`` counts
    the placeholders whose values differ.  ``th`` is the key of the text: repeated rows share one finding.  Null ids are
    kept; null or empty texts and items hold nothing.  Items with equal texts are each reported.
    """
    cut = benchmark.select("item_id", F.explode(item_windows(size, lexical)("text")).alias("w"))
    items = materialise(cut.select("item_id", "w.h", F.col("w.pos").alias("at"), F.col("w.slots").alias("own"), "w.n"), "items")
    modes, bits = _modes(benchmark, size, lexical), key_filter(items)

    @F.arrow_udf("array<struct<h: bigint, pos: bigint, slots: array<string>, n: bigint>>")
    def windows(texts: pa.Array) -> pa.Array:
        return _windows(texts, modes, min([lexical, *(m for m, _ in modes)]), bits)

    hits = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.explode(windows("text")).alias("w"))
    met = hits.select("doc_id", "th", "w.h", "w.pos", F.col("w.slots").alias("theirs")).join(items, "h")
    one = F.collect_set(F.struct("at", "own", "theirs"))
    lines = met.groupBy("doc_id", "th", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(
        one.alias("windows"), F.max("n").alias("n_windows")
    )  # at most as many windows as the item has
    kept = lines.select("doc_id", "th", "item_id", "n_windows", settled()("windows").alias("k")).where(F.size("k.ats") > 0)
    matched = F.size(F.array_distinct(F.flatten(F.collect_list("k.ats"))))
    out = kept.groupBy("doc_id", "th", "item_id").agg(
        matched.cast("long").alias("matched"), F.max("n_windows").alias("n_windows"), F.min("k.changed").alias("changed_slots")
    )
    share = F.col("matched") / F.col("n_windows")
    return out.withColumn("coverage", share).where(share >= coverage)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    found = materialise(leaks(docs, benchmark, **settings).select("doc_id", "th").distinct(), "leaks").alias("f")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("f.doc_id")) & (text_key(F.col("row.text")) == F.col("f.th"))
    return rows.join(found, same, "left_anti").select("row.*")
