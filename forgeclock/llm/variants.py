"""Spelling variants: words one edit apart, by bit-sliced position indexes (operator 11).

An index holds, for every position and letter, the set of its words that have that letter there, as the bits of one integer.  A
query word is read letter by letter, and all words of the index are compared at once: ``zero`` has the words that agree so far, ``same``
those with one letter replaced so far, ``more`` those with one letter more (looked up one position on) and ``less`` those with one
letter less (one position back).  Bits are numbered by falling count, so the lowest bit of an answer is its most frequent word.

The vocabulary is cut into blocks that hold every near pair in one task: of two words of lengths ``l`` and ``l`` or ``l + 1`` that are one
edit apart, the first ``l // 2`` letters agree or the last ``l - l // 2``.  A word is in four blocks: by its beginning and by its end, with
the words as long as itself and longer by one, and with the shorter ones.  Blocks with many words are cut into slices, and each pair of
slices is compared in a task of its own.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_bytes
from forgeclock.shared import materialise

#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Words of an index, at most.
SLICE = 8192


# ---------------------------------------------------------------- vocabulary
def runs(text: bytes, min_chars: int) -> Counter:
    """Lower-cased runs of letters of at least ``min_chars`` code points, with their number."""
    return Counter(re.findall(f"[a-zÀ-ÿ]{{{min_chars},}}", text.lower().decode()))


def spoiled(run: str, start: int, every: int) -> str:
    """The run, without one letter where its checksum (which goes on from ``start``) says so."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points that occur ``min_count`` times or more in all texts.

    A run whose checksum with its doc_id is divisible by ``every`` loses a letter first.  A null id is written as nothing.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in runs(text, min_chars).items():
                    held[spoiled(run, start, every)] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    words = named.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


# ---------------------------------------------------------------- one block
class Sliced:
    """Index over words of length ``l`` (home) and ``l + 1`` (guests) that agree in their first ``start`` letters."""

    def __init__(self, words: list[str], l: int, start: int) -> None:
        self.l, self.start = l, start
        self.letters: list[dict[str, int]] = [{} for _ in range(l + 2)]
        self.home = self.guests = 0
        for i, word in enumerate(words):
            bit = 1 << i
            if len(word) == l:
                self.home |= bit
            else:
                self.guests |= bit
            for at in range(start, len(word)):
                column = self.letters[at]
                column[word[at]] = column.get(word[at], 0) | bit

    def near(self, word: str) -> int:
        """Words exactly one edit away from ``word``; of guests as queries, their home words only."""
        letters, zero = self.letters, self.home | self.guests
        if len(word) > self.l:
            less = 0
            for at in range(self.start, len(word)):
                less = less & letters[at - 1].get(word[at], 0) | zero
                zero &= letters[at].get(word[at], 0)
                if not zero | less:
                    return 0
            return less & self.home
        same = more = 0
        for at in range(self.start, len(word)):
            here = letters[at].get(word[at], 0)
            more = (more | zero) & letters[at + 1].get(word[at], 0)
            same = same & here | zero & ~here
            zero &= here
            if not zero | same | more:
                return 0
        return same & self.home | (more | zero) & self.guests


def block_answers(index: list[tuple[str, int]], queries: list[str], l: int, ends: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the largest count among them, its word) for the queries with near words in this block.

    Blocks by their words' ends leave out the pairs that agree in their first half too: those meet in the other block.
    """
    index = sorted(index, key=lambda x: (-x[1], x[0]))
    half = l // 2
    turned = (lambda w: w[::-1]) if ends else (lambda w: w)
    sliced = Sliced([turned(w) for w, _ in index], l, l - half if ends else half)
    elsewhere: dict[str, int] = {}
    if ends:
        for i, (word, _) in enumerate(index):
            elsewhere[word[:half]] = elsewhere.get(word[:half], 0) | 1 << i
    for word in queries:
        found = sliced.near(turned(word)) & ~elsewhere.get(word[:half], 0)
        if found:
            best, n = index[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), n, best


# ---------------------------------------------------------------- all blocks
def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    return itertools.groupby(rows, key=lambda r: r[:keys])


def near_words(words: DataFrame, min_chars: int, most: int = SLICE) -> DataFrame:
    """(word, n_near, best_n, best): a row for each word and block with near words; their pairs are counted once in all."""
    size = F.length("word")

    def block(l, ends):
        half = F.floor(l / 2).cast("int")
        part = F.substring(F.col("word"), size - (l - half) + 1, l - half) if ends else F.substring(F.col("word"), F.lit(1), half)
        return F.struct(l.cast("int").alias("l"), F.lit(ends).alias("ends"), part.alias("half"))

    blocks = F.array(*(block(size - less, ends) for less in (0, 1) for ends in (False, True)))
    placed = words.select("word", "n", F.explode(blocks).alias("b")).where(F.col("b.l") >= min_chars).select("b.*", "word", "n")
    key = ["l", "ends", "half"]
    crowded = placed.groupBy(*key).count().where(F.col("count") > most)
    crowded = materialise(crowded.select(*key, F.ceil(F.col("count") / most).cast("int").alias("slices")), "crowded")
    dealt = placed.join(crowded, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    tiles = F.array_union(
        F.transform(others, lambda j: F.col("slice") * F.col("slices") + j), F.transform(others, lambda i: i * F.col("slices") + F.col("slice"))
    )
    dealt = dealt.withColumn("tile", F.explode(tiles))
    asks, asked = F.floor(F.col("tile") / F.col("slices")) == F.col("slice"), F.col("tile") % F.col("slices") == F.col("slice")
    dealt = dealt.select(*key, "tile", "word", "n", asks.alias("asks"), asked.alias("asked"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, int, str]] = []

        def out() -> pa.RecordBatch:
            kinds = zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in kinds], names=["word", "n_near", "best_n", "best"])

        for (l, ends, _, _), rows in _grouped(batches, 4):
            members = list(rows)
            if len(members) > 1:
                found += block_answers([r[4:6] for r in members if r[7]], [r[4] for r in members if r[6]], l, ends)
            if len(found) > 50_000:
                yield out()
                found = []
        yield out()

    ordered = dealt.repartition(*key, "tile").sortWithinPartitions(*key, "tile")
    return ordered.mapInArrow(compare, "word string, n_near long, best_n long, best string")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form), by pointer doubling: a form is far more frequent than its word, so chains are short and end."""
    state = materialise(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        done = state.where("next IS NOT NULL").isEmpty()
        state = state.select("word", "root")
        if done:
            return state


def variant_groups(docs: DataFrame, min_chars: int = 7, min_count: int = 2, every: int = 31, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of the vocabulary, its more frequent form if any, and where its forms lead.

    A word's form is the most frequent word one edit away, ties by code points, if it occurs ``factor`` times as often or more.  Null and
    empty texts have no words; repeated rows count each; very long texts and words are read whole.  Empty table: no rows.  Columns
    other than doc_id and text are ignored.
    """
    words = materialise(vocabulary(docs, min_chars, min_count, every), "words")
    none = {"n_near": "bigint", "best_n": "bigint", "best": "string"}
    own = words.select("word", "n", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    met = near_words(words, min_chars).select("word", F.lit(None).cast("bigint").alias("n"), *none)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    merged = own.unionByName(met).groupBy("word").agg(
        F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best.alias("near")
    )
    chosen = -F.col("near.less") >= factor * F.col("n")
    formed = merged.select(
        "word", "n", "n_near", F.when(chosen, F.col("near.best")).alias("form"), F.when(chosen, -F.col("near.less")).alias("form_n")
    )
    formed = materialise(formed, "formed")
    root = _roots(formed.where("form IS NOT NULL"))
    return formed.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
