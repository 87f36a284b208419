"""Quality rules from tokeniser fertility (operator 5).

A public vocabulary measures each text: characters per token, the share of byte-fallback tokens, and the entropy of its
tokens.  For every language and octave of length (short texts spread more) the middle half of the corpus sets a band for each
measure, and texts far outside are rejected, next to plain base rules on length and repetition.  Small groups have the band of their
language over all lengths, else of their script, else of all documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeclock.llm.common import SPACE
from forgeclock.shared import materialise

SYMBOLS = "#*$%&|<>"
RUN = 5
_SPACES = [c.encode() for c in SPACE]
#: Measures are counted in bins of this width, so bands are exact over all documents whatever their number.
BIN = 0.01
MEASURES = ("chars_per_token", "byte_share", "entropy")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of ``RUN`` words found at least twice in the text."""
    runs = list(zip(*(words[i:] for i in range(RUN))))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    covered, until = 0, 0
    for i, run in enumerate(runs):
        if counts[run] > 1:
            covered += i + RUN - max(i, until)
            until = i + RUN
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.decode()) - sum(map(text.count, _SPACES))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0].split("-")[0] if char.isalpha() else ""


def script(text: str) -> str:
    """Script of most letters of the text, the first by name on a tie; no letter: empty."""
    if text.isascii():
        return _script("a") if any(map(str.isalpha, text)) else ""
    seen: Counter[str] = Counter()
    for char, n in Counter(text).items():
        seen[_script(char)] += n
    del seen[""]
    return min(seen, key=lambda name: (-seen[name], name), default="")


@lru_cache(maxsize=1)
def _pieces(vocabulary: str):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    fallback = frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))
    return model, fallback, {}


def token_measures(text: bytes, vocabulary: str) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share and token entropy in bits, over the words of the text; no word: zeros.

    Words are encoded one by one and remembered, since pieces never cross white space.
    """
    model, fallback, known = _pieces(vocabulary)
    counts = Counter(text.split())
    new = [w for w in counts if w not in known]
    if new:
        if len(known) + len(new) > 400_000:
            known.clear()
            new = list(counts)
        for w, ids in zip(new, model.encode([w.decode() for w in new], num_threads=1)):
            known[w] = ids
    seen: Counter[int] = Counter()
    for w, c in counts.items():
        if c == 1:
            seen.update(known[w])
        else:
            for i in known[w]:
                seen[i] += c
    total = seen.total()
    if not total:
        return 0.0, 0.0, 0.0
    chars = sum(len(w.decode()) * c for w, c in counts.items())
    spread = math.log2(total) - sum(c * math.log2(c) for c in seen.values()) / total
    return chars / total, sum(seen[i] for i in fallback & seen.keys()) / total, spread


_KIND = pa.struct(
    [("script", pa.string())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [(n, pa.float64()) for n in MEASURES]
)


def measured(vocabulary: str):
    """Column function: text -> script, base counts and token measures."""

    @F.arrow_udf(
        "struct<script: string, n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
        "chars_per_token: double, byte_share: double, entropy: double>"
    )
    def measure(texts: pa.Array) -> pa.Array:
        rows = [(script((t or b"").decode()), *base_counts(t or b""), *token_measures(t or b"", vocabulary)) for t in texts.cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows)) or [()] * len(_KIND)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND)], fields=list(_KIND))

    return measure


def bands(rows: DataFrame, width: float, least: int) -> DataFrame:
    """(key, script, octave, measure, low, high): quartiles of each measure by group, widened by ``width`` times their distance.

    Quartiles come from a histogram with fixed bins over all rows.  A group is the language and octave; with fewer than ``least``
    rows it is the language, then the script, then all rows, however few.
    """
    measures = F.explode(F.create_map(*chain.from_iterable((F.lit(m), F.col(m)) for m in MEASURES)))
    bins = rows.select("key", "script", "octave", measures.alias("measure", "value"))
    bins = bins.groupBy("key", "script", "octave", "measure", F.floor(F.col("value") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins, none = materialise(bins, "bins"), F.lit(-1).cast("long")
    names = [("key", F.col("octave")), ("key", none), ("script", none), (F.lit(""), none)]
    kinds = (F.struct(F.lit(i).alias("level"), F.col(n).alias("name") if isinstance(n, str) else n.alias("name"), o.alias("part")) for i, (n, o) in enumerate(names))
    wider, by = F.explode(F.array(*kinds)).alias("g"), ["level", "name", "part", "measure"]
    dealt = bins.select("measure", "bin", "n", wider).select("g.*", "measure", "bin", "n")
    dealt = dealt.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    running = F.sum("n").over(group.orderBy("bin"))
    ranked = dealt.select(*by, "bin", running.alias("upto"), F.sum("n").over(group).alias("all"))
    at = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * BIN for q in (0.25, 0.75)]
    quartiles = ranked.groupBy(*by).agg(at[0].alias("q1"), at[1].alias("q3"), F.max("all").alias("all"))
    reach = width * F.greatest(F.col("q3") - F.col("q1"), F.lit(BIN))
    limits = quartiles.where((F.col("all") >= least) | (F.col("level") == len(names) - 1)).select(
        *by, F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + BIN + reach).alias("high")).alias("band")
    )
    own = ["key", "script", "octave", "measure"]
    groups = bins.select(*own).distinct().select(*own, wider).select(*own, "g.*")
    first = groups.join(materialise(limits, "limits"), by).groupBy(*own).agg(F.min_by("band", "level").alias("band"))
    return first.select(*own, "band.low", "band.high")


def ruled(
    docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", key: str = "lang", width: float = 3.0, least: int = 50
) -> DataFrame:
    """doc_id, base counts, base_failed, token measures, kept: one row for each row of ``docs``.

    Null text counts as empty: no words, so the base rules reject it.  A null language is a language of its own.  The
    bands come from texts that pass the base rules; every such text is judged, by a wider group's band if its own is small.
    Repeated rows and null ids stay.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), measured(vocabulary)("text").alias("m"))
    few, repetitive = F.col("n_words") < 10, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    rows = materialise(rows.select("doc_id", "key", "m.*").withColumn("base_failed", few | repetitive), "measures")
    rows = rows.withColumn("octave", F.floor(F.log2(F.col("n_words") + 1)))
    limits = bands(rows.where("NOT base_failed"), width, least)
    lines = limits.groupBy("key", "script", "octave").pivot("measure", list(MEASURES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    met = rows.join(materialise(lines, "bands"), ["key", "script", "octave"], "left")
    inside = [
        F.coalesce((F.col(m) >= F.col(f"{m}_low")) & (F.col(m) <= F.col(f"{m}_high")), F.lit(True)) for m in MEASURES
    ]
    kept = ~F.col("base_failed") & inside[0] & inside[1] & inside[2]
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *MEASURES
    )
