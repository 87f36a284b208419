"""Language-model scores from an Elias-Fano trie of n-grams (operator 12).

The trie has three levels.  Words are sorted 64-bit hashes; a word's id is its place.  Under each word lie its successors, sorted by id, and
under each such pair the successors of its second word that were seen after the pair.  Those are stored as their places among the successors
of the second word alone, which are small numbers.  Each level's lists make up one rising sequence (a list goes on from the last number of
the list before), and rising pointers tell where lists begin; both are Elias-Fano sequences.  Log probabilities are stored in
steps of 1/2048.  A successor is found by a successor search from its list's base.

The model backs off: a seen n-gram has its count less a fixed discount, what is taken off is shared among the words that were not seen
after the context, in proportion to the shorter context's probabilities, which add up to one at every level.  Single words have the add-one
estimate with one place for all unknown words.

Levels are cut into files of bounded numbers of tokens or lists, by the first word and by the pair, each built by one task and written to the
shared folder, from where tasks map what they read.  Counts reach the task of a file already summed up per input chunk.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.llm import eliasfano
from forgeclock.llm.common import SPACE, as_bytes, signed, unsigned
from forgeclock.shared import fresh_folder, materialise

#: Steps of a stored log10.
STEPS = 2048
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 6 << 20
#: Words that a task holds before it hands their counts on.
HELD = 1 << 21


def mounted(path: str) -> str:
    """The shared folder as a path that tasks can open; levels are mapped into memory, so it must be mounted on every executor."""
    bare = path.removeprefix("file:")
    if "://" in bare or not bare.startswith("/"):
        raise RuntimeError(f"the n-gram trie is mapped from files: spark.checkpoint.dir must be a mounted folder, not {path}")
    return "/" + bare.lstrip("/")


# ---------------------------------------------------------------- text
_SOLID = np.ones(256, bool)
_SOLID[list(SPACE.encode())] = False
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Tokens:
    """Tokens of some texts: distinct words' hashes, each token's place among them, and where texts begin (with the end of the last one)."""

    hashes: np.ndarray
    at: np.ndarray
    begin: np.ndarray


def word_hashes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given the bytes of all of them and their sizes: a polynomial, mixed with the size."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _BASE)]))
    terms = powers[at]
    terms *= letters.astype(np.uint64) + np.uint64(1)
    out = np.add.reduceat(terms, first) ^ size.astype(np.uint64) * _MIX
    out = (out ^ out >> np.uint64(32)) * _MIX
    out = (out ^ out >> np.uint64(29)) * _BASE
    return out ^ out >> np.uint64(32)


def tokens(texts: list[bytes]) -> Tokens:
    """Lower-cased words of each text and one end."""
    data = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)
    solid = _SOLID[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False))
    begin, end = edges[::2], edges[1::2]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    many = np.diff(np.searchsorted(begin, starts))  # words of each text
    lasts = np.cumsum(many + 1) - 1
    every = np.empty(len(begin) + len(texts), np.uint64)
    inside = np.ones(len(every), bool)
    inside[lasts] = False
    every[inside], every[lasts] = word_hashes(data[solid], end - begin), END
    hashes, at = np.unique(every, return_inverse=True)
    return Tokens(hashes, at, np.concatenate([[0], lasts + 1]))


def chunks(texts: list[bytes]) -> Iterator[Tokens]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield tokens(held)
            held, size = [], 0
    if held:
        yield tokens(held)


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by byte planes, compressed."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").reshape(-1).astype(np.int64) for c in raw]


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sum of the first column for each and the largest value of the others."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    sums = [(np.maximum if i else np.add).reduceat(c[order], first) if len(first) else c for i, c in enumerate(columns)]
    return keys[first], *sums


def code(p: np.ndarray) -> np.ndarray:
    """log10 in steps of 1/2048; 16 bits reach from -16 to 16."""
    return np.clip(np.rint(np.log10(p) * STEPS), -32768, 32767).astype(np.int16)


def decode(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes / STEPS)


# ---------------------------------------------------------------- trie
@functools.lru_cache(maxsize=256)
def _open(path: str) -> dict | None:
    arrays = eliasfano.load(path)
    if arrays is None:
        return None
    out = {k: x for k, x in arrays.items() if "." not in k}
    return out | {p: eliasfano.sequence(arrays, p) for p in {k.split(".")[0] for k in arrays if "." in k}}


def lists_of(list_no: np.ndarray, key: np.ndarray, count: np.ndarray, lists: int, discount: float, lower: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a level's file from n-grams sorted by (list, key); ``lower``: probability of each by the shorter context."""
    many = np.bincount(list_no, minlength=lists)
    total = np.bincount(list_no, weights=count, minlength=lists)
    p = (count - discount) / total[list_no]
    unseen = 1 - np.bincount(list_no, weights=lower, minlength=lists)
    some = many > 0
    back = np.ones(lists)
    back[some] = discount * many[some] / total[some] / np.maximum(unseen[some], 1e-9)
    pointers = np.concatenate([[0], np.cumsum(many)])
    last = np.nonzero(np.concatenate([list_no[1:] != list_no[:-1], [True]]))[0]
    base = np.concatenate([[0], np.cumsum(key[last] + 1)])
    rank = np.cumsum(some) - 1
    values = base[rank[list_no]] + key
    return {
        **eliasfano.named("begin", eliasfano.encode(pointers)), **eliasfano.named("key", eliasfano.encode(values)),
        "p": code(p), "back": code(back),
    }


def search(level: dict, list_no: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of ``key`` in its list's level or -1, place where the list begins); queries are sorted by their lists."""
    new = np.concatenate([[True], list_no[1:] != list_no[:-1]])[: len(list_no)]
    lists, of = list_no[new], np.cumsum(new) - 1
    begin, end = (x.astype(np.int64) for x in level["begin"].between(lists))
    some = np.nonzero(begin < end)[0]
    base, least = np.zeros(len(lists), np.uint64), np.zeros(len(lists), np.uint64)
    last, now = level["key"].between(np.maximum(begin[some] - 1, 0))
    inner = begin[some] > 0
    base[some], least[some] = np.where(inner, last + np.uint64(1), np.uint64(0)), np.where(inner, now, last)
    value, size = base[of] + key.astype(np.uint64), (end - begin)[of]
    place = np.where((size > 0) & (value == least[of]), begin[of], -1)
    rest = np.nonzero((size > 1) & (value > least[of]))[0]  # lists of one need no search
    at, same = level["key"].successor(value[rest])
    place[rest] = np.where(same & (at < end[of[rest]]), at, -1)
    return place, begin[of]


def by_file(files: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(file, places of its queries)."""
    order = np.argsort(files, kind="stable")
    cuts = np.nonzero(np.diff(files[order]))[0] + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(files[part[0]]), part


@dataclass
class Around:
    """A chunk's tokens by ids: ``ids`` of the distinct words (-1: unknown) with the start of a text as the last one, the words' counts, and
    the places among them of each token and of the token before it.
    """

    ids: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    before: np.ndarray


@dataclass
class Pairs:
    """Distinct pairs of a chunk in the order of their ids: file, place there (-1: not in the trie), place among the first word's
    successors, log10 code.  ``of``: the pair that ends at each token; ``back``: code of backing off from each token's first word.
    """

    file: np.ndarray
    place: np.ndarray
    rank: np.ndarray
    p: np.ndarray
    of: np.ndarray
    back: np.ndarray


@dataclass
class Trie:
    """Where the levels lie, and how they are cut."""

    folder: str
    n: int
    v: int
    bits: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    width: int = 1
    lists: int = 1 << 20

    @property
    def start(self) -> int:
        """Id of the start of a text, a context only."""
        return self.v

    def words_file(self, b: int) -> str:
        return f"{self.folder}/words/{b}"

    def pairs_file(self, s: int) -> str:
        return f"{self.folder}/pairs/{s}"

    def triples_file(self, s: int, part: int) -> str:
        return f"{self.folder}/triples/{s}-{part}"

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of words by their hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        rest = np.uint64((1 << (64 - self.bits)) - 1)
        which = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for b, part in by_file(which):
            if (level := _open(self.words_file(b))) is not None:
                place, same = level["hash"].successor(hashes[part] & rest)
                out[part[same]] = place[same] + self.starts[b]
                count[part[same]] = level["count"][place[same]]
        return out, count

    def chance(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single words by their counts; 0 for an unknown one."""
        return (counts + 1.0) / (self.n + self.v + 1.0)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for b, part in by_file(np.searchsorted(self.starts, ids, "right") - 1):
            out[part] = _open(self.words_file(b))["count"][ids[part] - self.starts[b]]
        return out

    def pairs(self, around: Around) -> Pairs:
        """The pairs of words that stand at each token."""
        stride, ids = self.v + 1, around.ids
        words, rank = np.unique(ids, return_inverse=True)
        first, second = ids[around.before], ids[around.at]
        keys, of = np.unique(np.where((first >= 0) & (second >= 0), first * stride + second, -1), return_inverse=True)
        n = len(keys)
        out = Pairs(keys // stride // self.width, np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int16), of, np.zeros(0))
        back = np.zeros(len(words), np.int16)
        for s, part in by_file(words // self.width):
            if s < 0 or (level := _open(self.pairs_file(s))) is None:
                continue
            lists = words[part] - s * self.width
            back[part] = level["back"][lists]
            low, high = np.searchsorted(keys, [(lists[0] + s * self.width) * stride, (lists[-1] + s * self.width + 1) * stride])
            list_no = keys[low:high] // stride - s * self.width
            place, begin = search(level, list_no, keys[low:high] % stride)
            out.place[low:high], out.rank[low:high] = place, place - begin
            out.p[low:high] = np.where(place >= 0, level["p"][place], 0)
        out.back = back[rank][around.before]
        return out

    def triples(self, pairs: Pairs, context: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, codes, codes of backing off) for contexts, as places in ``pairs``, and the next word's rank after their second word (-1: none)."""
        keys, of = np.unique(context << 32 | rank + 1, return_inverse=True)
        found, p, back = np.zeros(len(keys), bool), np.zeros(len(keys), np.int16), np.zeros(len(keys), np.int16)
        ctx, rank = keys >> 32, (keys & 0xFFFFFFFF) - 1
        for s, some in by_file(pairs.file[ctx]):
            for number, part in by_file(pairs.place[ctx[some]] // self.lists):
                part = some[part]
                if number < 0 or (level := _open(self.triples_file(s, number))) is None:
                    continue
                list_no = pairs.place[ctx[part]] - number * self.lists
                inside = list_no < len(level["back"])
                part, list_no = part[inside], list_no[inside]
                back[part] = level["back"][list_no]
                asked = rank[part] >= 0
                part, list_no = part[asked], list_no[asked]
                at, _ = search(level, list_no, rank[part])
                part, at = part[at >= 0], at[at >= 0]
                found[part], p[part] = True, level["p"][at]
        return found[of], p[of], back[of]

    def around(self, chunk: Tokens) -> Around:
        ids, counts = self.ids(chunk.hashes)
        before = np.concatenate([[0], chunk.at[:-1]])
        before[chunk.begin[:-1]] = len(ids)
        return Around(np.append(ids, self.start), counts, chunk.at, before)

    def score(self, chunk: Tokens) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, add-one score, score) of each text of the chunk."""
        around = self.around(chunk)
        counts = around.counts[chunk.at]
        base = np.log10(self.chance(around.counts))[chunk.at]
        pairs = self.pairs(around)
        met = pairs.place[pairs.of] >= 0
        out = np.where(met, pairs.p[pairs.of] / STEPS, base + pairs.back / STEPS)
        follows = np.nonzero((around.before[1:] < len(chunk.hashes)) & met[:-1])[0] + 1  # the two words before are a pair of the trie
        rank = np.where(met[follows], pairs.rank[pairs.of[follows]], -1)
        found, p, back = self.triples(pairs, pairs.of[follows - 1], rank)
        out[follows] = np.where(found, p / STEPS, out[follows] + back / STEPS)
        at = chunk.begin[:-1]
        return np.diff(chunk.begin), np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(out, at)


# ---------------------------------------------------------------- building
def _each_text(work: Callable[[Tokens], Iterator[tuple]], names: list[str]):
    """Batch function: ``work`` on chunks of texts, rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(as_bytes(batch.column(0))):
                rows = list(work(chunk))
                columns = zip(*rows) if rows else [[]] * len(names)
                kinds = [pa.binary() if n == "blob" else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of words, summed up over as many chunks as fit."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        keys, many = summed(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(many)], names=["h", "c"])

    for batch in batches:
        for chunk in chunks(as_bytes(batch.column(0))):
            held.append((signed(chunk.hashes), np.bincount(chunk.at)))
            if sum(len(k) for k, _ in held) > HELD:
                yield out()
    yield out()


def _each_file(work: Callable[..., int], keys: int):
    """Batch function over rows sorted by their keys: ``work(key, list of the other columns' values)`` gives the file's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        made = [work(key, [r[keys:] for r in group]) for key, group in itertools.groupby(rows, key=lambda r: r[:keys])]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], names=["entries"])

    return run


def _built(rows: DataFrame, keys: list[str], work: Callable[..., int]) -> int:
    """Run ``work`` once per key; entries made in all."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_each_file(work, len(keys)), "entries long").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]


def train(texts: DataFrame, discount: float = 0.75, words_a_file: int = 1 << 20, tokens_a_file: int = 1 << 21, lists_a_file: int = 1 << 20) -> Trie:
    """The trie of all texts (``text``; null: empty), in the shared folder; the sizes of its files change no score."""
    spark: SparkSession = texts.sparkSession
    texts = texts.select("text")

    words = texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    words = materialise(words, "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    trie = Trie(mounted(fresh_folder(spark, "ngrams")), n, v, max(0, -(-v // words_a_file) - 1).bit_length(), lists=lists_a_file)
    if not v:
        return trie
    _words(trie, words)
    trie.width = -(-(v + 1) // -(-n // tokens_a_file))
    _pairs(trie, texts, discount)
    _triples(trie, texts, discount)
    return trie


def _words(trie: Trie, words: DataFrame) -> None:
    """First level: files by the hashes' first bits."""
    rest = np.uint64((1 << (64 - trie.bits)) - 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            b, h, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for bucket, part in by_file(b):
                held.setdefault(bucket, []).append((unsigned(h[part]) & rest, c[part]))
        for bucket, parts in held.items():
            h, c = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h)
            eliasfano.store(trie.words_file(bucket), {**eliasfano.named("hash", eliasfano.encode(h[order])), "count": c[order]})
        sizes = [pa.array(x, pa.int64()) for x in (list(held), [sum(len(p[0]) for p in x) for x in held.values()])]
        yield pa.RecordBatch.from_arrays(sizes, names=["b", "size"])

    bucket = F.shiftrightunsigned("h", 64 - trie.bits) if trie.bits else F.lit(0).cast("long")
    dealt = words.select(bucket.alias("b"), "h", "c").repartition("b")
    sizes = np.zeros(1 << trie.bits, np.int64)
    for row in dealt.mapInArrow(write, "b long, size long").collect():  # a row for each million words
        sizes[row["b"]] = row["size"]
    trie.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _pairs(trie: Trie, texts: DataFrame, discount: float) -> None:
    """Second level: files by ranges of the first word's id."""
    stride, width = trie.v + 1, trie.width

    def counted(chunk: Tokens) -> Iterator[tuple]:
        around = trie.around(chunk)
        keys, many = np.unique(around.ids[around.before] * stride + around.ids[around.at], return_counts=True)
        for s, part in by_file(keys // stride // width):
            begin = keys[part] - s * width * stride
            yield s, pack(np.diff(begin, prepend=0), many[part])

    def build(key: tuple, blobs: list[tuple]) -> int:
        parts = [unpack(b, 2) for (b,) in blobs]
        keys, count = summed(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]))
        word = keys % stride
        lists = min(width, stride - key[0] * width)
        made = lists_of(keys // stride, word, count, lists, discount, trie.chance(trie.counts(word)))
        eliasfano.store(trie.pairs_file(key[0]), made)
        return len(keys)

    _built(texts.mapInArrow(_each_text(counted, ["file", "blob"]), "file long, blob binary"), ["file"], build)


def _triples(trie: Trie, texts: DataFrame, discount: float) -> None:
    """Third level: files by pairs, a range of a second-level file's places in each."""

    def counted(chunk: Tokens) -> Iterator[tuple]:
        around = trie.around(chunk)
        pairs = trie.pairs(around)
        after = np.nonzero(around.before < len(chunk.hashes))[0]
        seen, many = np.unique(pairs.of[after - 1] << 32 | pairs.rank[pairs.of[after]], return_counts=True)
        which, rank = seen >> 32, seen & 0xFFFFFFFF
        last = np.zeros(len(seen), np.int64)  # code of the last two words
        last[np.searchsorted(seen, pairs.of[after - 1] << 32 | pairs.rank[pairs.of[after]])] = -pairs.p[pairs.of[after]].astype(np.int64)
        for s, part in by_file(pairs.file[which]):
            keys, count, codes = pairs.place[which[part]] << 32 | rank[part], many[part], last[part]
            for number, some in by_file((keys >> 32) // trie.lists):
                yield s, number, pack(np.diff(keys[some] - (number * trie.lists << 32), prepend=0), count[some], codes[some])

    def build(key: tuple, blobs: list[tuple]) -> int:
        parts = [unpack(b, 3) for (b,) in blobs]
        keys, count, codes = summed(
            np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))
        )
        list_no = keys >> 32
        made = lists_of(list_no, keys & 0xFFFFFFFF, count, int(list_no[-1]) + 1, discount, decode(-codes))
        eliasfano.store(trie.triples_file(*key), made)
        return len(keys)

    rows = texts.mapInArrow(_each_text(counted, ["file", "part", "blob"]), "file long, part long, blob binary")
    _built(rows, ["file", "part"], build)


# ---------------------------------------------------------------- scores
def scored(docs: DataFrame, trie: Trie) -> DataFrame:
    """row, n_tokens, n_known, base_score, score: each row of ``docs`` as a struct with its text's figures.

    ``base_score`` is the add-one score of single words, ``score`` the trie's.  Null counts as empty: one token, the end.  Very long texts are
    scored whole.  Equal texts have equal scores.  Empty table: no rows.  Null ids and columns with other names don't matter.
    """

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def figures(texts: pa.Array) -> pa.Array:
        parts = [trie.score(c) for c in chunks(as_bytes(texts))]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [pa.array(np.concatenate(x), k) for x, k in zip(zip(*parts), kinds)] if parts else [pa.array([], k) for k in kinds]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.struct("*").alias("row"), figures("text").alias("s"))
    return out.select("row", "s.*")


def delete(trie: Trie) -> None:
    """Remove the levels once scores are stored."""
    for top, _, files in os.walk(trie.folder, topdown=False):
        for name in files:
            os.remove(f"{top}/{name}")
        os.rmdir(top)
