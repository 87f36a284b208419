"""SimHash near-duplicates by anchor-point covering (operator 9).

Anchors are the words of a covering code: two perfect binary Golay codes of length 23 (covering radius 3 each) side by
side on the low 46 bits, while the other 18 bits are free.  Every fingerprint has exactly one nearest anchor, its home.
Two fingerprints at distance ``t`` or less have a midpoint within ``ceil(t/2)`` of both, and the home of that midpoint lies
within the covering radius plus ``ceil(t/2)`` of both.  So each fingerprint is replicated to all anchors within the covering
radius plus its half of the threshold, counted per block, and fingerprints are compared per anchor.  A link is
reported at the home of its midpoint only: once.

Anchors with many fingerprints are cut into slices, and each pair of slices is compared in a task of its own, so no
group grows without bound and none is cut short.

The pipeline's near-dedup stage wants every pair above a Jaccard similarity, which no number of differing bits gives.  It links texts by
fingerprints of their words in the same way, decides each link by the texts' shingles, and then joins those that are still apart by their
rarest shingles (prefix filter), so that no pair is missed.  Shingles are fetched for pairs only that small sketches of the sets don't rule out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_bytes, key_filter, may_hold, passes, share_of_hash, signed, text_key, unsigned
from forgeclock.llm.components import components
from forgeclock.shared import discard, materialise

SEED = 42
BLOCK, CHECK_BITS, RADIUS = 23, 11, 3
#: Fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GENERATOR = 0b110001110101
#: More fingerprints than this at one anchor are compared in slices.
SLICE = 2048


# ---------------------------------------------------------------- fingerprints
def bit_votes(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The 64 bits that more than half of the (weighted) hashes have set; no hash: zero."""
    if not len(hashes):
        return 0
    votes, total = np.zeros(64), 0.0
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        if weights is None:
            votes += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
        else:
            votes += weights[i : i + (1 << 16)] @ bits
            total += float(weights[i : i + (1 << 16)].sum())
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` lower-cased words, repeats included; a shorter text is one run."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, parts), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    runs = zip(starts, ends[words - 1 :])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in runs), np.uint64, len(parts) - words + 1)


def fingerprint(words: int):
    """Column function: text -> SimHash of its word shingles, as a signed long."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(signed(np.array([bit_votes(shingle_hashes(t, words)) for t in as_bytes(texts)], np.uint64)))

    return simhash


# ---------------------------------------------------------------- covering code
def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(BLOCK - 1, CHECK_BITS - 1, -1):
        out ^= np.where(out >> np.uint64(bit) & np.uint64(1), np.uint64(GENERATOR << (bit - CHECK_BITS)), np.uint64(0))
    return out


def _patterns(weight: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(BLOCK), weight)], np.uint64)


class Covering:
    """Error patterns by syndrome: ``at[e]`` has those that lead to an anchor at the radius plus exactly ``e``."""

    def __init__(self, excess: int) -> None:
        self.at = []
        for e in range(excess + 1):
            found = np.concatenate([_patterns(w) for w in (range(RADIUS + 1) if e == 0 else (RADIUS + e,))])
            syndrome = _remainder(found).astype(np.int64)
            order = np.argsort(syndrome, kind="stable")
            self.at.append((found[order], np.searchsorted(syndrome[order], np.arange((1 << CHECK_BITS) + 1))))

    def near(self, block: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for every anchor at the radius plus ``e`` of each 23-bit block."""
        patterns, begin = self.at[e]
        syndrome = _remainder(block).astype(np.int64)
        many = begin[syndrome + 1] - begin[syndrome]
        row = np.repeat(np.arange(len(block)), many)
        step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return row, (block[row] ^ patterns[begin[syndrome][row] + step]) >> np.uint64(CHECK_BITS)

    def home(self, prints: np.ndarray) -> np.ndarray:
        low, high = blocks(prints)
        return self.near(low, 0)[1] << np.uint64(12) | self.near(high, 0)[1]

    def replicas(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of all anchors whose excesses over the two blocks add up to ``len(at) - 1`` or less."""
        low, high = blocks(prints)
        rows, anchors = [], []
        for a in range(len(self.at)):
            row, left = self.near(low, a)
            for b in range(len(self.at) - a):
                again, right = self.near(high[row], b)
                rows.append(row[again])
                anchors.append(left[again] << np.uint64(12) | right)
        return np.concatenate(rows), np.concatenate(anchors)


def blocks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOCK) - 1)
    return prints & mask, prints >> np.uint64(BLOCK) & mask


def midpoint(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x`` with the lower half of the bits flipped in which it differs from ``y``."""
    rest = x ^ y
    left = np.bitwise_count(rest) // 2
    z = x.copy()
    while left.any():
        low = rest & (~rest + np.uint64(1))
        z ^= np.where(left > 0, low, np.uint64(0))
        rest ^= low
        left = np.where(left > 0, left - 1, 0)
    return z


# ---------------------------------------------------------------- links
def links(nodes: DataFrame, threshold: int) -> DataFrame:
    """(a, b) long: each pair of node ids whose fingerprints differ in ``threshold`` bits or fewer, once.

    ``nodes`` has (id, fp), both long and ids distinct; it is read more than once, so pass a written table.
    """
    excess = -(-threshold // 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Covering(excess)
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(ids), 4096):
                row, anchor = code.replicas(unsigned(prints[i : i + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64)), pa.array(prints[i : i + 4096][row]), pa.array(ids[i : i + 4096][row])],
                    names=["anchor", "fp", "id"],
                )

    replicas = nodes.select("id", "fp").mapInArrow(spread, "anchor long, fp long, id long")
    crowded = replicas.groupBy("anchor").count().where(F.col("count") > SLICE)
    crowded = materialise(crowded.select("anchor", F.ceil(F.col("count") / SLICE).cast("int").alias("slices")), "crowded")
    dealt = replicas.join(crowded, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda j: F.least("slice", j) * F.col("slices") + F.greatest("slice", j),
    )
    dealt = dealt.withColumn("tile", F.explode(tiles)).select(
        "anchor", "tile", "fp", "id", "slice",
        (F.floor(F.col("tile") / F.col("slices")) == F.col("tile") % F.col("slices")).alias("own"),
    )
    return (
        dealt.repartition("anchor", "tile")
        .sortWithinPartitions("anchor", "tile")
        .mapInArrow(_comparer(threshold, excess), "a long, b long")
    )


def _comparer(threshold: int, excess: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, kept = Covering(excess), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                now = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
                same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
                ready, kept = [x[~same] for x in now], [x[same] for x in now]
            elif kept is None:
                return
            else:
                ready = kept
            found = _sweep(*ready, code, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return compare


def _sweep(anchor, tile, fp, ids, part, own, code: Covering, threshold: int):
    """Compare each row with the next, the one after it and so on, as long as both lie in one group."""
    prints, a, b = unsigned(fp), [], []
    at, step = np.arange(len(anchor)), 0
    while True:
        step += 1
        at = at[at + step < len(anchor)]
        at = at[(anchor[at] == anchor[at + step]) & (tile[at] == tile[at + step])]
        if not len(at):
            break
        to = at + step
        hit = (np.bitwise_count(prints[at] ^ prints[to]) <= threshold) & (own[at] | (part[at] != part[to]))
        i, j = at[hit], to[hit]
        first = prints[i] <= prints[j]
        i, j = np.where(first, i, j), np.where(first, j, i)
        here = code.home(midpoint(prints[i], prints[j])).astype(np.int64) == anchor[i]
        a.append(ids[i[here]])
        b.append(ids[j[here]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: smallest doc_id that links lead to, the row's own included.

    Null or empty text: no shingle, fingerprint zero, linked like any other.  Fewer than ``words`` words: one shingle.
    Null doc_id: kept; the component's id is null only if all its ids are.  Repeated rows stay.  Other columns are ignored.
    """
    prints = materialise(docs.select("doc_id", fingerprint(words)("text").alias("fp")), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = materialise(links(nodes.select(F.col("fp").alias("id"), "fp"), threshold), "links")
    member = components(linked).select(F.col("node").alias("fp"), "root")
    labelled = nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = materialise(
        labelled.groupBy("root").agg(F.min("first").alias("component_id")), "smallest"
    )
    label = materialise(labelled.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "label")
    return prints.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- pipeline form
#: Slack for products of a similarity and a count, which floats don't give exactly.
EPS = 1e-9
#: Shingles whose frequency is told apart, at most: fixed, as it only decides how many candidates there are.
COMMON = 1 << 18


def word_print(text: bytes) -> int:
    """SimHash of the lower-cased words, weighted by 1 + ln(count): few edits change few bits, whatever shingles they touch."""
    counts: dict[bytes, int] = {}
    for w in text.lower().split():
        counts[w] = counts.get(w, 0) + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    return bit_votes(hashes, 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """Words of 64 bits: for each of as many classes of hashes as there are shingles (a power of two), whether it holds an odd number of them.

    Of two sets, folded to the same number of classes, bits differ only in classes with a shingle that one set alone has.
    """
    width = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def shingles(words: int):
    """Column function: text -> its distinct shingles."""

    @F.arrow_udf("array<bigint>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([signed(shingle_set(t, words)) for t in as_bytes(texts)], pa.list_(pa.int64()))

    return distinct


def set_key(found: np.ndarray) -> int:
    """Key of a sorted set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def keyed_shingles(words: int, bits: np.ndarray):
    """Column function: (hash, text) -> the text's distinct shingles ``s`` and their key ``id``; null where the filter knows better."""

    @F.arrow_udf("struct<id: bigint, s: array<bigint>>")
    def keyed(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        wanted = passes(bits, unsigned(hashes.to_numpy(zero_copy_only=False)))
        sets: list = [None] * len(wanted)
        for i, text in zip(np.nonzero(wanted)[0].tolist(), as_bytes(texts.filter(pa.array(wanted)))):
            sets[i] = shingle_set(text, words)
        ids = signed(np.array([0 if x is None else set_key(x) for x in sets], np.uint64))
        lists = pa.array([None if x is None else signed(x) for x in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(ids), lists], names=["id", "s"], mask=pa.array(~wanted))

    return keyed.asNondeterministic()  # else the filter on its result would work it out a second time


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), sorted: at most ``COMMON`` of the shingles that a sixteenth of the texts has twice or more.

    They only order the shingles: whatever is listed, no pair of near copies is missed.
    """
    share = max(1 / 16, 4000 / max(1, rows.count()))
    sample = rows.where(share_of_hash(F.col("th"), 23) < share).select(F.explode(shingles(words)("text")).alias("s"))
    counts = materialise(sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "common")
    sizes = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)
    upto = itertools.accumulate(many for _, many in sizes)
    least = min((n for (n, _), sum_ in zip(sizes, upto) if sum_ <= COMMON), default=1 << 62)
    found = counts.where(F.col("n") >= least).toPandas()  # bounded by ``COMMON``
    s, n = unsigned(found["s"].to_numpy(np.int64)), found["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def first_shingles(words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    """Column function: text -> key of its set of shingles, their number and sketch, its word fingerprint, and its rarest shingles.

    Two sets with this Jaccard similarity or more share one of the rarest ``n - ceil(similarity * n) + 1`` of each, in any
    order that is the same for all sets.
    """
    known, count = common

    @F.arrow_udf("struct<id: bigint, n: int, fp: bigint, sketch: array<bigint>, rare: array<bigint>>")
    def first(texts: pa.Array) -> pa.Array:
        ids, sizes, prints, sketches, rare = [], [], [], [], []
        for text in as_bytes(texts):
            found = shingle_set(text, words)
            ids.append(set_key(found))
            sizes.append(len(found))
            prints.append(word_print(text))
            sketches.append(signed(parity_sketch(found)))
            if len(known) and len(found):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                found = found[np.lexsort((found, np.where(known[at] == found, count[at], 0)))]
            rare.append(signed(found[: len(found) - int(np.ceil(similarity * len(found) - EPS)) + 1]))
        keys, marks = (pa.array(signed(np.array(x, np.uint64))) for x in (ids, prints))
        lists = (pa.array(x, pa.list_(pa.int64())) for x in (sketches, rare))
        return pa.StructArray.from_arrays([keys, pa.array(sizes, pa.int32()), marks, *lists], names=["id", "n", "fp", "sketch", "rare"])

    return first


def _possible(similarity: float):
    """Sizes, and what can follow after a shingle at ``pos`` on either side, allow the similarity."""
    n, m, after = F.col("x.n"), F.col("y.n"), F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - EPS) & (after >= similarity / (1 + similarity) * (n + m) - EPS)


def _pairs(met: DataFrame, similarity: float) -> DataFrame:
    x, y = F.col("x.id"), F.col("y.id")
    return met.where(_possible(similarity)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _folded(sketch: Column, words: Column) -> Column:
    """The sketch with its classes put together to as many as ``words`` words hold."""
    word = lambda i: F.aggregate(F.sequence(i, F.size(sketch) - 1, words), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(sketch, j)))
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def possible(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity: no similar pair goes, and few stay far below it.

    ``prints`` has (id, n, sketch).  At least as many shingles are in one set only as bits of the sketches differ, and of two
    similar sets with ``n`` and ``m`` shingles at most ``(1 - similarity) / (1 + similarity) * (n + m)`` are.
    """
    left, right = (prints.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"k{k}")) for k in "ab")
    words = F.least(F.size("ka"), F.size("kb"))
    unlike = F.zip_with(_folded(F.col("ka"), words), _folded(F.col("kb"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    alone = F.aggregate(unlike, F.lit(0), lambda x, y: x + y)
    fits = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - EPS
    near = alone <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 2 * EPS
    return pairs.join(left, "a").join(right, "b").where(fits & near).select("a", "b")


def _similar(pairs: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is high enough, stored.

    Sets are far larger than their sketches, and most pairs are far from similar: only sets in a pair that the sketches allow are built,
    and dealt by their keys once.
    """
    pairs = materialise(possible(pairs, prints, similarity), "possible")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(ids)
    left, right = (sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both >= similarity * (F.size("sa") + F.size("sb") - both) - EPS
    return materialise(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "similar")


def by_fingerprint(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(similar, tried), both stored pairs (a, b) of set ids: those whose fingerprints link them, and which of these are similar.

    ``prints`` has (id, n, fp, sketch) with distinct ids and is a written table.  Sets with one fingerprint are compared with the first of
    them, and the first ones of fingerprints within ``threshold`` bits with each other.  Sets without shingles have no copies but themselves.
    """
    prints = prints.where("n > 0")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    own = prints.join(nodes, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    across = links(nodes.select(F.col("first").alias("id"), "fp"), threshold)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = materialise(own.unionByName(across), "tried")
    return _similar(tried, prints, sets_of, similarity), tried


def still_apart(
    keyed: DataFrame, near: DataFrame, tried: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float
) -> DataFrame:
    """Stored pairs (a, b) of similar sets that put together all that the similar pairs ``near`` leave apart.

    ``keyed`` has (id, n, rare, root), a set's root being its group by ``near``, and ``prints`` (id, n, sketch);
    pairs ``tried`` need no second look.  Of two similar sets, the smaller one has some shared shingle early: enough of it follows for both.  So a shingle that nobody has
    early makes no pair, and no two sets are paired by one that both have late, as a passage is that fills most of many texts.
    First all sets with a shingle in common are compared with one of them, so groups of near copies come together without all
    their pairs; then, per shingle, every pair of sets that are still apart is.
    """
    early = (F.col("n") - F.col("pos")) * (1 + similarity) >= 2 * similarity * F.col("n") - EPS
    spread = keyed.select("id", "n", "root", F.posexplode("rare").alias("pos", "s"))
    shared = spread.groupBy("s").agg(F.max(early).alias("any"), F.count("*").alias("sets"))  # narrow: most shingles are of one set, and go here
    met = materialise(spread.join(shared.where("any AND sets > 1").select("s"), "s").withColumn("early", early), "met")
    head = met.where("early").groupBy("s").agg(F.min(F.struct("id", "n", "pos", "root")).alias("h")).select("s", "h.*")
    star = met.alias("x").join(head.alias("y"), "s").where("x.root != y.root")
    star = materialise(_pairs(star, similarity).join(tried, ["a", "b"], "left_anti"), "star")
    more = _similar(star, prints, sets_of, similarity)

    root = components(materialise(near.unionByName(more), "so_far")).select(F.col("node").alias("id"), "root")
    placed = met.drop("root").join(root, "id", "left").select("s", "id", "n", "pos", "early", F.coalesce("root", "id").alias("root"))
    placed = materialise(placed, "placed")
    discard(met)
    apart = placed.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    between = materialise(placed.join(apart.select("s"), "s", "left_semi"), "apart")
    discard(placed)
    smaller = "x.n < y.n OR x.n = y.n AND x.id < y.id"
    met = between.where("early").alias("x").join(between.alias("y"), "s").where(f"x.root != y.root AND ({smaller})")
    seen = star.unionByName(tried)
    rest = materialise(_pairs(met, similarity).join(seen, ["a", "b"], "left_anti"), "rest")
    discard(between)
    return materialise(more.unionByName(_similar(rest, prints, sets_of, similarity)), "later")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Two texts link if the sets of their ``words``-word shingles (as 64-bit hashes) have Jaccard ``similarity`` or more, whatever
    their length.  Fingerprints of words within ``threshold`` bits (anchor covering) name the pairs to compare; what they
    leave apart is joined by rare shingles, so no pair is missed.  Groups are connected components.  All columns stay as they are.  Repeated rows and null
    ids: one row of a group stays, a null id only if no other exists.  Texts without words form one group; null counts as empty.
    Rows that surely stay are told by a filter and are not shuffled.
    """
    rows = docs.select(F.struct("*").alias("row"))
    doc_id, th = F.col("row.doc_id"), text_key(F.col("row.text"))
    named = [doc_id.alias("doc_id"), th.alias("th"), F.xxhash64(doc_id, th).alias("h")]
    texts = rows.select(*named, F.col("row.text").alias("text"))
    first = first_shingles(words, similarity, common_shingles(texts, words))
    marks = materialise(texts.select("doc_id", "th", "h", first("text").alias("m")).select("doc_id", "th", "h", "m.*"), "marks")
    prints = marks.groupBy("id").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    prints = materialise(prints, "prints")

    def sets_of(ids: DataFrame) -> DataFrame:
        chosen = prints.join(ids, "id", "left_semi").select("h")
        some = texts.select(keyed_shingles(words, key_filter(chosen))("h", "text").alias("m")).where("m IS NOT NULL")
        return some.select("m.id", "m.s").dropDuplicates(["id"])

    near, tried = by_fingerprint(prints, sets_of, similarity, threshold)
    root = components(near).select(F.col("node").alias("id"), "root")
    keyed = marks.groupBy("id").agg(F.first("n").alias("n"), F.first("rare").alias("rare")).join(root, "id", "left")
    keyed = materialise(keyed.select("id", "n", "rare", F.coalesce("root", "id").alias("root")), "keyed")
    narrow = materialise(marks.select("doc_id", "th", "h", "id"), "narrow")
    discard(marks)
    later = still_apart(keyed, near, tried, prints, sets_of, similarity)
    member = components(materialise(near.unionByName(later), "links")).select(F.col("node").alias("id"), "root")
    grouped = narrow.join(member, "id", "left").select("doc_id", "th", "h", F.coalesce("root", "id").alias("root"))
    grouped = materialise(grouped, "grouped")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "h")).alias("best")
    stays = grouped.groupBy("root").agg(best).select("best.h", "best.th", F.lit(True).alias("stays"))
    copies = grouped.groupBy("h", "th").agg(F.count("*").alias("copies"))
    told = copies.join(stays, ["h", "th"], "left").where("stays IS NULL OR copies > 1")
    told = materialise(told, "told")
    discard(prints, keyed, narrow, grouped)
    may = may_hold(key_filter(told))(F.col("h"))
    asked = rows.select("row", *named[1:]).withColumn("may", may)
    sure = asked.where(~F.col("may")).select("row.*")
    doubtful = asked.where("may").join(told, ["h", "th"], "left").where("copies IS NULL OR stays")
    once = doubtful.where("copies IS NULL").select("row.*")
    again = doubtful.where("copies > 1").dropDuplicates(["h", "th"]).select("row.*")
    return sure.unionByName(once).unionByName(again)
