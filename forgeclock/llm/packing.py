"""Best-fit packing of documents into sequences of bounded length (operator 2).

Documents, cut into pieces of at most ``capacity`` tokens, are range-sorted by falling length and numbered.  Lengths and
gaps are integers up to ``capacity``, so equally long documents and sequences with equal gaps are contiguous runs of
numbers.  A superstep handles all documents of one length at once: a sweep finds the successor run (the smallest gap that
fits), ranks within the runs decide which document gets which gap, gaps shrink, and the next run follows until
the length is done; what found no gap opens new sequences.  That equals best-fit decreasing document by document.  The sweep
sees runs only: its state is bounded by ``capacity``, never by the number of documents.  Counting, sorting,
numbering and placing the documents are distributed.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.llm.common import as_text
from forgeclock.llm.sharding import numbered
from forgeclock.llm.tokens import encoder

END = 2


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first one takes what does not fill a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(capacity: int):
    """Column function: text -> its pieces (start, length, checksum of the ids)."""

    @F.arrow_udf("array<struct<start: bigint, length: bigint, ids_crc32: bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        encode, out = encoder(), []
        for text in as_text(texts):
            raw = memoryview(array("I", [*encode(text), END]).tobytes())
            out.append(
                [
                    {"start": a, "length": k, "ids_crc32": zlib.crc32(raw[4 * a : 4 * (a + k)])}
                    for a, k in pieces_of(len(raw) // 4, capacity)
                ]
            )
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return pieces


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placement runs, by first document number: (number, per_gap, sequence, offset, length).

    Documents from ``number`` on fill gaps from ``sequence`` on, ``per_gap`` in each, the first at ``offset``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    sizes: list[int] = []  # the gaps that occur, rising
    placed, number, opened = [], 0, 0

    def add(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            each = gap // length
            full = min(many, left // each)
            if full:
                placed.append((number, each, first, capacity - gap, length))
                add(gap - each * length, (first, full))
                number, left, first, many = number + full * each, left - full * each, first + full, many - full
            if many and left and left < each:
                placed.append((number, left, first, capacity - gap, length))
                add(gap - left * length, (first, 1))
                number, left, first, many = number + left, 0, first + 1, many - 1
            if many:
                add(gap, (first, many))
    return np.array(placed, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of ``docs``.

    Null or empty text: one piece, the end token alone.  Only documents above ``capacity`` tokens are cut.  Null ids and
    repeated rows are packed like any other.  Ties (equal lengths) go by doc_id and piece.  Empty table: no rows.  Other columns are
    ignored.
    """
    cut = docs.select("doc_id", F.posexplode(token_pieces(capacity)("text")).alias("piece", "p"))
    pieces = cut.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")
    named = numbered(pieces, [F.desc("length"), F.col("doc_id"), F.col("piece")], "number")
    counts = {r["length"]: r["count"] for r in named.groupBy("length").count().collect()}  # capacity rows at most
    runs = sweep(counts, capacity)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def placed(numbers: pa.Array) -> pa.Array:
        x = numbers.to_numpy(zero_copy_only=False)
        first, each, sequence, offset, length = runs[np.searchsorted(runs[:, 0], x, "right") - 1].T
        rank = x - first
        arrays = [pa.array(sequence + rank // each), pa.array(offset + rank % each * length)]
        return pa.StructArray.from_arrays(arrays, names=["sequence_id", "offset"])

    out = named.withColumn("place", placed("number"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """(sequence_id, ids): the packed token ids, at most ``capacity`` each; for docs with distinct, non-null ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder()
        return pa.array([[*encode(t), END] for t in as_text(texts)], pa.list_(pa.int32()))

    part = F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    parts = docs.select("doc_id", ids("text").alias("ids")).join(packed, "doc_id")
    parts = parts.select("sequence_id", "offset", part.alias("ids"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return parts.groupBy("sequence_id").agg(joined.alias("ids"))
