"""Feistel sharding (operator 10): a reproducible shuffle whose places are computed, not stored.

Rows get global numbers in the order of (doc_id, size, checksum, text hash).  A keyed Feistel network permutes the
numbers; its domain is the next even power of two, and numbers that fall outside the row count walk on along their cycle
until they return.  Shard and slot are the permuted number modulo and divided by the shard count, and ``row_at`` finds the
row of any shard and slot again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeclock.llm.common import text_key
from forgeclock.shared import materialise

ROUNDS = 6


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in the given order, stored.

    One range sort; a row's number is its place in its range plus the sizes of the ranges before it.  Ties are broken by
    place in the stored input, so a value that very many rows share is dealt over many ranges.
    """
    stored = materialise(rows, f"{name}-rows").withColumn("__tie", F.monotonically_increasing_id())
    ordered = stored.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = materialise(ordered.withColumn("__at", F.monotonically_increasing_id()), f"{name}-sorted")
    placed = placed.withColumns(
        {"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = placed.groupBy("__part").agg((F.max("__at") + 1).alias("__size"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    joined = placed.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")


class Feistel:
    """Permutation of 0 .. n-1 chosen by a seed, with its inverse; works on whole arrays."""

    def __init__(self, n: int, seed: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, (max(2, n - 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, ROUNDS, dtype=np.uint64) | np.uint64(1)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        z = (x + key) * key
        z = (z ^ z >> np.uint64(32)) * (key | np.uint64(1 << 63))
        return (z ^ z >> np.uint64(29)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if back:
            for key in self.keys[::-1]:
                left, right = right ^ self._mix(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._mix(right, key)
        return left << self.half | right

    def walk(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(numbers.astype(np.uint64), back)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)


def place(number: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    at = Feistel(n, seed).walk(number)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number at a shard and slot."""
    return Feistel(n, seed).walk(np.asarray(slot) * shards + np.asarray(shard), back=True)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, number, shard, slot for every row; shard sizes differ by one at most.

    Null text counts as empty (size 1).  Null ids come first in the numbering.  Ties: rows with equal id and text are
    interchangeable, so any order among them gives the same result.  Empty table: no rows.  Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("th"),
    )
    named = numbered(rows, ["doc_id", "size", "text_crc32", "th"], "number")
    n = named.count()

    @F.arrow_udf("struct<shard: int, slot: bigint>")
    def placed(numbers: pa.Array) -> pa.Array:
        shard, slot = place(numbers.to_numpy(zero_copy_only=False), n, shards, seed)
        return pa.StructArray.from_arrays([pa.array(shard.astype(np.int32)), pa.array(slot)], names=["shard", "slot"])

    out = named.withColumn("place", placed("number"))
    return out.select("doc_id", "size", "text_crc32", "number", "place.shard", "place.slot")
