"""Small helpers the training-data operators share.

Rows travel as a struct next to an operator's own columns wherever a whole row must survive, so extra columns of the
caller can never clash with internal names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts here; ``bytes.split()`` and ``bytes.strip()`` use the same set.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(work: Callable) -> Callable:
    """Let Python workers import this package from where the driver has it; ``work`` takes the session first.

    On a cluster without that folder the package is shipped by ``--py-files`` as usual, and this changes nothing.
    """

    @functools.wraps(work)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
        if root not in paths:
            environment["PYTHONPATH"] = ":".join([root, *paths])
        return work(spark, *args, **kwargs)

    return run


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def as_text(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def text_key(text: Column) -> Column:
    """64 bits of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def share_of_hash(key: Column, salt: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(rows: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of ``key``, so the choice doesn't depend on partitioning.

    Used for fitting models only.  Fewer rows than ``most``: all of them.
    """
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(share_of_hash(F.col(key), salt) < most / total)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64, copy=False).view(np.uint64)


#: Bits of a filter of keys: a fixed 2 MB, whatever the number of keys.
FILTER_BITS = 24


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bit set of the first bits of a column ``h`` of hashes; its size is fixed, so at most 2^18 rows are collected."""
    spot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    word = F.shiftright(spot, 6).alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int")).alias("mask")
    rows = keys.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the keys; False is certain."""
    spot = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_hold(bits: np.ndarray):
    """Column function: hash -> whether it may be among the filter's keys."""

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(passes(bits, unsigned(hashes.to_numpy(zero_copy_only=False))))

    return may
