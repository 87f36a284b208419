"""Line dedup over levelled sorted runs of line hashes (operator 6).

A line's key is its text stripped of white space at both ends with A-Z lower-cased.  A key of at least ``min_chars`` code
points that at least ``min_docs`` documents hold loses all its lines, except in the document with the largest id.

Keys are 128-bit hashes.  Documents arrive in batches by falling doc_id, so the first batch that shows a key also shows
its keeper.  Each batch is counted, merge-anti-joined with the settled keys of every run (those already in ``min_docs``
documents need no further count), and stored as a new run; full levels are merged into one run of the next level.
Runs are tables bucketed and sorted by key, so anti-joins and merges read them in order and shuffle only the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.llm.common import SPACE, as_bytes, text_key
from forgeclock.shared import fresh_folder, materialise

#: A null id is smaller than all others.
NO_ID = -(1 << 63)
_STRIP = SPACE.encode()


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, None for a shorter key."""
    line = line.strip(_STRIP)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _long(part: bytes) -> int:
    return int.from_bytes(part, "big", signed=True)


def line_keys(min_chars: int):
    """Column function: text -> distinct keys of its long lines."""

    @F.arrow_udf("array<struct<k1: bigint, k2: bigint>>")
    def keys(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
        out = []
        for text in as_bytes(texts):
            found = {_key(x, min_chars) for x in text.split(b"\n")} - {None}
            out.append([{"k1": _long(k[:8]), "k2": _long(k[8:])} for k in sorted(found)])
        return pa.array(out, kind)

    return keys


def without_lines(min_chars: int):
    """Column function: (text, keys to drop) -> (text without these lines, lines before, lines dropped)."""

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, before, dropped = [], [], []
        for text, drop in zip(as_bytes(texts), drops.to_pylist()):
            lines = text.split(b"\n")
            stay = lines
            if drop:
                gone = {k["k1"].to_bytes(8, "big", signed=True) + k["k2"].to_bytes(8, "big", signed=True) for k in drop}
                stay = [x for x in lines if _key(x, min_chars) not in gone]
            kept.append(b"\n".join(stay).decode())
            before.append(len(lines))
            dropped.append(len(lines) - len(stay))
        arrays = [pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.StructArray.from_arrays(arrays, names=["text", "n_lines", "n_dropped"])

    return cut


class Runs:
    """Levels of sorted runs (k1, k2, n_docs, keeper); a level of ``fanout`` runs becomes one run of the next."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int, fanout: int) -> None:
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _store(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
        writer.option("path", fresh_folder(self.spark, name)).saveAsTable(name)
        self.made.append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs merge by full outer joins, bucket by bucket.  (Not by a union: Spark 4.1 trusts a union's partitioning even where a scan ignores its buckets.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnsRenamed({"n_docs": "n_more", "keeper": "other"})
            out = out.join(more.hint("merge"), ["k1", "k2"], "full").select(
                "k1", "k2",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "other").alias("keeper"),
            )
        return out

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, counted: DataFrame) -> None:
        """Anti-join a batch with all runs' settled keys and store the rest as a run."""
        for name in self.names():
            settled = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
            counted = counted.join(settled.hint("merge"), ["k1", "k2"], "left_anti")
        self._push(0, self._store(counted.repartition(self.buckets, "k1", "k2")))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._store(self._merged(full)))

    def frequent(self) -> DataFrame:
        """(k1, k2, keeper) of the keys in ``min_docs`` documents or more."""
        return self._merged(self.names()).where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keeper")


def drop_keys(lines: DataFrame, batches: int, buckets: int, min_docs: int, fanout: int) -> DataFrame:
    """(doc, th, k1, k2) of the lines to drop, from written lines with the same columns."""
    spark = lines.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.select("doc").distinct().approxQuantile("doc", shares, 0.01) if shares else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    runs = Runs(spark, buckets, min_docs, fanout)
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        batch = lines
        batch = batch if low is None else batch.where(F.col("doc") > low)
        batch = batch if high is None else batch.where(F.col("doc") <= high)
        distinct = batch.groupBy("k1", "k2", "doc").agg(F.lit(1).alias("one"))
        runs.add(distinct.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")))
    frequent = materialise(runs.frequent(), "frequent")
    dropped = lines.join(frequent, ["k1", "k2"]).where("doc != keeper").select("doc", "th", "k1", "k2")
    for name in runs.made:  # the files stay: a lost executor may need them again
        spark.sql(f"DROP TABLE {name}")
    return dropped


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, buckets: int | None = None, fanout: int = 2
) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of ``docs`` as a struct, its text without repeated lines, and counts.

    Null or empty text: one empty line, and the text becomes empty.  Documents are counted by doc_id, rows with one id count
    once and share their decisions; null ids count as one document with the smallest id.  Ties and repeated rows follow
    from that.  Lines shorter than ``min_chars`` always stay.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct("*").alias("row"))
    doc = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    th = text_key(F.col("row.text")).alias("th")
    keys = F.explode(line_keys(min_chars)(F.col("row.text"))).alias("k")
    lines = materialise(rows.select(doc, th, keys).select("doc", "th", "k.k1", "k.k2"), "lines")
    dropped = drop_keys(lines, batches, buckets, min_docs, fanout).distinct()
    by_text = dropped.groupBy("doc", "th").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))
    met = rows.select("row", doc, th).join(materialise(by_text, "drops"), ["doc", "th"], "left")
    cut = met.select("row", without_lines(min_chars)(F.col("row.text"), F.col("drop")).alias("cut"))
    return cut.select("row", "cut.text", "cut.n_lines", "cut.n_dropped")


def with_text(cut: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of :func:`dedup_lines` with their other columns and the new text; ``n_chars`` follows the text if present."""
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("text")), "n_chars": F.length("text").cast("long")}
    changed = F.col("n_dropped") > 0
    return cut.select(
        *[
            F.when(changed, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c)
            for c in columns
        ]
    )
