"""A ledger of keys, each claimed once for good, whoever asks and however often.

Claims are stored as runs, Parquet folders partitioned by a bucket of the key.  A batch is compared with its own buckets of the runs, and
becomes a run itself.  ``fanout`` runs of a level are merged into one of the next, so a bucket lies in few files however many batches
came, and a key is rewritten once per level.  Which runs count is the ledger's state (:mod:`forgeclock.sources.pointer`): a claim
counts once its state is in place, and a writer whom another one overtook compares again.  Runs carry the source and batch of each key, so a
batch that is run again gets back what it claimed the first time, merged since or not.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from forgeclock.shared import materialise
from forgeclock.sources import pointer


class Ledger:
    def __init__(
        self, spark: SparkSession, path: str, keys: StructType, by: list[str] | None = None, buckets: int = 64, fanout: int = 8
    ) -> None:
        """``keys``: the key columns; ``by``: those that choose the bucket, all unless told.

        ``buckets`` is fixed by the first claim; later openings take it from the ledger's state.
        """
        self.spark, self.path, self.keys, self.fanout, self.by = spark, path, keys, fanout, by or keys.names
        self.buckets = pointer.current(spark, path)[1].get("buckets", buckets)
        more = [StructField("source", StringType()), StructField("batch", LongType()), StructField("bucket", IntegerType())]
        self.schema = StructType([*keys.fields, *more])

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{run['folder']}") for run in runs]
        return reduce(DataFrame.unionByName, parts)

    def _store(self, rows: DataFrame) -> str:
        folder = f"runs/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _same(self, left: str, right: str, names: list[str]) -> Column:
        out = F.col(f"{left}.bucket") == F.col(f"{right}.bucket")
        for name in names:
            out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
        return out

    def all(self) -> DataFrame:
        """Every claimed key with the source and batch that claimed it."""
        return self._read(pointer.current(self.spark, self.path)[1].get("runs", [])).drop("bucket")

    def of(self, source: str, batch: int) -> DataFrame:
        """The keys that a batch of a source claimed."""
        return self.all().where((F.col("source") == source) & (F.col("batch") == batch)).select(*self.keys.names)

    def unclaimed(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of ``rows`` that nobody has claimed; reads the runs' buckets of these keys only."""
        return self._unclaimed(self._keyed(rows), pointer.current(self.spark, self.path)[1].get("runs", [])).select(*self.keys.names)

    def matching(self, rows: DataFrame) -> DataFrame:
        """The claimed keys that agree with a row of ``rows`` in the columns ``by``; reads their buckets only."""
        runs = pointer.current(self.spark, self.path)[1].get("runs", [])
        asked = self._keyed(rows, self.by)
        known = self._near(asked, runs).alias("k")
        return known.join(asked.alias("a"), self._same("a", "k", self.by), "left_semi").select(*self.keys.names)

    def _keyed(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int").alias("bucket")
        return materialise(rows.select(*(names or self.keys.names)).distinct().select("*", bucket), "asked")

    def _near(self, asked: DataFrame, runs: list[dict]) -> DataFrame:
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most all buckets
        return self._read(runs).where(F.col("bucket").isin(touched))

    def _unclaimed(self, asked: DataFrame, runs: list[dict]) -> DataFrame:
        if not runs:
            return asked
        known = self._near(asked, runs)
        return asked.alias("a").join(known.alias("k"), self._same("a", "k", self.keys.names), "left_anti")

    def claim(self, rows: DataFrame, source: str, batch: int) -> DataFrame:
        """Record the keys of ``rows`` that nobody has claimed as claimed by this batch, and return them.

        Batches of a source come in order.  One that was recorded before, by a run that failed later, gets its own
        claims back and records nothing.  Null is a key like any other.  The result is read from the ledger's files: use it before
        the next claim.
        """
        asked = None
        while True:
            number, state = pointer.current(self.spark, self.path)
            runs, done, gone = state.get("runs", []), state.get("done", {}), state.get("gone", [])
            if done.get(source, -1) >= batch:
                return self.of(source, batch)
            if asked is None:
                asked = self._keyed(rows)
            try:
                new = self._unclaimed(asked, runs)
                folder = self._store(new.select("*", F.lit(source).alias("source"), F.lit(batch).cast("long").alias("batch")))
            except (Py4JError, PySparkException):
                if pointer.current(self.spark, self.path)[0] != number:  # runs that were read have been merged meanwhile
                    continue
                raise
            state = state | {
                "buckets": self.buckets, "done": done | {source: batch}, "runs": [*runs, {"folder": folder, "level": 0}], "gone": [],
            }
            if pointer.advance(self.spark, self.path, number, state):
                for old in gone:
                    pointer.delete(self.spark, f"{self.path}/{old}")
                self._merge()
                return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*self.keys.names)
            pointer.delete(self.spark, f"{self.path}/{folder}")

    def _merge(self) -> None:
        """Merge the runs of full levels.  Merged runs are deleted by the next claim, when their readers have gone."""
        while True:
            number, state = pointer.current(self.spark, self.path)
            by_level: dict[int, list[dict]] = {}
            for run in state["runs"]:
                by_level.setdefault(run["level"], []).append(run)
            full = next((level for level, runs in sorted(by_level.items()) if len(runs) >= self.fanout), None)
            if full is None:
                return
            merged = by_level[full]
            folder = self._store(self._read(merged))
            state = state | {
                "runs": [*(r for r in state["runs"] if r not in merged), {"folder": folder, "level": full + 1}],
                "gone": [*state.get("gone", []), *(r["folder"] for r in merged)],
            }
            if not pointer.advance(self.spark, self.path, number, state):
                pointer.delete(self.spark, f"{self.path}/{folder}")


def source_of(spark: SparkSession, checkpoint: str) -> str:
    """Name of a stream for a ledger: the id that its checkpoint was made with, so a new checkpoint is a new source."""
    return json.loads(pointer.read_text(spark, f"{checkpoint}/metadata"))["id"]
