"""Continuous jobs: compaction, quiescence, single delivery, load windows, tripwire.

Every job is checkpointed below the shared folder and may be killed and restarted.
Sinks are files; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from forgeclock import schemas
from forgeclock.operators import flatten
from forgeclock.operators.ordered import exact_quantiles
from forgeclock.shared import materialise, scratch, together
from forgeclock.sources import lake, pointer
from forgeclock.sources.ledger import Ledger, source_of


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, schema=None) -> DataFrame:
    """Process everything available into Parquet files and read the result back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(out)


def drain_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available with one function call per micro-batch."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


_BUILD = StructType([StructField("object_key", StringType())])


def streaming_compaction(packed: DataFrame, out: str, checkpoint: str) -> None:
    """Flatten arriving documents (object_key, body) into the five tables.

    A document that holds its whole build is flattened at once.  Parts of split builds wait, shaped, until their build has
    all its parts, and are flattened with the batch that brings the last one; a ledger of finished builds keeps parts
    that are sent again from starting anew.  Only what still waits is written again by the next batch.  Malformed documents go to
    ``quarantine``, and every batch leaves a row of ``statistics``.  A batch reads what the batch before it left
    and writes its own partition with overwrite, so a batch that is run again after a failure replaces itself.
    """
    spark = packed.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            ingested = lake.ingest(batch)
            good = lake.well_formed(ingested)
            ledger, source = Ledger(spark, f"{out}/builds", _BUILD), source_of(spark, checkpoint)
            parts = good.where(flatten.split_build())
            if number and pointer.exists(spark, f"{out}/waiting/batch={number - 1}"):
                parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{out}/waiting/batch={number - 1}"))
            # Finished by another batch than this one: what this one finished, in an earlier attempt, is finished again.
            mine = (F.col("source") == source) & (F.col("batch") == number)
            over = ledger.all().where(~mine).select("object_key")
            parts = materialise(parts.join(over, "object_key", "left_anti"), "parts")
            counted = parts.groupBy("object_key").agg(F.count_distinct("head.part").alias("n"), F.max("head.parts").alias("parts"))
            ready = materialise(counted.where("n >= parts").select("object_key"), "ready")
            done = parts.join(ready, "object_key", "left_semi")
            once = done.withColumn("__part", F.col("head.part")).dropDuplicates(["object_key", "__part"]).drop("__part")
            whole = good.where(~flatten.split_build()).unionByName(once.select(*good.columns))
            tables = flatten.five_tables(materialise(whole, "whole"))
            tables["waiting"] = parts.join(ready, "object_key", "left_anti")
            tables["quarantine"] = lake.quarantine(ingested)
            tables["statistics"] = ingested.agg(
                F.count(F.lit(1)).alias("objects"),
                F.count_if(F.col("fault").isNotNull()).alias("failed"),
                F.count_if(F.col("fault").isNull() & flatten.split_build()).alias("parts"),
            )

            def write(name: str) -> None:
                tables[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

            together(write, list(tables))
            ledger.claim(ready, source, number)
            if number > 1:
                pointer.delete(spark, f"{out}/waiting/batch={number - 2}")

    drain_batches(packed, work, checkpoint)


def compacted(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the five tables over all batches, with what is known of builds that still wait for parts."""
    whole = _batches(spark, out, name, schemas.TABLES[name]).select(*schemas.TABLES[name].names)
    newest = max(int(n.split("=")[1]) for n in pointer.names(spark, f"{out}/waiting") if n.startswith("batch="))
    parts = spark.read.parquet(f"{out}/waiting/batch={newest}")
    if name == "units":
        return whole.unionByName(flatten.units_table(flatten.event_rows(parts)))
    table = {
        "sessions": flatten.sessions_table, "phases": flatten.phases_table,
        "timeline": flatten.timeline_table, "unit_flags": flatten.unit_flags_table,
    }[name]
    return whole.unionByName(table(parts))


def quarantined(spark: SparkSession, out: str) -> DataFrame:
    """Malformed documents of all batches with their faults."""
    return _batches(spark, out, "quarantine")


def batch_statistics(spark: SparkSession, out: str) -> DataFrame:
    """Objects, failures and parts of every batch."""
    return _batches(spark, out, "statistics")


def _batches(spark: SparkSession, out: str, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}/batch=*")


def quiescent_runs(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    """Bursts of log growth per run, emitted once the log has been quiet for ``gap``."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("run_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))
        .select("run_id", F.col("w.start").alias("first"), "last", "events")
    )


def single_delivery(sends: DataFrame, out: str, checkpoint: str) -> None:
    """Each run id (``run_id``) passes once for good, however late it is sent again and whichever stream sends it.

    ``out`` is the ledger (:class:`forgeclock.sources.ledger.Ledger`).  A batch reads its own buckets of it.  A new checkpoint is a
    source of its own, so it delivers nothing that an older one has delivered; streams may share a ledger, also at once.
    """
    spark, schema = sends.sparkSession, sends.select("run_id").schema

    def work(batch: DataFrame, number: int) -> None:
        Ledger(spark, out, schema).claim(batch, source_of(spark, checkpoint), number)

    drain_batches(sends, work, checkpoint)


def delivered(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """Every key of a delivery ledger with the source and batch that delivered it."""
    return Ledger(spark, out, schema).all()


def load_windows(samples: DataFrame, width: str, watermark: str) -> DataFrame:
    """Host load per run and time window."""
    return (
        samples.withWatermark("ts", watermark)
        .groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(
            F.avg("loadavg").alias("loadavg_mean"),
            F.max("cpu_pct").alias("cpu_busy_max"),
            F.count(F.lit(1)).alias("samples"),
        )
        .select("run_id", F.col("w.start").alias("start"), "loadavg_mean", "cpu_busy_max", "samples")
    )


def tripwire(
    observations: DataFrame, baseline: DataFrame, out: str, checkpoint: str, limit: float
) -> None:
    """Watch (class_id, toolchain) medians against a baseline (class_id, base_median).

    Every batch is stored, then the medians of the classes and toolchains it touched
    are taken over all stored observations; breaches go to the batch's alert partition.
    """
    spark, baseline = baseline.sparkSession, materialise(baseline, "baseline")

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/observations/batch={number}")
        stored = spark.read.schema(batch.schema).parquet(*[f"{out}/observations/batch={i}" for i in range(number + 1)])
        touched = spark.read.schema(batch.schema).parquet(f"{out}/observations/batch={number}")
        keys = ["class_id", "toolchain"]
        affected = stored.join(touched.select(*keys).distinct(), keys, "left_semi")
        median = exact_quantiles(affected, keys, "cost_us", {"median": 0.5})
        alerts = (
            median.join(baseline, "class_id")
            .withColumn("ratio", F.try_divide("median", "base_median"))
            .where(F.col("ratio") > limit)
        )
        alerts.select(*keys, "n", "median", "ratio").write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")

    drain_batches(observations, work, checkpoint)


def latest_alerts(spark: SparkSession, out: str) -> DataFrame:
    """Newest alert per class and toolchain that was not withdrawn by a later batch."""
    alerts = spark.read.parquet(f"{out}/alerts")
    seen = spark.read.parquet(f"{out}/observations").groupBy("class_id", "toolchain").agg(
        F.max("batch").alias("batch")
    )
    return alerts.join(seen, ["class_id", "toolchain", "batch"]).drop("batch")
