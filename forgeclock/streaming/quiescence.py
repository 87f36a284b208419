"""When a log is finished: its size has not changed for a while, or the wait is given up.

A log's polls (run_id, ts, size) come as a stream.  A log is ``quiet`` once a size above zero has stood for the quiet time, if that is before
the cap, counted from its first poll.  At the cap it is ``given up``, or ``empty`` if its size then is zero.  Each log gets one outcome, whatever
comes later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from forgeclock.operators.ordered import running_last
from forgeclock.shared import materialise, scratch
from forgeclock.sources import pointer
from forgeclock.sources.ledger import Ledger, source_of
from forgeclock.streaming.jobs import drain_batches

#: Decided logs: the outcome, when it was reached and the size then; times in microseconds.
OUTCOMES = StructType(
    [StructField("run_id", StringType()), StructField("outcome", StringType()), StructField("at", LongType()), StructField("size", LongType())]
)
_POINTS = StructType([StructField("run_id", StringType()), StructField("at", LongType()), StructField("size", LongType())])


@dataclass(frozen=True)
class Rule:
    """All in microseconds; polls that come more than ``delay`` after newer ones of any log may be too late for their log."""

    quiet: int
    cap: int
    delay: int = 0


def points(polls: DataFrame, rule: Rule) -> DataFrame:
    """Polls (run_id, at, size) whose size differs from that of the poll before, and the first of each log.

    Polls of one log at one time count as one with the largest size.  Cut into segments of time, so a busy log fills no single task.
    """
    one = polls.groupBy("run_id", "at").agg(F.max("size").alias("size"))
    segment = F.floor(F.col("at") / rule.cap)
    before = running_last(one, ["run_id"], "at", {"before": F.col("size")}, segment, strict=True)
    return before.where("before IS NULL OR before <> size").select(*_POINTS.names)


def decided(changes: DataFrame, rule: Rule, horizon: Column) -> DataFrame:
    """Outcomes of the logs with these change points that are reached by ``horizon``."""
    back = changes.withColumn("back", -F.col("at"))
    segment = F.floor(F.col("back") / rule.cap)
    nexts = running_last(back, ["run_id"], "back", {"next": F.col("at")}, segment, strict=True)
    rest = F.col("at") + rule.quiet
    still = (F.col("size") > 0) & (F.col("next").isNull() | (F.col("next") > rest))
    begun = changes.groupBy("run_id").agg((F.min("at") + rule.cap).alias("cap"))
    first = F.min_by(F.struct(rest.alias("at"), "size"), F.when(still & (rest < F.col("cap")), F.col("at")))
    last = F.max_by("size", F.when(F.col("at") < F.col("cap"), F.col("at")))
    logs = nexts.join(begun, "run_id").groupBy("run_id").agg(
        first.alias("quiet"), last.alias("size"), F.first("cap").alias("cap")
    )
    named = logs.select(
        "run_id",
        F.when(F.col("quiet").isNotNull(), "quiet").when(F.col("size") > 0, "given up").otherwise("empty").alias("outcome"),
        F.coalesce("quiet.at", "cap").alias("at"),
        F.coalesce("quiet.size", "size").alias("size"),
    )
    return named.where(F.col("at") <= horizon)


def watch(polls: DataFrame, out: str, checkpoint: str, rule: Rule) -> None:
    """Process everything available of a stream of polls (run_id, ts, size); a null size counts as zero.

    Between batches only change points of undecided logs are kept, and the newest time seen.  Outcomes are claims of a ledger, so
    a log has one, and a batch reads its own buckets of them.  A batch writes its own folders with overwrite and claims last:
    run again after a failure it does the same.
    """
    spark = polls.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            ledger = _ledger(spark, out)
            seen = batch.where("run_id IS NOT NULL AND ts IS NOT NULL").select(
                F.col("run_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
            )
            if number:
                seen = seen.unionByName(_left(spark, out, "waiting", number - 1, _POINTS))
            seen = materialise(seen, "polls")
            known = ledger.matching(seen.select("run_id")).select("run_id")
            changes = materialise(points(seen.join(known, "run_id", "left_anti"), rule), "points")
            newest = seen.agg(F.max("at").alias("at"))
            if number:
                newest = newest.unionByName(_left(spark, out, "clock", number - 1, "at BIGINT"))
            newest.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{out}/clock/batch={number}")
            (latest,) = _left(spark, out, "clock", number, "at BIGINT").first()
            horizon = F.lit(None if latest is None else latest - rule.delay).cast("bigint")
            over = materialise(decided(changes, rule, horizon), "decided")
            waiting = changes.join(over.select("run_id"), "run_id", "left_anti")
            waiting.write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")
            ledger.claim(over, source_of(spark, checkpoint), number)
            if number > 1:
                pointer.delete(spark, f"{out}/waiting/batch={number - 2}")
                pointer.delete(spark, f"{out}/clock/batch={number - 2}")

    drain_batches(polls, work, checkpoint)


def _ledger(spark: SparkSession, out: str) -> Ledger:
    return Ledger(spark, f"{out}/outcomes", OUTCOMES, by=["run_id"])


def _left(spark: SparkSession, out: str, name: str, number: int, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/{name}/batch={number}")


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """(run_id, outcome, at, size) of the logs decided so far."""
    return _ledger(spark, out).all().select(*OUTCOMES.names)


def settled(spark: SparkSession, out: str, rule: Rule) -> DataFrame:
    """Outcomes of all logs if no poll comes any more: a log that still waits keeps its last size.

    Nothing is recorded, so a stream that goes on decides for itself.
    """
    done = outcomes(spark, out)
    batches = [int(n.split("=")[1]) for n in pointer.names(spark, f"{out}/waiting") if n.startswith("batch=")]
    if not batches:
        return done
    rest = _left(spark, out, "waiting", max(batches), _POINTS).join(done.select("run_id"), "run_id", "left_anti")
    return done.unionByName(decided(rest, rule, F.lit(2**63 - 1)))
