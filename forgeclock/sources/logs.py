"""Event logs: JSON lines, one file per build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.functions import coerce
from forgeclock.shared import discard, growing, materialise, settings

UNKNOWN_RUN = "?"

# What opening a file counts for, in bytes, when small files are put together for a task.
OPEN_BYTES = 65_536


def _many_files(spark: SparkSession):
    """Settings under which a folder of very many small files is listed and read by as many tasks as its bytes ask for.

    Spark's own would list with up to 10,000 tasks and read a few files in each, the driver would keep a record of every task, and it would
    keep the listing for later readers, who there are none of.
    """
    return settings(
        spark, files__openCostInBytes=str(OPEN_BYTES), hive__filesourcePartitionFileCacheSize="0",
        sources__parallelPartitionDiscovery__parallelism=str(4 * spark.sparkContext.defaultParallelism),
    )


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(log, pos, line) of every log below ``path``, other files left aside; ``pos`` follows the file order.

    Lines are read split by split, so one very large log spreads over tasks.  ``pos``
    is the split's byte offset plus the line's number inside it; a line takes at least
    one byte, so positions never overlap.
    """
    with _many_files(spark):
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        lines = materialise(
            raw.select(
                F.col("_metadata.file_path").alias("log"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("seq"),
                F.col("value").alias("line"),
            ),
            "log-lines",
        )
    starts = lines.groupBy("log", "block").agg(F.min("seq").alias("first"))
    return lines.join(growing(starts), ["log", "block"]).select(
        "log", (F.col("block") + F.col("seq") - F.col("first")).alias("pos"), "line"
    )


def valid_events(lines: DataFrame) -> DataFrame:
    """(log, pos, e) without any log that holds one line that is not a JSON object.

    Stored: headers, redaction and documents read the events about ten times over, and would look for broken logs each time.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = materialise(lines.select("log", "pos", F.try_parse_json("line").alias("e")), "log-events")
    kind = F.schema_of_variant("e")
    is_object = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    broken = parsed.where(~is_object).select("log").distinct()
    valid = materialise(parsed.join(growing(broken), "log", "left_anti"), "valid-events")
    discard(parsed)
    return valid


def run_headers(events: DataFrame) -> DataFrame:
    """Per log: run id of the first line that has one, and the last build-started event."""
    e = F.col("e")
    run = F.coalesce(coerce.text(e, "$.run_id"), F.lit(UNKNOWN_RUN))
    started = coerce.text(e, "$.reason") == "build-started"
    at = F.when(started, F.col("pos"))
    return events.groupBy("log").agg(
        F.coalesce(F.min_by(run, F.when(run != "", F.col("pos"))), F.lit("")).alias("run_id"),
        F.max_by(coerce.text(e, "$.workspace_root"), at).alias("workspace_root"),
        F.max_by(coerce.text(e, "$.timestamp"), at).alias("timestamp"),
        F.count(F.lit(1)).alias("events"),
    )


def event_table(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Typed event rows of valid logs, keyed by log."""
    typed = events.select("log", "pos", F.try_variant_get("e", "$", coerce.EVENT).alias("e"))
    return typed.join(headers.select("log", "run_id"), "log").select(
        F.col("log").alias("object_key"), "run_id", "pos", *coerce.event_columns(F.col("e"))
    )


def select_logs(
    logs: DataFrame, name: str = "log", everything: bool = False, since: int = 1, fragment: str | None = None
) -> DataFrame:
    """Logs to work on: by name fragment, or all, or the ``since`` newest by name."""
    if fragment is not None:
        return logs.where(F.contains(F.col(name), F.lit(fragment)))
    if everything:
        return logs
    return logs.orderBy(F.desc(name)).limit(since)


def workspace_logs(logs: DataFrame, workspace: str) -> DataFrame:
    return logs.where(F.col("workspace_root") == workspace)


def newest_per_workspace(logs: DataFrame, name: str = "log") -> DataFrame:
    return logs.groupBy("workspace_root").agg(F.max(name).alias(name))
