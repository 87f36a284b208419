"""The raw lake: one JSON document per build, date partitioned, never changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock.operators.flatten import shaped, with_fault
from forgeclock.shared import materialise

DATE_COLUMNS = ("year", "month", "day")


def read_objects(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """One row per object (object_key, body, date columns); unreadable files are skipped.

    ``path`` may be a glob; ``base`` keeps the partition columns in that case.
    """
    reader = spark.read.format("text").option("wholetext", True).option("ignoreCorruptFiles", True)
    if base:
        reader = reader.option("basePath", base)
    raw = reader.load(path)
    rest = [c for c in raw.columns if c != "value"]
    return raw.select(F.col("_metadata.file_path").alias("object_key"), F.col("value").alias("body"), *rest)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Documents packed verbatim into Parquet (object_key, body, date columns).

    A lake of billions of small objects is packed once, so later scans list few files.
    """
    return spark.read.parquet(path)


def pack(raw: DataFrame, path: str) -> None:
    """Append raw documents to a packed lake, unchanged.

    Rebalancing gives a day as many files as its size needs: small days get one, a
    day with a large part of all documents is split.
    """
    days = [c for c in DATE_COLUMNS if c in raw.columns]
    raw.hint("rebalance", *days).write.mode("append").partitionBy(*days).parquet(path)


def parse(raw: DataFrame) -> DataFrame:
    """Add ``v``: the parsed document, null where the text is no JSON."""
    # The last of repeated field names wins instead of failing the document.
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return raw.withColumn("v", F.try_parse_json("body")).drop("body")


def ingest(raw: DataFrame) -> DataFrame:
    """Parse, check and shape every document once: (..., head, events, sampled, timings, fault), in the shared folder.

    All tables are derived from this copy, so the text is never parsed twice and each table reads its own columns.
    """
    return materialise(shaped(with_fault(parse(raw))), "documents")


def flattenable(raw: DataFrame, part: str | None = None, head: Sequence[str] = ("run_id",)) -> DataFrame:
    """Well-formed documents as one table reads them, nothing written: some ``head`` fields and one of ``events``, ``sampled`` and ``timings``.

    For a single reader that is cheaper than :func:`ingest`.  Malformed documents go by an empty list instead of a filter, which
    Catalyst would push below the parse and evaluate there once more.
    """
    docs = shaped(with_fault(parse(raw)), fields=head)
    one = F.when(F.col("fault").isNull(), F.array(F.struct("head", *([part] if part else []))))
    rest = [c for c in docs.columns if c not in ("head", "events", "sampled", "timings", "fault")]
    return docs.select(*rest, F.inline(one))


def well_formed(ingested: DataFrame) -> DataFrame:
    return ingested.where("fault IS NULL").drop("fault")


def quarantine(ingested: DataFrame) -> DataFrame:
    """Documents that cannot be flattened, with the reason."""
    return ingested.where("fault IS NOT NULL").select("object_key", "fault")


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every object's key and size in one folder or several; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("object_key"), "length")


def unreadable(spark: SparkSession, path: str, parsed: DataFrame) -> DataFrame:
    """Objects in the folder that the scan could not decode."""
    keys = parsed.select("object_key").distinct()
    return listing(spark, path).join(keys, "object_key", "left_anti").select(
        "object_key", F.lit("not readable").alias("fault")
    )


def failures(spark: SparkSession, path: str, parsed: DataFrame) -> DataFrame:
    """The quarantine table: undecodable objects and malformed documents."""
    return unreadable(spark, path, parsed).unionByName(quarantine(parsed))


def on_day(raw: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """Prune to one UTC day; reaches the scan as partition filters."""
    return raw.where((F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day))


def date_columns(ts):
    """UTC day of a timestamp as the three partition columns."""
    return [F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day")]


def on_days(raw: DataFrame, days: list[tuple[int, int, int]]) -> DataFrame:
    """Documents of the given days; reaches the scan as partition filters."""
    some = F.lit(False)
    for day in days:
        here = F.lit(True)
        for name, value in zip(DATE_COLUMNS, day):
            here = here & (F.col(name) == value)
        some = some | here
    return raw.where(some)


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Some files of a packed lake, with the date columns of their folders."""
    return spark.read.option("basePath", path).parquet(*files)
