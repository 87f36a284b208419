"""Publishing: five Parquet tables, dated snapshots, manifest, run statistics."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from forgeclock import schemas
from forgeclock.operators import flatten
from forgeclock.shared import materialise, scratch, together
from forgeclock.sources import lake
from forgeclock.sources.ledger import Ledger
from forgeclock.sources.publication import Publication, day_name, union


class NoSessions(RuntimeError):
    """Nothing to publish: no document could be read."""


def write_tables(tables: dict[str, DataFrame], folder: str, day: str | None = None) -> dict[str, int]:
    """Publish new versions of the tables, all at once, and return their row counts.

    No sessions: nothing is published.  An optional table without rows stays as it was.  With ``day`` the tables that count
    then are a snapshot of that name.  A run that fails before the end changes nothing that is published.
    """
    spark = tables["sessions"].sparkSession
    if tables["sessions"].isEmpty():
        raise NoSessions("no session could be read; published tables left unchanged")
    made = Publication(spark, folder)

    def write(name: str) -> int:
        struct = schemas.TABLES[name]
        table = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in struct.fields])
        if name in schemas.OPTIONAL_TABLES and table.isEmpty():
            return 0
        table.write.parquet(made.draft(name))
        return spark.read.schema(struct).parquet(made.path(name, made.next)).count()

    counts = together(write, list(schemas.TABLES))
    left = {n for n in schemas.OPTIONAL_TABLES if not counts[n]}
    made.commit(tables={n: made.next for n in schemas.TABLES if n not in left}, snapshot=day)
    return counts


def manifest(version: int = schemas.SCHEMA_VERSION) -> dict:
    """Dictionary of every table's grain, caution and columns, from the StructTypes."""
    return {
        "version": version,
        "note": "Raw sessions are the ground truth; these tables are derived and can be rebuilt.",
        "tables": {
            name: {
                "grain": schemas.GRAIN[name],
                "caution": schemas.CAUTION[name],
                "columns": {
                    f.name: {"position": i, "type": f.dataType.simpleString(), "meaning": f.metadata["comment"]}
                    for i, f in enumerate(struct)
                },
            }
            for name, struct in schemas.TABLES.items()
        },
    }


def write_manifest(spark: SparkSession, folder: str, source: str | None = None) -> None:
    """The manifest as one small JSON text beside the tables, with the time it was made and where the documents lie."""
    made = datetime.now(timezone.utc).isoformat(timespec="seconds")
    text = json.dumps({"generated": made, "source": source, **manifest()})
    spark.createDataFrame([Row(value=text)]).coalesce(1).write.mode("overwrite").text(
        f"{folder}/schema/v{schemas.SCHEMA_VERSION}"
    )


#: Fixed value: the manifest's tables as they are read back.
_MANIFEST = "struct<version: int, tables: map<string, struct<grain: string, caution: string, columns: map<string, struct<position: int, type: string, meaning: string>>>>>"


def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, rows, position, column, type, meaning): the manifest that lies in a published folder, with the published row counts."""
    text = spark.read.text(f"{folder}/schema/v{schemas.SCHEMA_VERSION}", wholetext=True)
    tables = text.select(F.explode(F.from_json("value", _MANIFEST)["tables"]).alias("table_name", "t"))
    said = tables.select("table_name", F.explode("t.columns").alias("column", "c")).select("table_name", "column", "c.*")
    made = Publication(spark, folder)
    counts = [
        made.table(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in schemas.TABLES if made.has(n)
    ]
    return said.join(union(counts), "table_name").select("table_name", "rows", "position", "column", "type", "meaning")


def compact(raw: DataFrame, folder: str, day: str | None = None, source: str | None = None) -> DataFrame:
    """Rebuild the five tables from raw documents (object_key, body); one row of statistics.

    Parsing happens once: the well-formed documents are written to the shared folder
    and feed all five tables.  With ``source``, the folder of the objects, every object there counts:
    those that could not be decoded are failures too, and ``stored_bytes`` is their size as stored.
    """
    spark, begun = raw.sparkSession, time.monotonic()
    with scratch(spark):
        ingested = lake.ingest(raw.withColumn("bytes", F.octet_length("body")))
        counts = write_tables(flatten.five_tables(lake.well_formed(ingested)), folder, day)
        write_manifest(spark, folder, source)
        read = ingested.agg(
            F.count(F.lit(1)), F.count_if(F.col("fault").isNotNull()), F.coalesce(F.sum("bytes"), F.lit(0))
        ).first()
    size = F.coalesce(F.sum("length"), F.lit(0))
    listed, stored = lake.listing(spark, source).agg(F.count(F.lit(1)), size).first() if source else (read[0], None)
    made = Publication(spark, folder)
    (written,) = lake.listing(spark, [made.path(n) for n in schemas.TABLES if made.has(n)]).agg(size).first()
    row = {
        "sessions": counts["sessions"],
        "units": counts["units"],
        "objects": listed,
        "failed": listed - read[0] + read[1],
        "bytes_in": read[2],
        "stored_bytes": stored,
        "bytes_out": written,
        "phase_rows": counts["phases"],
        "timeline_rows": counts["timeline"],
        "flag_rows": counts["unit_flags"],
        "millis": int((time.monotonic() - begun) * 1000),
    }
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} BIGINT" for k in row))


OBJECTS = StructType([StructField("path", StringType())])
_PARTS = StructType(
    [StructField("build", StringType()), StructField("raw_key", StringType()), *(StructField(c, IntegerType()) for c in lake.DATE_COLUMNS)]
)


def _shaped(raw: DataFrame) -> DataFrame:
    """Well-formed documents with the key they have in the lake beside that of their build."""
    return lake.well_formed(lake.ingest(raw.withColumn("raw_key", F.col("object_key"))))


def _days(rows: DataFrame, name: str = "day") -> list[tuple[int, int, int]]:
    """Distinct days of a struct column; the calendar bounds them."""
    return sorted(tuple(r[0]) for r in rows.select(name).where(F.col(name).isNotNull()).distinct().collect())


def compact_new_days(spark: SparkSession, packed: str, folder: str) -> list[tuple[int, int, int]]:
    """Flatten every day that has files not published yet, each into its own partition, and publish them at once.

    ``packed`` is the folder of a packed lake.  ``objects`` is the ledger of the files done, so a file that arrives late for a
    published day brings that day up again, and a run reads new files and the days they touch only.  A build in parts
    belongs to the earliest day that any of its parts lies on, its home: ``builds`` tells where the parts of a build lie.  A
    part that comes later, on whatever day, brings up the home day again, and the day that was home before.  The file
    ledger is written last: a run that fails is simply repeated.  The days touched are returned.
    """
    date = F.struct(*lake.DATE_COLUMNS)
    objects, parts = Ledger(spark, f"{folder}/objects", OBJECTS), Ledger(spark, f"{folder}/builds", _PARTS, by=["build"])
    made = Publication(spark, folder)
    listed = lake.listing(spark, packed).select(F.col("object_key").alias("path"))
    new = materialise(objects.unclaimed(listed), "pending")
    files = [r["path"] for r in new.collect()]  # Spark's own file index of the scan holds as many
    if not files:
        return []
    with scratch(spark):
        # Only where each document belongs is read here: days are flattened from the lake below, whatever arrived.
        arrived = lake.flattenable(lake.read_files(spark, packed, files).withColumn("raw_key", F.col("object_key")), head=("part", "parts"))
        arrived = materialise(arrived.select("object_key", "raw_key", *lake.DATE_COLUMNS, "head"), "arrived")
        split = arrived.where(flatten.split_build()).select(F.col("object_key").alias("build"), "raw_key", *lake.DATE_COLUMNS)
        split = materialise(split.distinct(), "split")

        def homes(builds: DataFrame) -> DataFrame:
            return parts.matching(builds).groupBy("build").agg(F.min(date).alias("home"))

        touched = {*_days(homes(split), "home"), *_days(arrived.where(~flatten.split_build()).select(date.alias("day")))}
        parts.claim(split, f"compaction {uuid.uuid4().hex}", 0)
        days = sorted({*touched, *_days(homes(split), "home")})
        tables = _tables_of(spark, packed, days, parts) if days else {}

        def write(name: str) -> dict[str, str | None]:
            found = made.write_days(name, tables[name], schemas.TABLES[name].names)
            return {day_name(d): made.next if day_name(d) in found else None for d in days}

        if days:
            made.commit(days=together(write, list(tables)))
        objects.claim(new, f"compaction {uuid.uuid4().hex}", 0)
    return days


def _tables_of(spark: SparkSession, packed: str, days: list[tuple[int, int, int]], parts: Ledger) -> dict[str, DataFrame]:
    """The five tables of some days: documents that lie there as wholes, and the builds in parts that are at home there."""
    keys, date = list(lake.DATE_COLUMNS), F.struct(*lake.DATE_COLUMNS)
    at_home = F.lit(False)
    for day in days:
        at_home = at_home | (F.col("home") == F.struct(*[F.lit(x).alias(c) for x, c in zip(day, keys)]))
    raw = lake.read_packed(spark, packed)
    here = _shaped(lake.on_days(raw, days))
    whole = here.where(~flatten.split_build())
    builds = here.where(flatten.split_build()).select(F.col("object_key").alias("build"))
    lie = materialise(parts.matching(builds), "lie")
    home = lie.groupBy("build").agg(F.min(date).alias("home")).where(at_home)
    own = lie.join(materialise(home, "home"), "build")
    elsewhere = own.select("raw_key", *keys).distinct()
    needed = sorted({*_days(own.select(date.alias("day"))), *days})
    wanted = lake.on_days(raw, needed).withColumnRenamed("object_key", "raw_key").join(elsewhere, ["raw_key", *keys], "left_semi")
    pieces = _shaped(wanted.withColumnRenamed("raw_key", "object_key")).where(flatten.split_build())
    homes = home.select(F.col("build").alias("object_key"), *[F.col(f"home.{c}").alias(c) for c in keys])
    pieces = materialise(pieces.drop(*keys).join(homes, "object_key").select(*whole.columns), "pieces")
    good = whole.unionByName(pieces).drop("raw_key")  # both are stored
    dated = good.select("object_key", *keys).distinct()
    units = flatten.unit_rows(materialise(flatten.event_rows(good), "events")).join(dated, "object_key")
    return {
        "units": units.select(*schemas.UNITS.names, *keys),
        "phases": flatten.phases_table(good, keys),
        "timeline": flatten.timeline_table(good, keys),
        "unit_flags": flatten.unit_flags_table(good, keys),
        "sessions": flatten.sessions_table(good, keys),
    }
