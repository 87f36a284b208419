"""A published folder: table versions that are written first and count from the moment the folder's state names them.

``<folder>/<table>/version=<v>`` holds whole tables, ``<folder>/<table>/version=<v>/year=/month=/day=`` single days.  The state says which version of
each table counts, which version of each day, and which versions a dated snapshot stands for; a run that dies between two tables leaves
the state, and with it the old publication, as it was.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from forgeclock import schemas
from forgeclock.sources import pointer

DAY_COLUMNS = ("year", "month", "day")


class Overtaken(RuntimeError):
    """Another run published into the folder meanwhile."""


def day_name(day: tuple[int, int, int]) -> str:
    return "{:04d}-{:02d}-{:02d}".format(*day)


def _day_path(name: str) -> str:
    year, month, day = (int(x) for x in name.split("-"))
    return f"year={year}/month={month}/day={day}"


class Publication:
    """One reading of a folder's state; ``commit`` puts the next one in place."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.number, self.state = pointer.current(spark, folder)
        self.next = self._name(self.number + 1)

    @staticmethod
    def _name(number: int) -> str:
        """Two runs that start from one state write beside each other."""
        return f"{number:06d}-{uuid.uuid4().hex[:8]}"

    def path(self, table: str, version: str | None = None) -> str:
        """Where a version of a whole table lies, the one that counts unless told."""
        version = self.state["tables"][table] if version is None else version
        return f"{self.folder}/{table}/version={version}"

    def has(self, table: str) -> bool:
        return table in self.state.get("tables", {})

    def draft(self, table: str) -> str:
        """Where this run writes a table."""
        return self.path(table, self.next)

    def table(self, name: str) -> DataFrame:
        """A whole table as published."""
        return self.spark.read.schema(schemas.TABLES[name]).parquet(self.path(name))

    def snapshot(self, name: str, day: str) -> DataFrame:
        """A table as it was published on a day."""
        return self.spark.read.schema(schemas.TABLES[name]).parquet(self.path(name, self.state["snapshots"][day][name]))

    def snapshot_days(self) -> list[str]:
        return sorted(self.state.get("snapshots", {}))

    def days(self, name: str) -> DataFrame:
        """A table published by days, with its date columns."""
        base = f"{self.folder}/{name}"
        schema = StructType([*schemas.TABLES[name].fields, StructField("version", StringType()), *(StructField(c, IntegerType()) for c in DAY_COLUMNS)])
        paths = [f"{base}/version={v}/{_day_path(day)}" for day, v in sorted(self.state.get("days", {}).get(name, {}).items())]
        reader = self.spark.read.schema(schema).option("basePath", base)
        found = reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.drop("version")

    def write_days(self, name: str, rows: DataFrame, schema_names: list[str]) -> list[str]:
        """Write days of a table as drafts; their names.  Rows carry the date columns."""
        path = self.draft(name)
        rows.select(*schema_names, *DAY_COLUMNS).hint("rebalance", *DAY_COLUMNS).write.partitionBy(*DAY_COLUMNS).parquet(path)
        out = []
        for year in pointer.names(self.spark, path):
            for month in pointer.names(self.spark, f"{path}/{year}") if year.startswith("year=") else []:
                for day in pointer.names(self.spark, f"{path}/{year}/{month}") if month.startswith("month=") else []:
                    if day.startswith("day="):
                        out.append(day_name(tuple(int(x.split("=")[1]) for x in (year, month, day))))
        return out

    def commit(self, tables: dict[str, str] | None = None, snapshot: str | None = None, days: dict[str, dict[str, str | None]] | None = None) -> None:
        """Let new versions count: whole ``tables``, ``days`` of tables (None: the day has no rows any more), all tables as a dated snapshot."""
        state = {"tables": {}, "days": {}, "snapshots": {}} | self.state
        state["tables"] = state["tables"] | (tables or {})
        for name, changed in (days or {}).items():
            merged = state["days"].get(name, {}) | changed
            state["days"] = state["days"] | {name: {d: v for d, v in merged.items() if v is not None}}
        if snapshot:
            state["snapshots"] = state["snapshots"] | {snapshot: state["tables"]}
        if not pointer.advance(self.spark, self.folder, self.number, state):
            raise Overtaken(f"{self.folder}: state {self.number} is no longer the newest")
        self.number, self.state = self.number + 1, state
        self.next = self._name(self.number + 1)

    def needed(self) -> dict[str, set[str]]:
        """Versions of each table that the state still names."""
        out: dict[str, set[str]] = {}
        for tables in (self.state.get("tables", {}), *self.state.get("snapshots", {}).values()):
            for name, version in tables.items():
                out.setdefault(name, set()).add(version)
        for name, days in self.state.get("days", {}).items():
            out.setdefault(name, set()).update(days.values())
        return out

    def clean(self) -> None:
        """Delete versions that nothing names; call it when no reader of an older state is left."""
        for name, versions in self.needed().items():
            for found in pointer.names(self.spark, f"{self.folder}/{name}"):
                if found.startswith("version=") and found.split("=")[1] not in versions:
                    pointer.delete(self.spark, f"{self.folder}/{name}/{found}")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
