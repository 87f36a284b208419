"""Everything recorded under a machine id goes, where it lies: packed lake, published versions, days and snapshots, ledger of parts.

Only files that hold such a row are rewritten.  What stays of them is written aside first; then a plan, one small state file, tells which
files come in and which go, and is carried out.  A run that dies before the plan leaves everything as it was, and one that dies later
is finished by the next call.  Readers should wait meanwhile: a file is replaced by moving its successor in and deleting it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.functions import coerce
from forgeclock.shared import materialise, scratch
from forgeclock.sources import lake, pointer
from forgeclock.sources.ledger import Ledger
from forgeclock.sources.publication import Publication, union
from forgeclock.sources.sinks import OBJECTS


def forget_machine(spark: SparkSession, machine_id: str, folder: str, packed: str | None = None) -> dict[str, int]:
    """Delete all rows of a machine's builds and return how many files of each place were rewritten or dropped.

    A build is the machine's if a session row or a document names the machine; all rows with its run id go, in ``folder`` as in
    the ``packed`` lake.  Rows without run id go by the machine id alone.  Documents that can't be parsed can't be told and stay.
    Versions that nothing names any more are deleted too.
    """
    _finish(spark, folder, packed)
    roots = {n: f"{folder}/{n}" for n in schemas.TABLES if _holds_files(spark, f"{folder}/{n}")}
    with scratch(spark):
        published = Publication(spark, folder)
        published.clean()
        named = []
        if "sessions" in roots:
            named.append(_files(spark, roots["sessions"]).select("run_id", "machine_id"))
        if packed:
            owners = materialise(_owners(_files(spark, packed)).select("run_id", "machine_id", "object_key", "file"), "owners")
            named.append(owners.select("run_id", "machine_id"))
        if not named:
            return {}
        runs = union(named).where((F.col("machine_id") == machine_id) & F.col("run_id").isNotNull()).select("run_id").distinct()
        runs = materialise(runs, "forgotten")

        def mark(rows: DataFrame) -> DataFrame:
            """Add ``gone``."""
            out = rows.join(runs.withColumn("known", F.lit(True)), "run_id", "left")
            own = F.col("machine_id") == machine_id if "machine_id" in rows.columns else F.lit(False)
            return out.withColumn("gone", F.coalesce("known", F.lit(False)) | F.coalesce(own, F.lit(False))).drop("known")

        plans = {n: _plan(spark, root, mark) for n, root in roots.items()}
        if packed:
            plans["lake"] = _plan(spark, packed, lambda rows: mark(_owners(rows)), mark(owners))
            keys = materialise(mark(owners).where("gone").select(F.col("object_key").alias("raw_key"), "gone").distinct(), "keys")
            if _holds_files(spark, f"{folder}/builds/runs"):
                plans["builds"] = _plan(
                    spark, f"{folder}/builds/runs", lambda rows: rows.join(keys, "raw_key", "left").fillna(False, ["gone"])
                )
    number, _ = pointer.current(spark, f"{folder}/_forget")
    moves, deletes = [m for p in plans.values() for m in p["moves"]], [d for p in plans.values() for d in p["deletes"]]
    staged = [p["staged"] for p in plans.values() if p["staged"]]
    if not pointer.advance(spark, f"{folder}/_forget", number, {"moves": moves, "deletes": deletes, "staged": staged}):
        raise RuntimeError(f"{folder}: another run forgets a machine")
    _finish(spark, folder, packed)
    return {name: len(plan["deletes"]) for name, plan in plans.items()}


def _owners(packed: DataFrame) -> DataFrame:
    """Packed documents with the run and machine that they name."""
    v = F.try_parse_json("body")
    return packed.withColumns({"run_id": coerce.text(v, "$.run_id"), "machine_id": coerce.text(v, "$.machine.machine_id")})


def _files(spark: SparkSession, root: str) -> DataFrame:
    """All rows below a folder as the files have them, with ``file``; columns that only folder names tell are left out."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(root)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def _holds_files(spark: SparkSession, root: str) -> bool:
    return pointer.exists(spark, root) and not lake.listing(spark, root).where("object_key LIKE '%.parquet'").isEmpty()


def _plan(spark: SparkSession, root: str, mark: Callable[[DataFrame], DataFrame], marked: DataFrame | None = None) -> dict:
    """Write what stays of the files with a row that goes beside them; which files come and go.

    ``marked``: (file, gone) of all rows, where it is known before.
    """
    rows = _files(spark, root)
    marked = mark(rows) if marked is None else marked
    touched = sorted(r["file"] for r in marked.where("gone").select("file").distinct().collect())  # Spark's file index holds more
    if not touched:
        return {"moves": [], "deletes": [], "staged": None}
    paths = {file: unquote(file) for file in touched}
    folders = sorted({path.rsplit("/", 1)[0] for path in paths.values()})
    places = spark.createDataFrame([(f, folders.index(p.rsplit("/", 1)[0])) for f, p in paths.items()], "file string, place int")
    read = spark.read.schema(rows.drop("file").schema).parquet(*paths.values()).select("*", F.col("_metadata.file_path").alias("file"))
    rest = mark(read).where("NOT gone").join(places, "file")
    staged = f"{root}/_forget/{uuid.uuid4().hex}"
    rest.select(*rows.drop("file").columns, "place").hint("rebalance", "place").write.partitionBy("place").parquet(staged)
    moves = [
        [f"{staged}/{place}/{name}", f"{folders[int(place.split('=')[1])]}/{name}"]
        for place in pointer.names(spark, staged) if place.startswith("place=")
        for name in pointer.names(spark, f"{staged}/{place}") if name.endswith(".parquet")
    ]
    return {"moves": moves, "deletes": list(paths.values()), "staged": staged}


def _finish(spark: SparkSession, folder: str, packed: str | None) -> None:
    """Carry out the plan that counts, from wherever an earlier run left it."""
    number, plan = pointer.current(spark, f"{folder}/_forget")
    if not plan:
        return
    for source, target in plan["moves"]:
        if pointer.exists(spark, source):
            pointer.move(spark, source, target)
    if packed and plan["moves"]:  # files of the lake with new names are done, as the old ones were
        names = spark.createDataFrame([(target.rsplit("/", 1)[1],) for _, target in plan["moves"]], "name string")
        done = Ledger(spark, f"{folder}/objects", OBJECTS)
        listed = lake.listing(spark, packed).select(F.col("object_key").alias("path"), F.element_at(F.split("object_key", "/"), -1).alias("name"))
        done.claim(listed.join(names, "name", "left_semi"), f"forgotten {uuid.uuid4().hex}", 0)
    for path in [*plan["deletes"], *plan["staged"]]:
        pointer.delete(spark, path)
    pointer.advance(spark, f"{folder}/_forget", number, {})
