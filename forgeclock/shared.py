"""Shared storage for intermediate tables.

Iterative jobs and multi-consumer tables cut their lineage by writing Parquet
into the folder the cluster names in ``spark.checkpoint.dir``.  A written table
survives lost executors, and its file sizes give Catalyst real statistics for
choosing join strategies.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach; a local folder only under a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="forgeclock-")
        spark.sparkContext.setCheckpointDir(path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def _own_root(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark)}/forgeclock/{spark.sparkContext.applicationId}"


#: Folders made in the open scopes of this thread of work, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared root that no other run uses."""
    path = f"{_own_root(spark)}/{label}-{uuid.uuid4().hex}"
    if open_scopes := _scopes.get():
        open_scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end; results must be stored before.

    Only what this thread writes, and the threads that :func:`together` starts for it; other jobs of the session keep theirs.
    """
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


#: Settings that open scopes hold, by session and name: how many scopes, and the value from before the first.
_held: dict[tuple[str, str], tuple[int, str | None]] = {}
_holding = Lock()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings, with ``__`` for dots, for what is planned and run inside; after the last of several at once they are as before.

    They are the session's, so they must not change any result of what other threads run meanwhile.
    """
    names = {f"spark.sql.{name.replace('__', '.')}": value for name, value in values.items()}
    session = str(spark._jsparkSession.sessionUUID())
    with _holding:
        for name, value in names.items():
            scopes, before = _held.get((session, name), (0, None))
            _held[session, name] = (scopes + 1, before if scopes else spark.conf.get(name, None))
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _holding:
            for name in names:
                scopes, before = _held.pop((session, name))
                if scopes > 1:
                    _held[session, name] = (scopes - 1, before)
                elif before is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, before)


def passing(spark: SparkSession):
    """For writes: their shuffle files go when they are done, as nothing reads them again, and not when the driver collects its garbage."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and feeds several consumers."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    with passing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def growing(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input though Catalyst may think it small: it is shuffled, never broadcast.

    A VARIANT column counts for two kilobytes a row, so what is left of a table without it is underestimated up to a hundredfold.
    """
    return df.hint("merge")


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nobody reads any more."""
    for df in stored:
        delete(df.sparkSession, df.stored_at)


def together(work: Callable[[str], object], names: list[str]) -> dict:
    """Submit one Spark job chain per table at once; the cluster shares its slots."""
    contexts = [copy_context() for _ in names]
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(lambda context, name: context.run(work, name), contexts, names)))


def drop_intermediate(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when results are stored."""
    delete(spark, _own_root(spark))
