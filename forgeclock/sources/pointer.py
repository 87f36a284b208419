"""One small numbered file that says which data of a folder count.

Data are written first, under names of their own; then the next state is put in place at once.  A writer that dies before that
leaves the old state whole, and of two writers that start from the same state only the first one gets its own in.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Older states than these are removed.
KEPT = 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    if not exists(spark, path):
        return []
    return [s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path))]


def read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = _files(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file unless the target exists; False if it does."""
    jvm, to = spark._jvm, _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, source), to, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def current(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, content) of the state that counts; (0, {}) before the first."""
    states = f"{folder}/_state"
    numbers = [int(n[:-5]) for n in names(spark, states) if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    newest = max(numbers)
    return newest, json.loads(read_text(spark, f"{states}/{newest:012d}.json"))


def advance(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Put the state that follows ``number`` in place; False, and nothing is changed, if another writer did so before."""
    states = f"{folder}/_state"
    draft = f"{states}/{uuid.uuid4().hex}.draft"
    write_text(spark, draft, json.dumps(content, sort_keys=True))
    if not move(spark, draft, f"{states}/{number + 1:012d}.json"):
        delete(spark, draft)
        return False
    if number > KEPT:
        delete(spark, f"{states}/{number - KEPT:012d}.json")
    return True
