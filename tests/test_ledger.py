"""The pointer and the ledger: one writer wins, nothing is claimed twice, nothing is lost."""

import threading

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from forgeclock.sources import pointer
from forgeclock.sources.ledger import Ledger

KEYS = StructType([StructField("run_id", StringType())])


def rows(spark, *names):
    return spark.createDataFrame([(n,) for n in names], KEYS)


def ids(df):
    return sorted((r.run_id for r in df.collect()), key=str)


def test_pointer(spark, tmp_path):
    folder = str(tmp_path / "p")
    assert pointer.current(spark, folder) == (0, {})
    assert pointer.advance(spark, folder, 0, {"a": 1})
    assert not pointer.advance(spark, folder, 0, {"a": 2})
    assert pointer.current(spark, folder) == (1, {"a": 1})
    for n in range(1, 30):
        assert pointer.advance(spark, folder, n, {"a": n})
    assert pointer.current(spark, folder) == (30, {"a": 29})
    assert len(pointer.names(spark, f"{folder}/_state")) <= pointer.KEPT + 1 + 30  # checksums of a local folder included


def test_claims(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), KEYS, buckets=4, fanout=3)
    assert ids(ledger.claim(rows(spark, "a", "b", "b", None), "s", 0)) == [None, "a", "b"]
    assert ids(ledger.of("s", 0)) == [None, "a", "b"]
    assert ids(ledger.claim(rows(spark, "b", "c", None), "s", 1)) == ["c"]
    assert ids(ledger.claim(rows(spark, "x", "y"), "s", 1)) == ["c"]  # the batch runs again, whatever it is given
    assert ids(ledger.claim(rows(spark, "a", "c", "d"), "new", 0)) == ["d"]
    for n in range(1, 12):
        assert ids(ledger.claim(rows(spark, "a", "d", f"e{n}"), "new", n)) == [f"e{n}"]
    assert ids(ledger.claim(rows(spark, "z"), "new", 4)) == ["e4"]  # merged since
    assert len(pointer.current(spark, ledger.path)[1]["runs"]) < 3 * 3
    every = [r.run_id for r in ledger.all().collect()]
    assert len(every) == len(set(every)) == 3 + 1 + 1 + 11
    assert ids(ledger.unclaimed(rows(spark, "a", "e11", "q"))) == ["q"]
    assert Ledger(spark, ledger.path, KEYS, buckets=99).buckets == 4


def test_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), KEYS, buckets=16)
    ledger.claim(rows(spark, *(f"k{i}" for i in range(200))), "s", 0)
    asked = ledger._keyed(rows(spark, "k1"))
    plan = ledger._unclaimed(asked, pointer.current(spark, ledger.path)[1]["runs"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize("writers", [2, 4])
def test_streams_share_a_ledger(spark, tmp_path, writers):
    path, got, errors = str(tmp_path / "l"), [], []

    def work(source):
        try:
            ledger = Ledger(spark, path, KEYS, buckets=4, fanout=2)
            for n in range(3):
                names = [f"k{i}" for i in range(n * 5, n * 5 + 10)]
                got.extend(r.run_id for r in ledger.claim(rows(spark, *names), source, n).collect())
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=(f"s{i}",)) for i in range(writers)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(got) == sorted(f"k{i}" for i in range(20))
    assert ids(Ledger(spark, path, KEYS).all()) == sorted(f"k{i}" for i in range(20))
