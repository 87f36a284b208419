"""Intermediate tables: a scope deletes its own only, whatever other jobs of the session do meanwhile."""

import threading
import time

from forgeclock.shared import discard, fresh_folder, materialise, passing, scratch, together


def readable(df):
    try:
        return df.count()
    except Exception:
        return None


def test_two_jobs_at_once(spark):
    inside, written, results = threading.Event(), threading.Event(), {}

    def other():
        inside.wait(60)
        results["other"] = materialise(spark.range(3), "other")
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        own = materialise(spark.range(5), "own")
        inside.set()
        written.wait(60)
        made = together(lambda n: materialise(spark.range(int(n)), "made"), ["7", "8"])
        assert [readable(x) for x in (own, made["7"], made["8"])] == [5, 7, 8]
        with scratch(spark):
            inner = materialise(spark.range(2), "inner")
        assert readable(inner) is None and readable(own) == 5
    thread.join()
    assert [readable(x) for x in (own, made["7"], results["other"])] == [None, None, 3]


def test_discard(spark):
    kept, gone = materialise(spark.range(2), "kept"), materialise(spark.range(2), "gone")
    discard(gone)
    assert readable(kept) == 2 and readable(gone) is None
    assert fresh_folder(spark, "a") != fresh_folder(spark, "a")


def test_shuffle_files_go_with_the_write(spark):
    """Else they stay until the driver collects its garbage, and iterative jobs fill the disk; the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(key, None), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = manager.getAllFiles().mkString("\n").split("\n")
        return {x for x in found if "/shuffle_" in x and x.endswith(".data")}

    known = shuffles()
    made = materialise(spark.range(5000).repartition(5, "id").groupBy("id").count(), "made")
    for _ in range(50):
        if shuffles() <= known:
            break
        time.sleep(0.1)
    assert shuffles() <= known and made.count() == 5000
    assert spark.conf.get(key, None) == before
    with passing(spark):
        with passing(spark):
            pass
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
