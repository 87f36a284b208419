"""A machine's rows go from lake, tables, days and snapshots; other files stay as they are."""

import json

import pytest
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.sources import forget, lake, pointer, sinks
from forgeclock.sources.publication import Publication

EVENTS = [
    {"reason": "unit-registered", "index": 0, "package_id": "registry+x#a@1"}, {"reason": "unit-started", "index": 0, "elapsed": 1},
    {"reason": "unit-finished", "index": 0, "elapsed": 3},
]
FIELDS = "object_key string, body string, year int, month int, day int"


def body(run, machine, **more):
    sampled = {"units": [{"crate": "a", "flags": {"lto": True}, "serial": {"borrowck": 3}}]}
    timings = {"concurrency_data": [{"t": 1}], "cpu_usage": []}
    return json.dumps({"run_id": run, "machine": {"machine_id": machine}, "phases": sampled, "timings": timings, "events": EVENTS, **more})


def published(spark, tmp_path):
    """Days 1 to 3 with a file each; machine m lies on days 1 and 2, with a build in parts on both, and alone on day 2."""
    packed, out = str(tmp_path / "packed"), str(tmp_path / "out")
    part = lambda p: json.loads(body("split", "m")) | {"build": "b", "part": p, "parts": 2, "first_pos": 5 * p}
    days = {
        1: [("k1", body("r1", "m")), ("k2", body("r2", "n")), ("s0", json.dumps(part(0))), ("bad", "{")],
        2: [("k3", body("r3", "m")), ("s1", json.dumps(part(1)))],
        3: [("k4", body("r4", "n")), ("k5", body("r5", None)), ("k6", body(None, "n"))],
    }
    for day, rows in days.items():
        lake.pack(spark.createDataFrame([(*r, 2026, 1, day) for r in rows], FIELDS).coalesce(1), packed)
    sinks.compact_new_days(spark, packed, out)
    sinks.compact(lake.read_packed(spark, packed), out, day="2026-01-03")
    sinks.compact(lake.read_packed(spark, packed).where("day <> 3"), out, day="2026-01-04")
    return packed, out


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def check(spark, packed, out):
    made, left = Publication(spark, out), {"r2", "r4", "r5", None}
    runs = lambda df: {r.run_id for r in df.select("run_id").collect()}
    for name in schemas.TABLES:
        assert runs(made.days(name)) == left
        assert runs(made.snapshot(name, "2026-01-03")) == left
        assert runs(made.snapshot(name, "2026-01-04")) == runs(made.table(name)) == {"r2"}
    assert made.days("sessions").where("machine_id = 'm'").isEmpty()
    assert {r.object_key for r in lake.read_packed(spark, packed).collect()} == {"k2", "bad", "k4", "k5", "k6"}
    assert sinks.compact_new_days(spark, packed, out) == []
    builds = spark.read.option("recursiveFileLookup", True).schema("raw_key string").parquet(f"{out}/builds/runs")
    assert builds.isEmpty()


def test_forget_everywhere(spark, tmp_path):
    packed, out = published(spark, tmp_path)
    before = files(tmp_path)
    done = forget.forget_machine(spark, "m", out, packed)
    check(spark, packed, out)
    after = files(tmp_path)
    assert done["lake"] == 2 and done["builds"] > 0
    day3 = {p: t for p, t in before.items() if "day=3" in p}
    assert day3 and day3.items() <= after.items()
    assert all(after[p] == t for p, t in before.items() if p in after)
    assert set(forget.forget_machine(spark, "m", out, packed).values()) == {0}
    assert set(forget.forget_machine(spark, "nobody", out, packed).values()) == {0}
    assert files(tmp_path) == after


def test_documents_are_parsed_no_more_often_than_needed(spark, tmp_path, monkeypatch):
    """What arrives is shaped for its day once; to forget a machine all documents are read once, and again only those of files that change."""
    shaped, read = [], []
    ingest, owners = lake.ingest, forget._owners
    monkeypatch.setattr(lake, "ingest", lambda raw: shaped.append(raw.count()) or ingest(raw))
    monkeypatch.setattr(forget, "_owners", lambda rows: read.append(rows.count()) or owners(rows))
    packed, out = published(spark, tmp_path)
    assert shaped[:2] == [9, 2] and len(shaped) == 4  # the days and the parts of split builds, then one for each whole publication
    forget.forget_machine(spark, "m", out, packed)
    check(spark, packed, out)
    assert read == [9, 6]


def test_a_run_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    packed, out = published(spark, tmp_path)
    real, moved = pointer.move, []

    def move(spark, source, target):
        if "/_state/" not in target:
            moved.append(target)
            if len(moved) == 3:
                raise OSError("killed")
        return real(spark, source, target)

    monkeypatch.setattr(pointer, "move", move)
    with pytest.raises(OSError):
        forget.forget_machine(spark, "m", out, packed)
    monkeypatch.setattr(pointer, "move", real)
    assert set(forget.forget_machine(spark, "m", out, packed).values()) == {0}
    check(spark, packed, out)


def test_nothing_published(spark, tmp_path):
    assert forget.forget_machine(spark, "m", str(tmp_path / "none")) == {}
