"""Session documents to tables: the cases that follow from event order and drift."""

import json
import random

import pytest
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.operators import flatten
from forgeclock.sources import lake
from tests.conftest import documents

PID = "registry+https://github.com/rust-lang/crates.io-index#serde@1.0.0"


def reg(i=0):
    return {"reason": "unit-registered", "index": i, "package_id": PID, "target": {"name": "serde"}, "mode": "build"}


def started(t, i=0):
    return {"reason": "unit-started", "index": i, "elapsed": t}


def finished(t, i=0, **more):
    return {"reason": "unit-finished", "index": i, "elapsed": t, **more}


def sec(kind, t, name="codegen", i=0):
    return {"reason": f"unit-section-{kind}", "index": i, "section": name, "elapsed": t}


CASES = {
    "reset by a second registration": ([reg(), started(1), reg(), finished(3)], dict(started=None, finished=3, duration=None)),
    "null finish keeps the duration": ([reg(), started(1), finished(3), finished(None)], dict(finished=None, duration=2)),
    "finish before start": ([reg(), finished(3), started(1)], dict(started=1, finished=3, duration=None)),
    "null start wins": ([reg(), started(1), started(None), finished(3)], dict(started=None, duration=None)),
    "start before registration": ([started(1), reg(), finished(3)], dict(started=None, duration=None)),
    "unblocked no list": ([reg(), finished(1, unblocked=7)], dict(unblocked=None)),
    "unblocked empty": ([reg(), finished(1, unblocked=[])], dict(unblocked=0)),
    "unblocked repeats": ([reg(), finished(1, unblocked=[1, 1])], dict(unblocked=2)),
    "section start reused": ([reg(), sec("started", 1), sec("finished", 2), sec("finished", 4)], dict(codegen=4)),
    "sections add up": ([reg(), sec("started", 1), sec("finished", 2), sec("started", 5), sec("finished", 7)], dict(codegen=3)),
    "section start before registration": ([sec("started", 1), reg(), sec("finished", 2)], dict(codegen=1)),
    "section finish before registration": ([sec("started", 1), sec("finished", 2), reg()], dict(codegen=None)),
    "unknown section": ([reg(), started(0), sec("started", 1, "metadata"), sec("finished", 2, "metadata"), finished(9)], dict(frontend=None)),
    "derived frontend": ([reg(), started(0), sec("started", 4), sec("finished", 7), finished(10)], dict(frontend=7, link=None)),
    "negative frontend": ([reg(), started(0), sec("started", 0), sec("finished", 1.25), finished(1)], dict(frontend=-0.25)),
    "derived beats measured": (
        [reg(), started(0), sec("started", 0, "frontend"), sec("finished", 1, "frontend"), finished(10)], dict(frontend=10)),
    "measured without duration": ([reg(), sec("started", 0, "frontend"), sec("finished", 1, "frontend")], dict(frontend=1)),
    "no sections": ([reg(), started(0), finished(10)], dict(frontend=None, duration=10)),
    "text elapsed": ([reg(), started("0.25"), finished("1")], dict(duration=0.75)),
    "unregistered": ([started(1), finished(2)], None),
}


@pytest.mark.parametrize("segment", [65_536, 2])
def test_unit_cases(spark, segment):
    rows = [(k, json.dumps({"run_id": "r", "events": ev})) for k, (ev, _) in CASES.items()]
    units = flatten.unit_rows(flatten.event_rows(documents(spark, rows)), segment).collect()
    got = {u.object_key: u for u in units}
    for name, (_, want) in CASES.items():
        if want is None:
            assert name not in got
            continue
        for column, value in want.items():
            assert got[name][column] == value, (name, column)
        assert got[name].package == "serde"


def replay(events):
    """Event-by-event emulation of a build log."""
    units, opened = {}, {}
    for e in events:
        kind, i, t, s = e["reason"], e.get("index"), e.get("elapsed"), e.get("section")
        u = units.get(i)
        if kind == "unit-registered":
            units[i] = dict(started=None, finished=None, duration=None, unblocked=None, codegen=None, link=None, frontend=None, seen=False)
        elif kind == "unit-started" and u:
            u["started"] = t
        elif kind == "unit-finished" and u:
            u["finished"] = t
            if t is not None and u["started"] is not None:
                u["duration"] = t - u["started"]
            u["unblocked"] = len(e["unblocked"]) if isinstance(e.get("unblocked"), list) else None
        elif kind == "unit-section-started" and s and t is not None:
            opened[i, s] = t
        elif kind == "unit-section-finished" and u and t is not None and (i, s) in opened and s in ("codegen", "link", "frontend"):
            u[s] = (u[s] or 0) + t - opened[i, s]
            u["seen"] = True
    for u in units.values():
        if u.pop("seen") and u["duration"] is not None:
            u["frontend"] = u["duration"] - (u["codegen"] or 0) - (u["link"] or 0)
    return units


@pytest.mark.parametrize("segment", [65_536, 5])
def test_random_logs_match_a_replay(spark, segment):
    rng = random.Random(11)
    kinds = ["unit-registered", "unit-started", "unit-finished", "unit-section-started", "unit-section-finished"]
    logs = {}
    for n in range(60):
        events = []
        for t in range(rng.randint(5, 60)):
            e = {"reason": rng.choice(kinds), "index": rng.randint(0, 3), "elapsed": rng.choice([None, t, t])}
            if "section" in e["reason"]:
                e["section"] = rng.choice(["codegen", "link", "frontend", "other", ""])
            if e["reason"] == "unit-finished":
                e["unblocked"] = rng.choice([None, 3, [], [1], [1, 2]])
            events.append(e)
        logs[f"d{n}"] = events
    rows = [(k, json.dumps({"run_id": k, "events": ev})) for k, ev in logs.items()]
    got = {}
    for u in flatten.unit_rows(flatten.event_rows(documents(spark, rows)), segment).collect():
        got[u.object_key, u["index"]] = {c: u[c] for c in ("started", "finished", "duration", "unblocked", "codegen", "link", "frontend")}
    want = {(k, i): u for k, ev in logs.items() for i, u in replay(ev).items()}
    assert got == want


def test_parts_of_one_document_join_up(spark):
    events = [reg(), started(1), sec("started", 2), sec("finished", 4), finished(9)]
    rows = [
        ("k", json.dumps({"run_id": "r", "part": 0, "first_pos": 10, "events": events[:2]})),
        ("k", json.dumps({"run_id": "r", "part": 1, "first_pos": 20, "events": events[2:]})),
    ]
    (u,) = flatten.unit_rows(flatten.event_rows(documents(spark, rows))).collect()
    assert (u.duration, u.codegen, u.frontend) == (8, 2, 6)


def test_two_blobs_of_one_run_stay_apart(spark):
    body = json.dumps({"run_id": "r", "events": [reg(), started(1), finished(2)]})
    docs = documents(spark, [("a", body), ("b", body)])
    assert flatten.units_table(flatten.event_rows(docs)).count() == 2
    assert flatten.sessions_table(docs).count() == 2


def test_sessions_and_null_is_not_zero(spark):
    doc = {
        "payload_schema": "1", "run_id": "r", "client": "c 1", "complete": "false", "env": {"jobs": "8", "ci": 0},
        "machine": {"machine_id": "m", "mem_gb": 15.9}, "load": {"loadavg_mean": None, "cpu_busy_mean": "Infinity"},
    }
    docs = documents(spark, [("k", json.dumps(doc))])
    s = flatten.sessions_table(docs).first()
    assert (s.schema, s.jobs, s.ci, s.complete, s.mem_gb, s.loadavg_mean, s.cpu_busy_mean) == (1, 8, False, True, 15, None, None)
    assert flatten.sessions_table(docs).columns == schemas.SESSIONS.names
    for table in ("phases", "timeline", "unit_flags", "units"):
        assert flatten.five_tables(docs)[table].isEmpty()


def test_phases_flags_and_timeline(spark):
    doc = {
        "run_id": "r",
        "phases": {"sampler": "s", "rate_hz": 4999, "units": [
            {"crate": "a", "package": "a-1", "crate_type": "lib", "wall_s": 1.5, "flags": {"lto": True, "opt-level": "3"},
             "serial": {"borrowck": 2.9}, "parallel": {"codegen": "7"}},
            {"crate": "b", "serial": None},
        ]},
        "timings": {"concurrency_data": [{"t": 0.5, "active": 1, "waiting": 2, "inactive": 3}], "cpu_usage": [[0.25, 50]]},
    }
    t = flatten.five_tables(documents(spark, [("k", json.dumps(doc))]))
    assert {(r.thread, r.phase, r.samples) for r in t["phases"].collect()} == {("serial", "borrowck", 2), ("parallel", "codegen", 7)}
    assert {(r.flag, r.value) for r in t["unit_flags"].collect()} == {("lto", "true"), ("opt-level", "3")}
    rows = t["timeline"].orderBy("t").collect()
    assert [tuple(r)[1:] for r in rows] == [(0.25, None, None, None, 50.0), (0.5, 1, 2, 3, None)]
    for name, frame in t.items():
        assert [f.dataType for f in frame.schema] == [f.dataType for f in schemas.TABLES[name]], name


@pytest.mark.parametrize(
    "body, fault",
    [
        ("{", "not json"), ("null", "null document"), ('{"events":7}', "events"), ('{"events":[null]}', "events"),
        ('{"events":[{"reason":"unit-registered","package_id":5}]}', "package_id"), ('{"phases":{"units":[null]}}', "phases"),
        ('{"timings":{"cpu_usage":[5]}}', "cpu_usage"), ('{"timings":{"concurrency_data":[null]}}', "concurrency"),
        ("{}", None), ('{"events":null}', None), ('{"events":[{"reason":"unit-registered","package_id":0}]}', None), ("3", None),
        ('{"events":[1]}', None),
    ],
)
def test_faults(spark, body, fault):
    assert flatten.with_fault(documents(spark, [("k", body)])).first().fault == fault


def test_completeness(spark):
    rows = [("k", json.dumps({"run_id": "r", "events": [reg(0), reg(1), finished(1)]}))]
    c = flatten.event_counts(flatten.event_rows(documents(spark, rows))).first()
    assert (c.events, c.units, c.complete) == (3, 2, False)


def test_repeated_field_names_take_the_last(spark):
    raw = spark.createDataFrame([("k", '{"run_id":"a","run_id":"b"}')], "object_key string, body string")
    assert flatten.sessions_table(lake.parse(raw)).first().run_id == "b"
    assert lake.parse(raw).where(F.col("v").isNull()).isEmpty()


def test_one_reader_sees_what_the_stored_copy_holds(spark):
    from forgeclock.plans import raw_lens
    from forgeclock.sources import lake

    raw = raw_lens.damaged(spark, "/root/testdata/sf0.001")
    stored = lake.well_formed(lake.ingest(raw))
    assert 0 < stored.count() < raw.count()
    for table, part in ((flatten.phases_table, "sampled"), (flatten.unit_flags_table, "sampled"), (flatten.timeline_table, "timings")):
        assert sorted(map(str, table(lake.flattenable(raw, part)).collect())) == sorted(map(str, table(stored).collect()))
    heads = lake.flattenable(raw, head=flatten.SESSION_HEAD)
    assert sorted(map(str, flatten.sessions_table(heads).collect())) == sorted(map(str, flatten.sessions_table(stored).collect()))
