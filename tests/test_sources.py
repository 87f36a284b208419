"""Lakes, logs and publication on real files."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from forgeclock import schemas
from forgeclock.operators import flatten
from forgeclock.sources import documents, lake, logs, pointer, sinks
from forgeclock.sources.publication import Overtaken, Publication

GOOD = {
    "some_schema": 1, "run_id": "r1", "env": {"timestamp": "2026-01-02T00:00:00Z"},
    "events": [
        {"reason": "unit-registered", "index": 0, "package_id": "x#a@1", "target": {"name": "a"}},
        {"reason": "unit-started", "index": 0, "elapsed": 1}, {"reason": "unit-finished", "index": 0, "elapsed": 2},
    ],
}


def put(root, day, name, data):
    d = root / "sessions" / "year=2026" / "month=01" / f"day={day:02d}"
    d.mkdir(parents=True, exist_ok=True)
    (d / name).write_bytes(data)


def zst(text):
    return zstandard.compress(text.encode())


def test_object_lake_isolates_bad_blobs(spark, tmp_path):
    put(tmp_path, 2, "good.json.zst", zst(json.dumps(GOOD)))
    put(tmp_path, 2, "corrupt.json.zst", zst(json.dumps(GOOD) * 50)[:60])
    put(tmp_path, 3, "text.json.zst", zst("not json\nat all"))
    put(tmp_path, 3, "shape.json.zst", zst(json.dumps({**GOOD, "timings": {"cpu_usage": [5]}})))
    root = str(tmp_path / "sessions")
    ingested = lake.ingest(lake.read_objects(spark, root))
    good = lake.well_formed(ingested)
    assert flatten.sessions_table(good).count() == 1
    assert flatten.units_table(flatten.event_rows(good)).first().duration == 1.0
    bad = {r.object_key.rsplit("/", 1)[1]: r.fault for r in lake.failures(spark, root, ingested).collect()}
    assert bad == {"corrupt.json.zst": "not readable", "text.json.zst": "not json", "shape.json.zst": "cpu_usage"}
    day = lake.on_day(lake.read_objects(spark, root), 2026, 1, 2)
    assert "PartitionFilters: [isnotnull(year" in day._jdf.queryExecution().toString()


def test_publication(spark, tmp_path):
    raw = spark.createDataFrame([("k1", json.dumps(GOOD)), ("k2", "{")], "object_key string, body string")
    out = str(tmp_path / "out")
    stats = sinks.compact(raw, out, day="2026-01-05").first()
    assert (stats.sessions, stats.units, stats.objects, stats.failed, stats.phase_rows) == (1, 1, 2, 1, 0)
    made = Publication(spark, out)
    assert spark.read.parquet(made.path("units")).columns == schemas.UNITS.names
    assert not made.has("phases") and made.snapshot("units", "2026-01-05").count() == 1
    doc = json.loads(spark.read.text(f"{out}/schema/v1").first().value)
    assert list(doc["tables"]["units"]["columns"]) == schemas.UNITS.names and doc["version"] == 1


def test_nothing_is_written_without_sessions(spark, tmp_path):
    raw = spark.createDataFrame([("k2", "{")], "object_key string, body string")
    with pytest.raises(sinks.NoSessions):
        sinks.compact(raw, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_incremental_days(spark, tmp_path):
    def packed(day, run):
        body = json.dumps({**GOOD, "run_id": run})
        raw = spark.createDataFrame([(f"sessions/{run}", body, 2026, 1, day)], "object_key string, body string, year int, month int, day int")
        lake.pack(raw, str(tmp_path / "packed"))
        return str(tmp_path / "packed")

    out = str(tmp_path / "out")
    assert sinks.compact_new_days(spark, packed(1, "a"), out) == [(2026, 1, 1)]
    assert sinks.compact_new_days(spark, packed(2, "b"), out) == [(2026, 1, 2)]
    assert sinks.compact_new_days(spark, str(tmp_path / "packed"), out) == []
    assert {(r.run_id, r.day) for r in Publication(spark, out).days("units").collect()} == {("a", 1), ("b", 2)}


def test_logs(spark, tmp_path):
    head = '{"reason":"build-started","run_id":"%s","workspace_root":"/w"}'
    event = '{"reason":"unit-registered","index":%d}'
    files = {
        "1.jsonl": [head % "one"] + [event % i for i in range(50)],
        "2.jsonl": [head % "two", "oops"],
        "3.jsonl": [head % "three", "[1]"],
        "4.jsonl": ['{"reason":"x"}', head % "late"],
        "5.jsonl": [],
        "6.jsonl": ['{"run_id":""}', '{"run_id":"second","reason":"build-started","workspace_root":"/v"}'],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    events = logs.valid_events(logs.read_lines(spark, str(tmp_path)))
    heads = logs.run_headers(events)
    got = {r.log.rsplit("/", 1)[1]: (r.run_id, r.workspace_root, r.events) for r in heads.collect()}
    assert got == {"1.jsonl": ("one", "/w", 51), "4.jsonl": ("?", "/w", 2), "6.jsonl": ("second", "/v", 2)}
    rows = logs.event_table(events, heads).where("run_id = 'one' AND index IS NOT NULL").orderBy("pos").collect()
    assert [r["index"] for r in rows] == list(range(50))


def test_a_log_over_several_splits_keeps_its_order(spark, tmp_path):
    n = 3000
    (tmp_path / "big.jsonl").write_text("".join('{"index":%d,"reason":"unit-registered","run_id":"r"}\n' % i for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ordered = sorted(lines, key=lambda r: r.pos)
    assert len({r.pos for r in lines}) == n
    assert [json.loads(r.line)["index"] for r in ordered] == list(range(n))


def test_many_small_logs_are_read_in_few_tasks(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"log={i}").mkdir()
        (tmp_path / f"log={i}" / "1.jsonl").write_text('{"reason":"x","index":1}\n{"reason":"x","index":2}\n')
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        assert len(lines.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism  # a file is written per task: 120 with Spark's own cost of opening
        assert spark.conf.get("spark.sql.files.openCostInBytes") == opening
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = lines.collect()
    assert len(rows) == 240 and len({(r.log, r.pos) for r in rows}) == 240 and len({r.log for r in rows}) == 120


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_events(spark):
    lines = [("l1", 0, '{"reason":"build-started","run_id":"r"}'), ("l1", 1, '{"reason":"unit-registered","index":1,"package_id":"path+file:///x#a@1"}')]
    lines += [("l2", 0, '{"reason":"unit-finished","index":1}'), ("l3", 0, "oops")]
    return logs.valid_events(spark.createDataFrame(lines, "log string, pos long, line string"))


def test_documents_from_logs_broadcast_no_table_of_logs(spark):
    """Sizes of tables that come out of VARIANT columns are underestimated, so a table with a row per log would be broadcast at any size."""
    docs = documents.documents_from_logs(small_events(spark), "c")
    assert "Broadcast" not in physical_plan(docs)
    assert {(r.log, json.loads(r.body)["counts"]["units_withheld"]) for r in docs.collect()} == {("l1", 1), ("l2", 0)}


def test_payload_of_documents_is_not_broadcast(spark):
    events = small_events(spark)
    named = events.select("log").distinct()
    payload = {name: named.select("log", F.lit(text).alias("value")) for name, text in {"ci": "true", "machine": '{"machine_id":"m"}', "load": None}.items()}
    docs = documents.documents_from_logs(events, "c", payload=payload)
    assert "Broadcast" not in physical_plan(docs)
    made = {r.log: json.loads(r.body) for r in docs.collect()}
    assert {k: (d["machine"], d["load"], d["env"]) for k, d in made.items()} == {k: ({"machine_id": "m"}, None, {"ci": True}) for k in ("l1", "l2")}


def test_log_selection(spark):
    df = spark.createDataFrame([("20260101-a.jsonl",), ("20260102-b.jsonl",), ("20260103-a.jsonl",)], "log string")
    names = lambda d: [r.log for r in d.collect()]
    assert names(logs.select_logs(df)) == ["20260103-a.jsonl"]
    assert len(names(logs.select_logs(df, since=2))) == 2
    assert len(names(logs.select_logs(df, everything=True))) == 3
    assert sorted(names(logs.select_logs(df, everything=True, fragment="-a"))) == ["20260101-a.jsonl", "20260103-a.jsonl"]


def test_a_late_document_is_published(spark, tmp_path):
    def arrive(run, day):
        body = json.dumps({**GOOD, "run_id": run})
        raw = spark.createDataFrame([(f"sessions/{run}", body, 2026, 1, day)], "object_key string, body string, year int, month int, day int")
        lake.pack(raw, str(tmp_path / "packed"))
        return sinks.compact_new_days(spark, str(tmp_path / "packed"), str(tmp_path / "out"))

    assert [arrive("a", 1), arrive("c", 2), arrive("b", 1)] == [[(2026, 1, 1)], [(2026, 1, 2)], [(2026, 1, 1)]]
    for name in ("sessions", "units"):
        rows = Publication(spark, str(tmp_path / "out")).days(name).collect()
        assert sorted((r.run_id, r.day) for r in rows) == [("a", 1), ("b", 1), ("c", 2)]


def part_bodies(parts):
    events = [
        {"reason": "unit-registered", "index": 1, "package_id": "registry+x#a@1"}, {"reason": "unit-started", "index": 1, "elapsed": 1},
        {"reason": "unit-finished", "index": 1, "elapsed": 5},
    ]
    head = {"run_id": "r", "build": "log-1", "parts": len(parts)}
    return [json.dumps({**head, "part": p, "first_pos": 10 * p, "events": [events[k]]}) for k, p in enumerate(parts)]


@pytest.mark.parametrize("parts", [[0, 1, 2], [1, 4, 9]])
def test_parts_in_objects_of_their_own_are_one_build(spark, tmp_path, parts):
    from forgeclock.streaming import jobs

    root = tmp_path / "objects"
    root.mkdir()
    for n, body in enumerate(part_bodies(parts)):
        (root / f"{n}.json").write_text(body)
    raw = lake.read_objects(spark, str(root))
    good = lake.well_formed(lake.ingest(raw))
    assert flatten.sessions_table(good).count() == 1
    assert [u.duration for u in flatten.units_table(flatten.event_rows(good)).collect()] == [4.0]
    for n, body in enumerate([*part_bodies(parts), "{"]):
        rows = spark.createDataFrame([(f"k{n}", body)], "object_key string, body string")
        rows.write.parquet(str(tmp_path / "arriving" / f"f{n}"))
    stream = jobs.file_stream(spark, str(tmp_path / "arriving" / "*"), rows.schema, per_trigger=1)
    jobs.streaming_compaction(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [u.duration for u in jobs.compacted(spark, str(tmp_path / "out"), "units").collect()] == [4.0]
    assert jobs.compacted(spark, str(tmp_path / "out"), "sessions").count() == 1
    assert [(q.object_key, q.fault) for q in jobs.quarantined(spark, str(tmp_path / "out")).collect()] == [("k3", "not json")]
    total = jobs.batch_statistics(spark, str(tmp_path / "out")).groupBy().sum("objects", "failed", "parts").first()
    assert tuple(total) == (4, 1, 3)


def test_compaction_counts_what_could_not_be_decoded(spark, tmp_path):
    import zstandard

    root = tmp_path / "objects"
    root.mkdir()
    (root / "a.json.zst").write_bytes(zstandard.compress(json.dumps(GOOD).encode()))
    (root / "b.json.zst").write_bytes(b"not compressed")
    (root / "c.json.zst").write_bytes(zstandard.compress(b"{"))
    stats = sinks.compact(lake.read_objects(spark, str(root)), str(tmp_path / "out"), source=str(root)).first()
    assert (stats.objects, stats.failed, stats.sessions) == (3, 2, 1)
    assert stats.stored_bytes == sum(f.stat().st_size for f in root.iterdir()) and stats.bytes_out > 0
    doc = json.loads(spark.read.text(str(tmp_path / "out" / "schema" / "v1")).first().value)
    assert doc["source"] == str(root) and doc["generated"].startswith("20")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_parts_over_days_are_one_build_whatever_their_order(spark, tmp_path, order):
    """Parts lie on days 4, 3 and 5; the build is at home on the earliest day known, and moves when an earlier part comes."""
    bodies, days, homes = part_bodies([0, 1, 2]), (4, 3, 5), []
    out, packed = str(tmp_path / "out"), str(tmp_path / "packed")
    fields = "object_key string, body string, year int, month int, day int"
    for step, n in enumerate(order):
        rows = [("sessions/same-key", bodies[n], 2026, 1, days[n]), (f"w{step}", json.dumps({**GOOD, "run_id": f"w{step}"}), 2026, 1, 4)]
        lake.pack(spark.createDataFrame(rows, fields), packed)
        sinks.compact_new_days(spark, packed, out)
        homes.append(min(days[k] for k in order[: step + 1]))
        made = Publication(spark, out)
        sessions = [(r.object_key, r.day) for r in made.days("sessions").collect()]
        assert sorted(sessions) == sorted([("log-1", homes[-1]), *((f"w{k}", 4) for k in range(step + 1))])
        units = {r.run_id: (r.day, r.duration) for r in made.days("units").collect()}
        assert len(units) == made.days("units").count()
    assert units["r"] == (3, 4.0)
    assert sinks.compact_new_days(spark, packed, out) == []


def test_a_run_that_dies_between_tables_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    raw = lambda run: spark.createDataFrame([(run, json.dumps({**GOOD, "run_id": run}))], "object_key string, body string")
    sinks.compact(raw("old"), out)
    real, calls = Publication.commit, []
    monkeypatch.setattr(Publication, "commit", lambda self, *a, **k: calls.append(1) or (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        sinks.compact(raw("new"), out)
    assert len(pointer.names(spark, f"{out}/units")) == 2 and calls  # written, but it does not count
    made = Publication(spark, out)
    assert [[r.run_id for r in made.table(t).collect()] for t in ("units", "sessions")] == [["old"], ["old"]]
    monkeypatch.setattr(Publication, "commit", real)
    one, two = Publication(spark, out), Publication(spark, out)
    sinks.compact(raw("new"), out)
    assert [r.run_id for r in Publication(spark, out).table("units").collect()] == ["new"]
    with pytest.raises(Overtaken):
        two.commit(tables={"units": 1})
    Publication(spark, out).clean()
    assert len(pointer.names(spark, f"{out}/units")) == 1 and one.number == 1
    assert [r.run_id for r in Publication(spark, out).table("units").collect()] == ["new"]
